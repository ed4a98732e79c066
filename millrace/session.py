"""What a Spark session needs to run this library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    place = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(place, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(place)
    _shipped.add(app)
