"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}  # application -> its folder of tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _folder(spark: SparkSession) -> str:
    """This application's folder of tables in the shared checkpoint folder; it goes when the application ends.

    The shared folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests) one below the warehouse.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        shared = shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        _folders[app] = f"{shared.rstrip('/')}/tables-{app}"
        fs, where = _hadoop(spark, _folders[app])
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return _folders[app]


def durable(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: lost executors cost no recomputation.

    ``instead_of`` is an earlier such table that nothing else needs any more; it is deleted.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``durable`` gave."""
    fs, where = _hadoop(df.sparkSession, df._table_path)
    fs.delete(where, True)


def place(df: DataFrame, name: str) -> int:
    """Number of the column ``name``: the one so written, else the first that differs in case only."""
    exact = [i for i, c in enumerate(df.columns) if c == name] + [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"no column {name}")
    return exact[0]


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever other columns are called."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{place(df, n)}").alias(n) for n in names))


def without(df: DataFrame, unwanted) -> DataFrame:
    """The columns whose lower-cased names ``unwanted`` doesn't hold for."""
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns) if not unwanted(n.lower())))


class Aside:
    """A frame whose columns that an operator doesn't read are packed into one, so no name can clash with its own."""

    def __init__(self, df: DataFrame, *names: str):
        self.names, self.read = df.columns, {place(df, n): n for n in names}
        self.rest = [i for i in range(len(df.columns)) if i not in self.read]
        numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        packed = F.struct(*(F.col(f"c{i}") for i in self.rest)) if self.rest else F.lit(0)
        self.frame = numbered.select(*(F.col(f"c{i}").alias(n) for i, n in self.read.items()), packed.alias("_row"))

    def back(self, df: DataFrame, *more: Column) -> DataFrame:
        """The columns as they were given, in order, with what ``df`` has for those read; and ``more``."""
        columns = [F.col(self.read[i] if i in self.read else f"_row.c{i}").alias(n) for i, n in enumerate(self.names)]
        return df.select(*columns, *more)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a fair hash stays at or below with probability ``share``."""
    return min(2**63 - 1, -(2**63) + int(min(1.0, share) * 2**64))
