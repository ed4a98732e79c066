"""Record validation: an ordered chain of rules, the first that fails names the violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def first_violation() -> Column:
    """Message of the first rule that a landed row breaks, null if none.

    Needs op, after_json, table_id, source_id, ordering_field, source_checkpoint, schema_version, source_event_id,
    table_mode and key_names (array of the key's names).
    """
    names = F.col("key_names")
    rules = [
        ((F.col("op") == "delete") & F.col("after_json").isNotNull(), "delete requires after=null"),
        ((F.col("op") != "delete") & F.col("after_json").isNull(), "insert/upsert require after payload"),
        *[(_blank(c), f"{c} is required") for c in ("table_id", "source_id", "ordering_field", "source_checkpoint")],
        (F.col("schema_version") <= 0, "schema_version must be positive"),
        (F.col("source_event_id").isNotNull() & (F.trim("source_event_id") == ""), "source_event_id must not be blank"),
        ((F.col("table_mode") == "append_only") & (F.col("op") != "insert"), "append_only requires insert operations"),
        ((F.col("table_mode") == "keyed_upsert") & (F.col("op") == "insert"), "keyed_upsert requires upsert or delete operations"),
        ((F.col("table_mode") == "keyed_upsert") & (F.size(names) == 0), "keyed_upsert requires a key"),
        (F.exists(names, lambda n: F.trim(n) == ""), "key names must not be blank"),
        (F.size(F.array_distinct(names)) < F.size(names), "key names must be unique"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in rules])


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows with their violation)."""
    marked = rows.withColumn("violation", first_violation())
    return marked.filter("violation is null").drop("violation"), marked.filter("violation is not null")
