"""Keyed upserts: equality deletes of all touched keys, appends of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ContractError


def delete_keys(batch: DataFrame, key: list[str]) -> DataFrame:
    return batch.select(*key).distinct()


def append_rows(batch: DataFrame) -> DataFrame:
    return batch.filter("op <> 'delete'")


def plan(batch: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(equality-delete keys, append rows) of a reduced batch; raises unless it is keyed, non-empty and unique by key."""
    row = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("table_mode") != "keyed_upsert"), F.lit(False)).alias("other")).first()
    if not row["n"]:
        raise ContractError("keyed upsert plan requires records")
    if row["other"]:
        raise ContractError("keyed upsert plan requires keyed_upsert records")
    if not batch.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ContractError("keyed upsert plan requires unique keys")
    return batch.select(*key), append_rows(batch)


def merge(base: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The table after a reduced batch (unique keys): base rows of untouched keys and the batch's survivors.

    Applying a batch a second time changes nothing.
    """
    appended = append_rows(batch).select(*base.columns)
    return base.join(batch.select(*key), key, "left_anti").select(*base.columns).unionByName(appended)
