"""Batch statistics: counts by operation, record sizes, schema parts, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash_array
from ..functions.text import mutation_signature


def op_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "op").agg(F.count(F.lit(1)).alias("n"))


def average_record_bytes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Floor of the mean signature length in bytes, at least one."""
    size = F.octet_length(mutation_signature()).cast("long")
    return rows.groupBy(*by).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c")).select(*by, F.greatest(F.lit(1).cast("long"), F.expr("s div c")).alias("avg_bytes"))


def kind_of(schema: Column) -> Column:
    """Type word of a variant's schema text."""
    return (
        F.when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def fields(rows: DataFrame, by: list[str], json: str) -> DataFrame:
    """(by, name, kind) of each top-level field of each row's JSON object."""
    parsed = rows.select(*by, F.try_parse_json(F.col(json)).alias("_v")).filter("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    exploded = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return exploded.select(*by, F.col("key").alias("name"), kind_of(F.schema_of_variant("value")).alias("kind"))


def key_census(rows: DataFrame, json: str) -> DataFrame:
    """How often each top-level field occurs with each type."""
    return fields(rows, [], json).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


def fingerprint_parts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts): distinct sorted ``kind:name:type`` of keys and payloads; a payload that is no object is a scalar.

    One pass: each text is parsed once, and its parts are made distinct before and after the shuffle.
    """
    texts = F.array(*(F.struct(F.lit(word).alias("word"), F.col(column).alias("text")) for column, word in (("key_json", "key"), ("after_json", "after"), ("before_json", "before"))))
    each = rows.select(*by, F.inline(F.filter(texts, lambda t: t["text"].isNotNull()))).withColumn("_v", F.try_parse_json("text"))
    each = each.withColumn("_shape", F.schema_of_variant("_v")).filter("_shape is not null")
    named = F.col("_shape").startswith("OBJECT")
    exploded = each.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    field = F.when(F.col("key").isNotNull(), F.concat_ws(":", "word", "key", kind_of(F.schema_of_variant("value"))))
    scalar = F.when(F.col("word") != "key", F.concat("word", F.lit(":scalar:"), kind_of(F.col("_shape"))))
    parts = exploded.select(*by, F.when(named, field).otherwise(scalar).alias("part")).filter("part is not null").distinct()
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("parts"))


def schema_fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    return fingerprint_parts(rows, by).select(*by, stable_hash_array(F.col("parts")).alias("schema_fingerprint"))


def percentile_ms(rows: DataFrame, by: list[str], column: str, share: float = 0.95, places: int = 3) -> DataFrame:
    """Percentile with linear interpolation, rounded; no rows give none."""
    return rows.groupBy(*by).agg(F.round(F.percentile(column, F.lit(share)), places).alias("p"))
