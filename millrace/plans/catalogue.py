"""The catalogue: every data-plane operator as a query over the standard tables, with its DuckDB form.

The events table serves as a change log of its users: ordering event_id, an ``error`` deletes, anything else upserts,
batches of a hundred events. Orders serve as an append-only log and, by simple rules on their keys, as ledger tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..model import COLUMNS, LANDED, RECOVERABLE_ATTEMPT, RECOVERABLE_BATCH, RESOLUTIONS, BatchManifest, ManifestFile
from ..operators import aggregate, normalize, reconcile, schema_policy, upsert, validate
from ..operators.compaction import arrival_numbers, compact, current_files, in_arrival_order, write_ordered
from ..operators.ledger import Ledger
from ..operators.sink import CommitRequest, MemorySink
from ..sources.files import Files
from ..sources.jsonl import FileSource, Selection
from ..streaming import gates
from ..streaming.connector import run_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- the change log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed rows with batch_no and pos."""
    e = table(spark, sf_dir, "events")
    delete = F.col("event_type") == "error"
    key = F.concat(F.lit('{"user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    after = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), "event_type", F.lit('"}'))
    return e.select(
        F.lit("events").alias("table_id"),
        F.lit("file.events").alias("source_id"),
        F.lit("database_cdc").alias("source_class"),
        F.lit("keyed_upsert").alias("table_mode"),
        F.when(delete, "delete").otherwise("upsert").alias("op"),
        key.alias("key_json"),
        F.when(~delete, after).alias("after_json"),
        F.lit(None).cast("string").alias("before_json"),
        F.lit("source_position").alias("ordering_field"),
        F.col("event_id").alias("ordering_value"),
        F.concat(F.lit("cp-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("source_checkpoint"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("source_event_id"),
        F.lit(1).alias("schema_version"),
        F.col("ts").alias("ingestion_ts"),
        F.lit("{}").alias("source_metadata_json"),
        F.expr("event_id div 100").alias("batch_no"),
        F.col("event_id").alias("pos"),
        F.col("user_id"),
    )


E = """E AS (SELECT 'events' AS table_id, 'file.events' AS source_id, 'database_cdc' AS source_class, 'keyed_upsert' AS table_mode,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, '{"user_id":' || user_id || '}' AS key_json,
  CASE WHEN event_type <> 'error' THEN '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' END AS after_json,
  CAST(NULL AS VARCHAR) AS before_json, 'source_position' AS ordering_field, event_id AS ordering_value,
  'cp-' || lpad(event_id::VARCHAR, 12, '0') AS source_checkpoint, 'evt-' || event_id AS source_event_id, 1 AS schema_version,
  ts AS ingestion_ts, '{}' AS source_metadata_json, event_id // 100 AS batch_no, event_id AS pos, user_id FROM events)"""

LATEST = """L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ordering_value DESC, pos DESC) AS rn FROM E) WHERE rn = 1)"""

FNV = """lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT,
  list_transform(range(0, length(h) // 2), lambda i: (instr('123456789ABCDEF', substr(h, 2 * i + 1, 1)) * 16 + instr('123456789ABCDEF', substr(h, 2 * i + 2, 1)))::UHUGEINT)),
  lambda s, x: (xor(s, x) * 1099511628211) % 18446744073709551616)::UBIGINT), 16, '0'))"""


def fnv_sql(expression: str, source: str, columns: str) -> str:
    """SELECT columns and fnv over an expression that gives the bytes as hex text."""
    return f"SELECT {columns}, {FNV} AS hash FROM (SELECT *, {expression} AS h FROM {source})"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state by key, counted by operation."""
    latest = normalize.latest_by_key(change_log(spark, sf_dir), ["user_id"])
    return latest.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources


@query(f"WITH {E} SELECT {', '.join(COLUMNS)} FROM E")
def src_landed_projection(spark, sf_dir):
    """SNK1, SNK2, PRJ1, PRJ3: the fifteen landed columns."""
    return change_log(spark, sf_dir).select(*COLUMNS)


@query(
    f"""WITH {E} SELECT batch_no, arg_min(source_checkpoint, pos) AS checkpoint_start, arg_max(source_checkpoint, pos) AS checkpoint_end,
  count(*) AS n FROM E GROUP BY batch_no"""
)
def src_batch_boundaries(spark, sf_dir):
    """SRC5, SRC12, AGG10, NRM4: first and last checkpoint and row count of each batch."""
    return _boundaries(change_log(spark, sf_dir))


def _boundaries(rows):
    return rows.groupBy("batch_no").agg(
        F.min_by("source_checkpoint", "pos").alias("checkpoint_start"), F.max_by("source_checkpoint", "pos").alias("checkpoint_end"), F.count(F.lit(1)).alias("n")
    )


@query(
    f"""WITH {E}, B AS (SELECT batch_no, arg_max(source_checkpoint, pos) AS checkpoint_end, count(*) AS n FROM E GROUP BY batch_no),
  T AS (SELECT checkpoint_end AS token FROM B ORDER BY batch_no LIMIT 1 OFFSET 1)
  SELECT batch_no, checkpoint_end, n FROM B WHERE batch_no > (SELECT batch_no FROM B, T WHERE checkpoint_end = token)"""
)
def src_resume_after_checkpoint(spark, sf_dir):
    """SRC7, STR7: the batches after the one whose last checkpoint is the resume token."""
    bounds = _boundaries(change_log(spark, sf_dir)).select("batch_no", "checkpoint_end", "n")
    token = bounds.orderBy("batch_no").offset(1).limit(1).select(F.col("checkpoint_end").alias("token"))
    found = bounds.join(F.broadcast(token), F.col("checkpoint_end") == F.col("token")).select(F.col("batch_no").alias("seen"))
    return bounds.join(F.broadcast(found), F.col("batch_no") > F.col("seen")).select("batch_no", "checkpoint_end", "n")


@query(f"WITH {E} SELECT table_id, source_id, min(source_class) AS source_class, count(DISTINCT batch_no) AS batch_count, count(*) AS record_count FROM E GROUP BY ALL")
def src_check_report(spark, sf_dir):
    """SRC12, CLI5: batches and records of a source."""
    return (
        change_log(spark, sf_dir)
        .groupBy("table_id", "source_id")
        .agg(F.min("source_class").alias("source_class"), F.count_distinct("batch_no").alias("batch_count"), F.count(F.lit(1)).alias("record_count"))
    )


@query(f"WITH {E} SELECT event_id, 'right.events' AS table_id, 'file.right' AS source_id, source_class FROM (SELECT *, pos AS event_id FROM E)")
def src_routed(spark, sf_dir):
    """SRC15: a routed source rewrites table and source and keeps the class."""
    return change_log(spark, sf_dir).select(
        F.col("pos").alias("event_id"), F.lit(text.connector_table_id("right", "events")).alias("table_id"), F.lit("file.right").alias("source_id"), "source_class"
    )


# ---------------------------------------------------------------- JSON


@query("SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE json(props)::VARCHAR END AS json_text FROM events")
def json_canonical_text(spark, sf_dir):
    """SCL3, SCL4: compact JSON text with sorted keys."""
    return table(spark, sf_dir, "events").select("event_id", text.canonical_json(F.col("props")).alias("json_text"))


@query(
    """SELECT name, kind, count(*) AS n FROM (SELECT name, CASE json_type(props, '$."' || name || '"') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool'
  WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind
  FROM (SELECT props, unnest(json_keys(props)) AS name FROM events WHERE json_type(props) = 'OBJECT')) GROUP BY ALL"""
)
def json_key_census(spark, sf_dir):
    """AGG7, SCL9: top-level fields and their types."""
    return aggregate.key_census(table(spark, sf_dir, "events"), "props")


# ---------------------------------------------------------------- validation

#: Columns broken in turn, by pos modulo 14.
_BROKEN = {
    "op": "CASE pos % 14 WHEN 8 THEN 'insert' WHEN 13 THEN 'delete' ELSE op END",
    "after_json": "CASE pos % 14 WHEN 0 THEN '{}' WHEN 1 THEN NULL WHEN 13 THEN NULL ELSE coalesce(after_json, '{}') END",
    "table_id": "CASE pos % 14 WHEN 2 THEN '  ' ELSE table_id END",
    "source_id": "CASE pos % 14 WHEN 3 THEN '' ELSE source_id END",
    "ordering_field": "CASE pos % 14 WHEN 4 THEN ' ' ELSE ordering_field END",
    "source_checkpoint": "CASE pos % 14 WHEN 5 THEN '' ELSE source_checkpoint END",
    "schema_version": "CASE pos % 14 WHEN 6 THEN 0 ELSE schema_version END",
    "source_event_id": "CASE pos % 14 WHEN 7 THEN ' ' WHEN 12 THEN NULL ELSE source_event_id END",
    "table_mode": "CASE pos % 14 WHEN 9 THEN 'append_only' ELSE table_mode END",
}


@query(
    f"""WITH {E}, V AS (SELECT pos AS event_id, pos % 14 AS k, {', '.join(f"{v} AS {k}" for k, v in _BROKEN.items() if k != 'op')},
  CASE WHEN pos % 14 = 0 THEN 'delete' WHEN pos % 14 = 8 THEN 'insert' WHEN pos % 14 = 13 THEN 'delete' ELSE 'upsert' END AS op FROM E)
  SELECT event_id, CASE WHEN op = 'delete' AND after_json IS NOT NULL THEN 'delete requires after=null' WHEN op <> 'delete' AND after_json IS NULL THEN 'insert/upsert require after payload'
  WHEN trim(table_id) = '' THEN 'table_id is required' WHEN trim(source_id) = '' THEN 'source_id is required' WHEN trim(ordering_field) = '' THEN 'ordering_field is required'
  WHEN trim(source_checkpoint) = '' THEN 'source_checkpoint is required' WHEN schema_version <= 0 THEN 'schema_version must be positive'
  WHEN trim(source_event_id) = '' THEN 'source_event_id must not be blank' WHEN table_mode = 'append_only' AND op <> 'insert' THEN 'append_only requires insert operations'
  WHEN table_mode = 'keyed_upsert' AND op = 'insert' THEN 'keyed_upsert requires upsert or delete operations' WHEN k = 10 THEN 'keyed_upsert requires a key'
  WHEN k = 11 THEN 'key names must be unique' END AS violation FROM V"""
)
def val_first_violation(spark, sf_dir):
    """VAL1-VAL11: the first broken rule of each row, over rows broken in every way."""
    k = F.col("pos") % 14
    rows = change_log(spark, sf_dir)
    op = F.when(k == 0, "delete").when(k == 8, "insert").when(k == 13, "delete").otherwise("upsert")
    broken = rows.select(
        F.col("pos").alias("event_id"),
        op.alias("op"),
        *[F.expr(v).alias(c) for c, v in _BROKEN.items() if c != "op"],
        F.when(k == 10, F.array().cast("array<string>")).when(k == 11, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("user_id"))).alias("key_names"),
    )
    return broken.select("event_id", validate.first_violation().alias("violation"))


# ---------------------------------------------------------------- normalisation

_MIXED = {"table_id": "CASE WHEN batch_no % 3 = 1 AND pos % 100 = 7 THEN 'other' ELSE table_id END", "schema_version": "CASE WHEN batch_no % 3 = 2 AND pos % 100 = 9 THEN 2 ELSE 1 END"}


@query(
    f"""WITH {E}, M AS (SELECT batch_no, min({_MIXED['table_id']}) <> max({_MIXED['table_id']}) AS t, min({_MIXED['schema_version']}) <> max({_MIXED['schema_version']}) AS v FROM E GROUP BY 1)
  SELECT batch_no, 'table_id' AS column_name FROM M WHERE t UNION ALL SELECT batch_no, 'schema_version' FROM M WHERE v"""
)
def nrm_homogeneity(spark, sf_dir):
    """NRM2: columns that differ within a batch."""
    rows = change_log(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _MIXED.items()})
    return normalize.mismatches(rows, ["batch_no"])


@query(f"WITH {E} SELECT batch_no, min(ordering_value) AS ordering_min, max(ordering_value) AS ordering_max FROM E GROUP BY batch_no")
def nrm_ordering_span(spark, sf_dir):
    """NRM3: spans before any reduction."""
    return normalize.ordering_spans(change_log(spark, sf_dir), ["batch_no"])


@query(
    """SELECT user_id, event_id, ordering_value, prev_value FROM (SELECT user_id, event_id, floor(value)::BIGINT AS ordering_value,
  lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_value FROM events) WHERE ordering_value < prev_value"""
)
def nrm_ordering_violations(spark, sf_dir):
    """NRM5: rows below their predecessor of the same key in arrival order."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("ordering_value"))
    return normalize.ordering_violations(rows, ["user_id"], position="event_id")


@query(f"WITH {E}, {LATEST} SELECT user_id, op, after_json, ordering_value, source_checkpoint FROM L")
def nrm_latest_by_key(spark, sf_dir):
    """NRM6: latest state by key."""
    rows = change_log(spark, sf_dir).select("user_id", "op", "after_json", "ordering_value", "source_checkpoint", "pos")
    return normalize.latest_by_key(rows, ["user_id"]).drop("pos")


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 100 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def nrm_latest_tie_break(spark, sf_dir):
    """NRM6: of equal orderings the later arrival wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.expr("event_id div 100").alias("o"))
    return normalize.latest_by_key(rows, ["user_id"], "o", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def nrm_append_only_order(spark, sf_dir):
    """NRM7: append-only rows are all kept, numbered in order without one task seeing all rows."""
    return _numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 4096)


def _numbered(rows, key, width):
    """Row numbers by a whole-number key: ranges of the key are counted first, then numbered each by itself."""
    from pyspark.sql import Window

    ranged = rows.withColumn("_range", F.expr(f"{key} div {width}"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # a range's rows number far fewer than its rows' own: groups of ranges first, then ranges within a group
    grouped = counts.withColumn("_group", F.expr("_range div 1024"))
    group = grouped.groupBy("_group").agg(F.sum("n").alias("n"))
    before_group = group.withColumn("gb", F.coalesce(F.sum("n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = grouped.withColumn("rb", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before_group, "_group").select("_range", (F.col("gb") + F.col("rb")).alias("before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_place", place).join(before, "_range").select(*rows.columns, (F.col("_place") + F.col("before")).cast("long").alias("pos"))


# ---------------------------------------------------------------- aggregates, hashes, manifests


@query(f"WITH {E} SELECT batch_no, op, count(*) AS n FROM E GROUP BY ALL")
def agg_op_counts(spark, sf_dir):
    """AGG1, AGG2, AGG3: rows by operation and batch."""
    return aggregate.op_counts(change_log(spark, sf_dir), ["batch_no"])


_SIGNATURE = """concat_ws('|', table_id, source_id, op, key_json, coalesce(after_json, 'null'), coalesce(before_json, 'null'), ordering_field, ordering_value::VARCHAR, source_checkpoint, source_metadata_json)"""


@query(f"WITH {E} SELECT batch_no, greatest(1, sum(strlen({_SIGNATURE}))::BIGINT // count(*)) AS avg_bytes FROM E GROUP BY batch_no")
def agg_avg_record_bytes(spark, sf_dir):
    """AGG4, SCL8: mean signature length in bytes."""
    return aggregate.average_record_bytes(change_log(spark, sf_dir), ["batch_no"])


@query("SELECT user_id, round(quantile_cont(value, 0.95), 6) AS p FROM events GROUP BY user_id")
def bench_p95(spark, sf_dir):
    """AGG11: 95th percentile with linear interpolation, to six places, where no interpolated value lies on a half."""
    return aggregate.percentile_ms(table(spark, sf_dir, "events"), ["user_id"], "value", places=6)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ALL")
def agg_row_totals(spark, sf_dir):
    """AGG13, AGG14, DST2: totals and distinct counts over a large table."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.sum("l_quantity").cast("long").alias("quantity"))
    )


@query("SELECT batch_no, n, round(n / (span_s), 6) AS rows_per_second FROM (SELECT event_id // 100 AS batch_no, count(*) AS n, greatest(1, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT) AS span_s FROM events GROUP BY 1)")
def bench_throughput(spark, sf_dir):
    """AGG12, BEN3: rows by elapsed seconds of each batch."""
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("batch_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    span = F.greatest(F.lit(1).cast("long"), F.round(F.max("us") / 1e6).cast("long") - F.round(F.min("us") / 1e6).cast("long"))
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), span.alias("span_s")).select("batch_no", "n", F.round(F.col("n") / F.col("span_s"), 6).alias("rows_per_second"))


@query(fnv_sql("hex(encode(event_type || ':' || event_id))", "events", "event_id"))
def hash_fnv1a(spark, sf_dir):
    """SCL2: 64-bit FNV-1a of a text's bytes."""
    data = F.concat_ws(":", "event_type", F.col("event_id").cast("string")).cast("binary")
    return table(spark, sf_dir, "events").select("event_id", hashing.fnv1a64(data).alias("hash"))


@query(fnv_sql("hex(encode(o_orderstatus)) || 'FF' || hex(encode(o_orderpriority)) || 'FF' || hex(encode(o_orderkey::VARCHAR)) || 'FF'", "orders", "o_orderkey"))
def hash_multi_part(spark, sf_dir):
    """SCL1, SCL24: hash of several parts, byte 255 after each."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.stable_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("hash"))


@query(
    f"""SELECT s_suppkey, 'snapshot-' || hash AS snapshot_id, 'file:///lake/' || s_nationkey || '/snapshots/snapshot-' || hash AS snapshot_uri,
  'file:///lake/' || s_nationkey || '::' || 'batch-' || s_suppkey || ':1' AS scoped_key FROM ({fnv_sql(
      "hex(encode('batch-' || s_suppkey)) || 'FF' || hex(encode('file:///lake/' || s_nationkey)) || 'FF' || hex(encode('batch-' || s_suppkey || ':1')) || 'FF' || hex(encode(s_name)) || 'FF' || hex(encode('fp')) || 'FF'",
      'supplier', 's_suppkey, s_nationkey')})"""
)
def commit_snapshot_ids(spark, sf_dir):
    """SCL16, SCL17, SCL25, CMT1: snapshot ids and scoped keys of a canonical destination."""
    destination = text.trim_trailing_slash(F.concat(F.lit("file:///lake/"), F.col("s_nationkey").cast("string"), F.lit("//")))
    batch = F.concat(F.lit("batch-"), F.col("s_suppkey").cast("string"))
    key = F.concat(batch, F.lit(":1"))
    snapshot = text.snapshot_id(batch, destination, key, F.col("s_name"), F.lit("fp"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", snapshot.alias("snapshot_id"), F.concat(destination, F.lit("/snapshots/"), snapshot).alias("snapshot_uri"), text.scoped_commit_key(destination, key).alias("scoped_key")
    )


@query(
    f"""WITH {E} SELECT batch_no, part FROM (SELECT DISTINCT batch_no, part FROM (SELECT batch_no, 'key:user_id:number' AS part FROM E
  UNION ALL SELECT batch_no, unnest(['after:event_id:number', 'after:event_type:string']) FROM E WHERE after_json IS NOT NULL))"""
)
def schema_fingerprint_parts(spark, sf_dir):
    """AGG7, SRT2: the distinct typed fields of keys and payloads of each batch."""
    return aggregate.fingerprint_parts(change_log(spark, sf_dir), ["batch_no"]).select("batch_no", F.explode("parts").alias("part"))


@query(
    f"""WITH {E} SELECT batch_no, hash AS schema_fingerprint FROM ({fnv_sql(
        "(CASE WHEN a THEN hex(encode('after:event_id:number')) || 'FF' || hex(encode('after:event_type:string')) || 'FF' ELSE '' END) || hex(encode('key:user_id:number')) || 'FF'",
        '(SELECT batch_no, bool_or(after_json IS NOT NULL) AS a FROM E GROUP BY batch_no)', 'batch_no')})"""
)
def schema_fingerprint(spark, sf_dir):
    """AGG7: the hash of the sorted parts."""
    return aggregate.schema_fingerprints(change_log(spark, sf_dir), ["batch_no"])


@query(
    f"""WITH {E}, R AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_no, user_id ORDER BY ordering_value DESC, pos DESC) AS rn FROM E) WHERE rn = 1),
  S AS (SELECT batch_no, min(ordering_value) AS ordering_min, max(ordering_value) AS ordering_max, arg_min(source_checkpoint, pos) AS checkpoint_start,
    arg_max(source_checkpoint, pos) AS checkpoint_end FROM E GROUP BY batch_no)
  SELECT batch_no, count(*) AS record_count, count(*) FILTER (op = 'upsert') AS upserts, count(*) FILTER (op = 'delete') AS deletes, any_value(ordering_min) AS ordering_min,
    any_value(ordering_max) AS ordering_max, any_value(checkpoint_start) AS checkpoint_start, any_value(checkpoint_end) AS checkpoint_end FROM R JOIN S USING (batch_no) GROUP BY batch_no"""
)
def manifest_stats(spark, sf_dir):
    """MAN4, AGG1, AGG2, NRM3, NRM4: counts after reduction, spans before it."""
    rows = change_log(spark, sf_dir).select("batch_no", "user_id", "op", "ordering_value", "source_checkpoint", "pos")
    # one grouping by batch and key gives both the latest row and the key's part of the spans
    by_key = rows.groupBy("batch_no", "user_id").agg(
        F.max_by("op", F.struct("ordering_value", "pos")).alias("op"),
        F.min("ordering_value").alias("low"),
        F.max("ordering_value").alias("high"),
        F.min(F.struct("pos", "source_checkpoint")).alias("first"),
        F.max(F.struct("pos", "source_checkpoint")).alias("last"),
    )
    return by_key.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("op") == "upsert").alias("upserts"),
        F.count_if(F.col("op") == "delete").alias("deletes"),
        F.min("low").alias("ordering_min"),
        F.max("high").alias("ordering_max"),
        F.min("first")["source_checkpoint"].alias("checkpoint_start"),
        F.max("last")["source_checkpoint"].alias("checkpoint_end"),
    )


@query(
    f"""SELECT o_custkey, hash FROM ({fnv_sql("array_to_string(list_transform(parts, lambda p: hex(encode(p)) || 'FF'), '')",
      "(SELECT o_custkey, list_sort(list('file-' || o_orderkey || ':' || o_orderstatus)) AS parts FROM orders GROUP BY o_custkey)", 'o_custkey')})"""
)
def manifest_replay_identity(spark, sf_dir):
    """MAN1, MAN2, MAN3, SRT3: a hash over sorted file parts, so their order doesn't count."""
    part = F.concat(F.lit("file-"), F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus")
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return files.select("o_custkey", hashing.stable_hash_array(F.col("parts")).alias("hash"))


@query("SELECT l_shipmonth, chunk, count(*) AS rows FROM (SELECT date_trunc('month', l_shipdate)::DATE AS l_shipmonth, (row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY l_orderkey, l_linenumber) - 1) // 500 AS chunk FROM lineitem) GROUP BY ALL")
def chunk_plan(spark, sf_dir):
    """SNK4, LIM1, CHK1, CHK2: rows of a batch in order, cut into files of 500."""
    rows = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("l_shipmonth"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return reconcile.chunk_sizes(rows, ["l_shipmonth"], 500)


# ---------------------------------------------------------------- upserts

_BATCHED = """R AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ordering_value DESC, pos DESC) AS rn FROM E WHERE {0}) WHERE rn = 1)"""
_LAST = "batch_no = (SELECT max(batch_no) FROM E)"


def _last_batch(rows):
    last = rows.agg(F.max("batch_no").alias("_last"))
    return rows.join(F.broadcast(last), F.col("batch_no") == F.col("_last")).drop("_last")


def _reduced(rows):
    return normalize.latest_by_key(rows.select("user_id", "op", "after_json", "ordering_value", "pos", "table_mode"), ["user_id"])


@query(f"WITH {E}, {_BATCHED.format(_LAST)} SELECT user_id FROM R")
def upsert_equality_delete_keys(spark, sf_dir):
    """PRJ2, CMT6: the keys that a batch touches."""
    return upsert.delete_keys(_reduced(_last_batch(change_log(spark, sf_dir))), ["user_id"])


@query(f"WITH {E}, {_BATCHED.format(_LAST)} SELECT user_id, after_json, ordering_value FROM R WHERE op <> 'delete'")
def upsert_append_rows(spark, sf_dir):
    """FLT2, FLT4, CMT6: the rows that a batch appends."""
    return upsert.append_rows(_reduced(_last_batch(change_log(spark, sf_dir)))).select("user_id", "after_json", "ordering_value")


_BASE = "B AS (SELECT c_custkey AS user_id, '{\"base\":1}' AS after_json, -1::BIGINT AS ordering_value FROM customer)"
_MERGED = """SELECT * FROM B WHERE user_id NOT IN (SELECT user_id FROM R) UNION ALL SELECT user_id, after_json, ordering_value FROM R WHERE op <> 'delete'"""


def _base(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit('{"base":1}').alias("after_json"), F.lit(-1).cast("long").alias("ordering_value"))


@query(f"WITH {E}, {_BATCHED.format(_LAST)}, {_BASE} {_MERGED}")
def upsert_apply_merge(spark, sf_dir):
    """JON5: a base table after a batch."""
    return upsert.merge(_base(spark, sf_dir), _reduced(_last_batch(change_log(spark, sf_dir))), ["user_id"])


@query(f"WITH {E}, {_BATCHED.format(_LAST)}, {_BASE} {_MERGED}")
def upsert_replay_idempotent(spark, sf_dir):
    """CMT2: a batch applied twice gives what it gives once."""
    batch = _reduced(_last_batch(change_log(spark, sf_dir)))
    return upsert.merge(upsert.merge(_base(spark, sf_dir), batch, ["user_id"]), batch, ["user_id"])


@query(f"WITH {E}, {LATEST} SELECT user_id, after_json, ordering_value FROM L WHERE op <> 'delete'")
def upsert_final_state(spark, sf_dir):
    """NRM6, JON5: all batches folded are the global latest state without deletes."""
    return normalize.apply_deletes(_reduced(change_log(spark, sf_dir))).select("user_id", "after_json", "ordering_value")


# ---------------------------------------------------------------- ledger

_STATUSES = ("registered", "files_written", "commit_started", "commit_uncertain", "committed", "checkpointed", "quarantined", "failed_terminal")
_ATTEMPTS = ("started", "resolving", "unknown", "committed", "rejected")


def _pick(words, expression: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


_BATCHES_COLUMNS = f"""'batch-' || o_orderkey AS batch_id, 'table-' || (o_custkey % 20) AS table_id, {_pick(_STATUSES, '(o_orderkey + o_custkey) % 8')} AS batch_status,
  CAST(o_orderkey % 97 AS BIGINT) AS created_secs, CAST(o_custkey % 5 AS BIGINT) AS created_nanos, o_orderkey AS batch_seq"""
BATCHES = f"batches AS (SELECT {_BATCHES_COLUMNS} FROM orders)"
_ATTEMPT_COLUMNS = f"'batch-' || (l_orderkey * 3) AS batch_id, CAST(l_linenumber AS BIGINT) AS attempt_no, {_pick(_ATTEMPTS, '(l_partkey + l_linenumber) % 5')} AS attempt_status"
ATTEMPTS = f"attempts AS (SELECT {_ATTEMPT_COLUMNS} FROM lineitem)"  # batches whose number is no multiple of 3 have none


def _batches(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _split(_BATCHES_COLUMNS)])


def _attempts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[x.strip() for x in _split(_ATTEMPT_COLUMNS)])


def _split(columns: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    f"""WITH {BATCHES}, {ATTEMPTS} SELECT DISTINCT b.batch_id FROM batches b LEFT JOIN attempts a ON a.batch_id = b.batch_id
  WHERE b.batch_status IN ({_quoted(RECOVERABLE_BATCH)}) OR a.attempt_status IN ({_quoted(RECOVERABLE_ATTEMPT)})"""
)
def led_recovery_candidates(spark, sf_dir):
    """LED9, JON1, FLT3, DST1, SRT7: batches that ask for recovery."""
    return reconcile.recovery_candidates(_batches(spark, sf_dir), _attempts(spark, sf_dir))


_FILES = "files AS (SELECT 'batch-' || l_orderkey AS batch_id, 'file:///f/' || l_orderkey || '-' || l_linenumber AS file_uri, CAST(l_quantity AS BIGINT) AS file_size_bytes FROM lineitem)"
_CLEANUPS = "cleanups AS (SELECT 'batch-' || l_orderkey AS batch_id, 'file:///f/' || l_orderkey || '-' || l_linenumber AS file_uri FROM lineitem WHERE l_partkey % 2 = 0)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'batch-' || l_orderkey AS batch_id", "'file:///f/' || l_orderkey || '-' || l_linenumber AS file_uri", "CAST(l_quantity AS BIGINT) AS file_size_bytes", "l_partkey"
    )


@query(
    f"""WITH {BATCHES}, {_FILES}, {_CLEANUPS} SELECT f.batch_id, f.file_uri, f.file_size_bytes FROM files f JOIN batches b ON b.batch_id = f.batch_id
  LEFT JOIN cleanups c ON c.batch_id = f.batch_id AND c.file_uri = f.file_uri WHERE b.batch_status = 'quarantined' AND c.file_uri IS NULL"""
)
def led_orphan_candidates(spark, sf_dir):
    """LED10, JON2, JON3: files of quarantined batches that no cleanup names."""
    files = _files(spark, sf_dir)
    cleanups = files.filter("l_partkey % 2 = 0").select("batch_id", "file_uri")
    return reconcile.orphan_candidates(files.drop("l_partkey"), _batches(spark, sf_dir), cleanups)


_LINKS = """links AS (SELECT 'batch-' || o_orderkey AS batch_id, 'source-' || (o_custkey % 3) AS source_id, 'cp-' || lpad(o_orderkey::VARCHAR, 10, '0') AS checkpoint_id,
  CASE WHEN o_orderstatus = 'O' THEN 'durable' ELSE 'pending' END AS ack_status, o_orderkey AS link_seq FROM orders)"""


def _links(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "'batch-' || o_orderkey AS batch_id",
        "'source-' || (o_custkey % 3) AS source_id",
        "'cp-' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS checkpoint_id",
        "CASE WHEN o_orderstatus = 'O' THEN 'durable' ELSE 'pending' END AS ack_status",
        "o_orderkey AS link_seq",
    )


@query(
    f"""WITH {BATCHES}, {_LINKS} SELECT table_id, source_id, checkpoint_id FROM (SELECT b.table_id, l.source_id, l.checkpoint_id, row_number() OVER (PARTITION BY b.table_id
  ORDER BY created_secs DESC, created_nanos DESC, batch_seq DESC, link_seq DESC) AS rn FROM links l JOIN batches b USING (batch_id) WHERE ack_status = 'durable') WHERE rn = 1"""
)
def led_last_durable_checkpoint(spark, sf_dir):
    """LED7, JON4, LIM2, SRT8: the newest durable checkpoint of each table."""
    return reconcile.last_durable_checkpoints(_links(spark, sf_dir), _batches(spark, sf_dir))


@query(
    f"""WITH {BATCHES}, {_LINKS} SELECT l.source_id, l.checkpoint_id FROM links l JOIN batches b USING (batch_id) WHERE ack_status = 'durable' AND table_id = 'table-7'
  ORDER BY created_secs DESC, created_nanos DESC, batch_seq DESC, link_seq DESC LIMIT 1"""
)
def led_last_durable_checkpoint_of_table(spark, sf_dir):
    """LED7, LIM2: the same of one table, as a top-one plan."""
    return reconcile.last_durable_checkpoint(_links(spark, sf_dir), _batches(spark, sf_dir), "table-7")


@query(f"WITH {BATCHES}, {ATTEMPTS} SELECT b.batch_id, coalesce(max(attempt_no), 0) + 1 AS next_attempt_no FROM batches b LEFT JOIN attempts a ON a.batch_id = b.batch_id GROUP BY b.batch_id")
def led_next_attempt_no(spark, sf_dir):
    """AGG8, LED3: one more than the greatest attempt of each batch."""
    return reconcile.next_attempt_numbers(_batches(spark, sf_dir), _attempts(spark, sf_dir))


_RESOLUTION_VALUES = ", ".join(f"('{k}', '{a}', '{b}', {'NULL' if q is None else repr(q)})" for k, (a, b, q) in RESOLUTIONS.items())


@query(
    f"""SELECT o_orderkey, r.attempt_status, r.batch_status, r.quarantine_reason FROM (SELECT o_orderkey, {_pick(list(RESOLUTIONS), 'o_orderkey % 6')} AS resolution FROM orders)
  JOIN (VALUES {_RESOLUTION_VALUES}) r(resolution, attempt_status, batch_status, quarantine_reason) USING (resolution)"""
)
def led_resolution_mapping(spark, sf_dir):
    """LED4, SCL21: what each resolution makes of attempt and batch."""
    attempts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_pick(list(RESOLUTIONS), 'o_orderkey % 6')} AS resolution")
    return reconcile.resolve(attempts).select("o_orderkey", "attempt_status", "batch_status", "quarantine_reason")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def led_first_wins(spark, sf_dir):
    """SET4, LED1: a second registration keeps the first row."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return reconcile.first_wins(rows.withColumn("o", F.col("o_orderkey")), ["o_custkey"], "o").drop("o")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def led_last_wins(spark, sf_dir):
    """SET4, LED2, LED11: a second record replaces the first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return reconcile.last_wins(rows.withColumn("o", F.col("o_orderkey")), ["o_custkey"], "o").drop("o")


@query(f"WITH {BATCHES} SELECT batch_status, count(*) AS n, count(DISTINCT table_id) AS tables FROM batches GROUP BY batch_status")
def led_status_census(spark, sf_dir):
    """LED12, LED13: batches by status."""
    return _batches(spark, sf_dir).groupBy("batch_status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("table_id").alias("tables"))


# ---------------------------------------------------------------- commits and compaction


@query(
    """SELECT idempotency_key, count(DISTINCT destination) AS destinations FROM (SELECT 'key-' || o_custkey || '-' || (o_orderkey % 7) AS idempotency_key,
  'dest-' || (o_orderkey % 3) AS destination FROM orders) GROUP BY idempotency_key HAVING count(DISTINCT destination) > 1"""
)
def cmt_lookup_ambiguous(spark, sf_dir):
    """JON7, CMT3, DST3: keys with commits in several destinations."""
    commits = table(spark, sf_dir, "orders").selectExpr("'key-' || o_custkey || '-' || (o_orderkey % 7) AS idempotency_key", "'dest-' || (o_orderkey % 3) AS destination")
    return reconcile.ambiguous_keys(commits)


@query(
    """SELECT scoped_key, CASE WHEN n = 0 THEN 'not_committed' WHEN n = 1 THEN 'committed' ELSE 'ambiguous' END AS resolution FROM
  (SELECT 'd' || (o_custkey % 4) || '::key-' || o_orderkey AS scoped_key, count(DISTINCT l_linestatus) AS n FROM orders LEFT JOIN lineitem ON l_orderkey * 2 = o_orderkey GROUP BY o_orderkey, o_custkey)"""
)
def cmt_resolve_uncertain(spark, sf_dir):
    """CMT4, CMT5: committed, not committed or ambiguous by what a scoped key finds."""
    found = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("committed_key")).agg(F.count_distinct("l_linestatus").alias("n"))
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'d' || (o_custkey % 4) || '::key-' || o_orderkey AS scoped_key")
    n = F.coalesce("n", F.lit(0))
    return asked.join(found, F.col("o_orderkey") == F.col("committed_key"), "left").select(
        "scoped_key", F.when(n == 0, "not_committed").when(n == 1, "committed").otherwise("ambiguous").alias("resolution")
    )


# ---------------------------------------------------------------- the engine itself, from files to the ledger


def _scratch(spark) -> str:
    """A new folder in the shared checkpoint folder (or below the warehouse where that is unset); it goes with the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    files, path = Files(spark), f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    files.passing(path)
    return path


def _lines(spark, sf_dir, folder: str) -> None:
    """The change log as JSON lines in batch files of a hundred batches each; one record of each file in an odd but right form."""
    rows = change_log(spark, sf_dir).withColumn("file", F.expr("batch_no div 100"))
    line = F.concat(
        F.lit('{"ordering_value":'), F.when(F.col("pos") % 1000 == 5, F.concat(F.lit('"'), "ordering_value", F.lit('"'))).otherwise(F.col("ordering_value").cast("string")),
        F.lit(',"op":"'), "op", F.lit('","key":'), "key_json", F.lit(',"after":'), F.coalesce("after_json", F.lit("null")), F.lit(',"source_event_id":"'), "source_event_id",
        F.lit('","source_checkpoint":"'), "source_checkpoint", F.lit('","schema_version":1,"ingestion_ts":'), F.unix_seconds(F.col("ingestion_ts").cast("timestamp")).cast("string"), F.lit("}"),
    )
    made = rows.select("file", "pos", line.alias("line")).repartition("file").sortWithinPartitions("file", "pos")
    made.select("file", "line").write.partitionBy("file").text(f"{folder}/made")
    files = Files(spark)
    for i, path in enumerate(files.glob(f"{folder}/made/file=*/part-*")):  # a file for ten thousand records
        number = path.rsplit("file=", 1)[-1].split("/")[0]
        files.move(path, f"{folder}/customer_state/batch-{int(number):06d}.jsonl")


@query(
    f"""WITH {E} SELECT 'customer_state' AS table_id, 'file.customer_state' AS source_id, op, key_json, after_json, ordering_value, source_checkpoint, source_event_id,
  make_timestamp((epoch_us(ingestion_ts) // 1000000) * 1000000) AS ingestion_ts FROM E"""
)
def src_jsonl_roundtrip(spark, sf_dir):
    """SRC1-SRC4, SRC11, SRC13, VAL12-VAL15: records written as JSON lines, captured and decoded by the file source."""
    folder = _scratch(spark)
    _lines(spark, sf_dir, folder)
    session = FileSource(spark, f"{folder}/customer_state").open_capture(Selection("customer_state", "customer_state", "keyed_upsert"))
    group = session.poll_group()  # one scan of all files: a plan of a scan for each would grow with them
    out = group.rows if group else spark.createDataFrame([], LANDED)
    return out.select("table_id", "source_id", "op", "key_json", "after_json", "ordering_value", "source_checkpoint", "source_event_id", "ingestion_ts")


@query(
    f"""WITH {E}, R AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_json, batch_no // 100 ORDER BY ordering_value DESC, pos DESC) AS rn FROM E) WHERE rn = 1),
  S AS (SELECT batch_no // 100 AS f, min(ordering_value) AS ordering_min, max(ordering_value) AS ordering_max, arg_min(source_checkpoint, pos) AS a, arg_max(source_checkpoint, pos) AS b FROM E GROUP BY 1)
  SELECT 'customer_state.batch-' || lpad(f::VARCHAR, 6, '0') AS batch_id, count(*) AS record_count, count(*) FILTER (op = 'upsert') AS upserts, count(*) FILTER (op = 'delete') AS deletes,
    any_value(ordering_min) AS ordering_min, any_value(ordering_max) AS ordering_max, any_value(a) AS checkpoint_start, any_value(b) AS checkpoint_end, 'checkpointed' AS batch_status,
    'committed' AS attempt_status, any_value(b) AS checkpoint_id, 'durable' AS ack_status FROM R JOIN S ON f = batch_no // 100 GROUP BY f"""
)
def run_to_durable_checkpoints(spark, sf_dir):
    """MAN1-MAN4, CMT1-CMT5, LED1-LED3, LED5-LED7, NRM1-NRM6, STR1, STR2, STR7, STR8: a whole run over JSON lines, as the ledger and the manifests tell it.

    The first commit's acknowledgement is lost, so it is resolved by asking the sink; every batch is then committed a
    second time, which changes nothing.
    """
    folder = _scratch(spark)
    _lines(spark, sf_dir, folder)
    source, sink, ledger = FileSource(spark, f"{folder}/customer_state"), MemorySink("lose_ack"), Ledger()
    run_session(source.open_capture(Selection("customer_state", "customer_state", "keyed_upsert")), sink, ledger, f"{folder}/staging", f"{folder}/lake")
    manifests = ledger.manifests()
    for m in manifests:
        again = sink.prepare_commit(CommitRequest(m.batch_id, m.table_mode, f"{folder}/lake", f"{m.batch_id}:1", m))
        assert sink.commit(again).replay_identity == m.replay_identity() and sink.lookup_commit(f"{m.batch_id}:1")
    told = spark.createDataFrame(
        [(m.batch_id, m.record_count, m.op_counts.get("upsert", 0), m.op_counts.get("delete", 0), m.ordering_min, m.ordering_max, m.source_checkpoint_start, m.source_checkpoint_end) for m in manifests],
        "batch_id string, record_count long, upserts long, deletes long, ordering_min long, ordering_max long, checkpoint_start string, checkpoint_end string",
    )
    frames = ledger.frames(spark)
    ledger.close()
    found = told.join(frames["batches"].select("batch_id", "batch_status"), "batch_id").join(frames["attempts"].select("batch_id", "attempt_status"), "batch_id")
    return found.join(frames["links"].select("batch_id", "checkpoint_id", "ack_status"), "batch_id")


@query(
    """SELECT 'batch-' || n_nationkey AS batch_id, CASE n_nationkey % 5 WHEN 0 THEN 'registered' WHEN 1 THEN 'committed' WHEN 2 THEN 'commit_uncertain' WHEN 3 THEN 'schema_revalidating' ELSE 'quarantined' END AS batch_status,
  n_nationkey % 5 > 1 AS recover, CASE WHEN n_nationkey % 5 = 4 THEN 1 ELSE 0 END AS orphans, CASE n_nationkey % 5 WHEN 0 THEN 1 ELSE 2 END AS next_attempt_no FROM nation"""
)
def led_store_path(spark, sf_dir):
    """LED1-LED4, LED8-LED13, AGG8: the store driven through every resolution, then asked by the plans."""
    ledger, words = Ledger(), {1: "committed", 2: "unknown", 3: "rejected", 4: "ambiguous"}
    for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect():  # twenty-five nations
        k = r["n_nationkey"]
        files = tuple(ManifestFile(f"file:///f/{k}-{i}", "data", f"h{i}", 10, 1) for i in range(2))
        m = BatchManifest(f"batch-{k}", f"table-{k % 3}", "append_only", "s", "file_or_object_drop", "a", "b", "f", 1, 2, 1, "fp", 2, {"insert": 2}, "c", files, f"{k}:000000000")
        ledger.register_batch(m)
        ledger.register_batch(m)
        if k % 5:
            ledger.record_files(m.batch_id, m)
            ledger.resolve_commit(ledger.begin_commit(m.batch_id, "d", "snap", "me")["attempt_id"], words[k % 5])
            ledger.record_cleanup(m.batch_id, files[0].file_uri, "deleted")
    f = ledger.frames(spark)
    ledger.close()
    recover = reconcile.recovery_candidates(f["batches"], f["attempts"]).withColumn("recover", F.lit(True))
    orphans = reconcile.orphan_candidates(f["files"], f["batches"], f["cleanups"].drop("action")).groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("orphans"))
    following = reconcile.next_attempt_numbers(f["batches"], f["attempts"]).withColumn("next_attempt_no", F.col("next_attempt_no").cast("int"))
    found = f["batches"].join(recover, "batch_id", "left").join(orphans, "batch_id", "left").join(following, "batch_id")
    return found.select("batch_id", "batch_status", F.coalesce("recover", F.lit(False)).alias("recover"), F.coalesce("orphans", F.lit(0)).alias("orphans"), "next_attempt_no")


_EVENTS = """ev AS (SELECT 'file-' || (l_partkey % 5000) AS file_uri, CASE WHEN l_suppkey % 3 = 0 THEN 'remove' ELSE 'add' END AS kind, l_orderkey AS sequence,
  CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END AS phase, l_linenumber AS place FROM lineitem)"""


@query(
    f"""WITH {_EVENTS} SELECT file_uri, sequence, phase, place FROM (SELECT *, row_number() OVER (PARTITION BY file_uri ORDER BY sequence DESC, phase DESC, place DESC) AS rn FROM ev)
  WHERE rn = 1 AND kind = 'add'"""
)
def cpt_active_files(spark, sf_dir):
    """CPT3, CPT6, JON6, SET3, SRT5, SRT6: the files left after replaying all records."""
    events = table(spark, sf_dir, "lineitem").selectExpr(
        "'file-' || (l_partkey % 5000) AS file_uri", "CASE WHEN l_suppkey % 3 = 0 THEN 'remove' ELSE 'add' END AS kind", "l_orderkey AS sequence",
        "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END AS phase", "l_linenumber AS place",
    )
    return reconcile.active_files(events)


@query("SELECT file_uri, file_size_bytes FROM (SELECT 'file:///p/' || lpad(p_partkey::VARCHAR, 8, '0') AS file_uri, p_partkey * 7919 % 1000 AS file_size_bytes FROM part) WHERE file_size_bytes < 300 ORDER BY file_uri LIMIT 50")
def cpt_select_candidates(spark, sf_dir):
    """FLT1, SRT1, SRT4, LIM3: the first fifty small files by URI."""
    files = table(spark, sf_dir, "part").selectExpr("'file:///p/' || lpad(CAST(p_partkey AS STRING), 8, '0') AS file_uri", "p_partkey * 7919 % 1000 AS file_size_bytes")
    return reconcile.compaction_candidates(files, 300, 50)


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey % 4, o_orderkey) AS arrival FROM orders")
def cpt_rewrite_rows(spark, sf_dir):
    """CPT1-CPT5, SET1, SRC16-SRC18, AGG5: the files of four folders rewritten by a compaction, row by row in their order of arrival.

    A folder has one file, and so has what the compaction writes, until that is more than a task should sort.
    """
    folder = _scratch(spark)
    orders, files = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), Files(spark)
    made = []
    for k in range(4):
        write_ordered(orders.filter(F.col("o_custkey") % 4 == k), ["o_orderkey"], f"{folder}/data/{k}")
        made += files.glob(f"{folder}/data/{k}/*.parquet")
    files.write(f"{folder}/_snapshots/snapshot-1", "snapshot_id=snapshot-1\n" + "".join(f"file={x}\n" for x in made))
    report = compact(spark, folder, "append_only", 1 << 40, max(100, len(made)), 1 << 40)
    assert report.rewritten == len(made) and report.added >= 1
    left = [r["file_uri"] for r in current_files(spark, folder).collect()]  # the files that the record adds
    rows = arrival_numbers(in_arrival_order(spark, left))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", F.col("_arrival").cast("long").alias("arrival"))


@query("SELECT coalesce(max(try_cast(split_part(name, '-', 1) AS BIGINT)), 0) + 1 AS next_sequence FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END || lpad(o_orderkey::VARCHAR, 6, '0') || '-snapshot.json' AS name FROM orders)")
def cpt_next_sequence(spark, sf_dir):
    """AGG9, SNK10: one more than the greatest numeric prefix."""
    names = table(spark, sf_dir, "orders").selectExpr(
        "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END, CASE WHEN length(o_orderkey) > 6 THEN substring(CAST(o_orderkey AS STRING), 1, 6) ELSE lpad(CAST(o_orderkey AS STRING), 6, '0') END, '-snapshot.json') AS name"
    )
    return reconcile.next_sequence(names)


# ---------------------------------------------------------------- schema policy, gates, texts


@query(schema_policy.ORACLE)
def sch_policy_decisions(spark, sf_dir):
    """SCH1-SCH4: allow or quarantine for a table of schema changes."""
    return schema_policy.decisions(*schema_policy.example_changes(spark))


@query(gates.ORACLE)
def gate_admission_trace(spark, sf_dir):
    """STR3, STR4, STR5: admission and checkpoint decisions over all small budgets."""
    return gates.decisions(spark)


@query(
    """SELECT c_custkey, 'tenant_id=String("t' || c_nationkey || '")|customer_id=Number(' || c_custkey || ')|segment=' ||
  CASE WHEN c_mktsegment IS NULL THEN 'Null' ELSE 'String("' || c_mktsegment || '")' END AS identity FROM customer"""
)
def key_identity_text(spark, sf_dir):
    """SCL10: identity texts, in which 1 and "1" differ."""
    tenant = F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))
    parts = [("tenant_id", tenant, "String"), ("customer_id", F.col("c_custkey"), "Number"), ("segment", F.col("c_mktsegment"), "String")]
    return table(spark, sf_dir, "customer").select("c_custkey", text.key_identity(parts).alias("identity"))


@query(
    r"""SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), ''), 'batch') AS name, coalesce(nullif(regexp_replace(
  array_extract(string_split(url, '/'), -1), '^(.+)\.[^.]*$', '\1'), ''), 'batch-h') AS batch_id FROM pages"""
)
def text_sanitize(spark, sf_dir):
    """SCL13, SCL14, SCL15: safe names and batch ids from labels."""
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_identifier(F.col("url")).alias("name"), text.batch_id(F.col("url"), F.lit("h")).alias("batch_id"))


@query("SELECT event_id, epoch_us(ts) // 1000000 || ':' || lpad(((epoch_us(ts) % 1000000) * 1000)::VARCHAR, 9, '0') AS encoded, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ingested FROM events")
def time_encoding(spark, sf_dir):
    """SCL11, SCL12: seconds and nanoseconds as text; whole seconds back to a time."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", text.seconds_and_nanos(F.col("ts")).alias("encoded"), text.ingestion_time(seconds).alias("ingested"))


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":"' || n || '"', ',' ORDER BY event_type) || '}' AS metadata FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def metadata_json(spark, sf_dir):
    """SCL5, SCL6, SCL7: a string map as JSON with sorted keys."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    gathered = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return gathered.select("user_id", text.sorted_map_json(F.col("m")).alias("metadata"))
