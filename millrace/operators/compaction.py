"""Compaction of small files of append-only tables: replay of records, selection, rewrite, record."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, NumericType, StringType

from ..functions.hashing import stable_hash_text
from ..functions.text import sanitize_output_component
from ..model import ContractError
from ..sources.files import Files
from .reconcile import active_files, compaction_candidates, next_sequence
from .writer import rows_for_target

#: Bytes of rows in memory that one task sorts for a file; a larger target gives several files.
SORT_BYTES = 128 << 20
#: Bytes of a row in memory besides its fields' own: the sort's pointers and prefix, lengths and null bits.
ROW_BYTES = 40

RECORD = "sequence long, snapshot_id string, removed_files array<string>, added_files array<string>, created_at string"


@dataclass(frozen=True)
class Report:
    rewritten: int
    added: int
    skipped: int
    rows: int
    snapshot_id: str | None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_uri, kind, sequence, phase, place) of the files that snapshots name, in the order of the snapshots' names."""
    lines = spark.read.text(f"{root}/_snapshots", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    files = lines.filter(F.col("text").startswith("file=")).select("name", "line", F.substr("text", F.lit(6)).alias("file_uri"))
    at = F.struct("name", "line")
    return files.groupBy("file_uri").agg(F.max(at).alias("at")).select(
        "file_uri", F.lit("add").alias("kind"), F.lit(0).cast("long").alias("sequence"), F.lit(1).alias("phase"), F.struct(F.col("at.name"), F.col("at.line").cast("long").alias("line")).alias("place")
    )


def record_events(spark: SparkSession, root: str) -> DataFrame:
    """The same of compaction records: a record removes before it adds; sequences count as numbers."""
    records = spark.read.schema(RECORD).json(f"{root}/_compactions", multiLine=True)

    def events(column: str, kind: str, phase: int):
        each = records.select("sequence", F.posexplode(column).alias("line", "file_uri"))
        place = F.struct(F.lit("").alias("name"), F.col("line").cast("long").alias("line"))
        return each.select("file_uri", F.lit(kind).alias("kind"), "sequence", F.lit(phase).alias("phase"), place.alias("place"))

    return events("removed_files", "remove", 0).unionByName(events("added_files", "add", 1))


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """Active files in their order."""
    files = Files(spark)
    if not files.exists(f"{root}/_snapshots"):
        raise ContractError(f"no snapshots below {root}")
    events = snapshot_files(spark, root)
    if files.exists(f"{root}/_compactions"):
        events = events.unionByName(record_events(spark, root))
    return active_files(events).orderBy("sequence", "phase", "place").select("file_uri")


def in_arrival_order(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """The rows of files with their arrival order: _file, the file's place among ``inputs``, and _row, the place in the file."""
    plain = lambda uri: re.sub(r"^([a-z0-9]+):/+", r"\1:/", uri)
    places = spark.createDataFrame([(plain(u), i) for i, u in enumerate(inputs)], "_uri string, _file int")
    uri = F.regexp_replace(F.col("_metadata.file_path"), r"^([a-z0-9]+):/+", "$1:/")
    rows = spark.read.parquet(*inputs).select("*", uri.alias("_uri"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(places), "_uri").drop("_uri")  # a row for each input file


def row_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row in memory: 8 for each field, and the texts of those that have no fixed width."""
    wide = [f for f in rows.schema if not isinstance(f.dataType, (NumericType, DatetimeType, BooleanType))]
    texts = [F.coalesce(F.octet_length(f.name if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(f.name))), F.lit(0)) for f in wide]
    return sum((t.cast("long") for t in texts), F.lit(8 * len(rows.schema) + ROW_BYTES).cast("long"))


def write_ordered(rows: DataFrame, order: list[str], path: str, most: int | None = None) -> None:
    """Rows in order into files in the order of their names; a task sorts about SORT_BYTES, and a file has ``most`` rows at most."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(rows)).alias("size")).first()
    n, per_file = found["n"], rows_for_target(SORT_BYTES, (found["size"] or 0) // max(1, found["n"]))
    per_file = min(per_file, most or per_file)
    pieces = max(1, -(-n // per_file))
    ranged = rows.repartitionByRange(pieces, *order) if pieces > 1 else rows.coalesce(1)
    ranged.sortWithinPartitions(*order).drop("_file", "_row").write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def arrival_numbers(rows: DataFrame) -> DataFrame:
    """Rows of ``in_arrival_order`` with _arrival, their number from one over all files."""
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("_file", before.alias("_before"))), "_file").withColumn("_arrival", F.col("_before") + F.col("_row") + 1).drop("_before")  # a row for each file


def compact(spark: SparkSession, root: str, table_mode: str, small_bytes: int, most_files: int, target_bytes: int, namespace: str | None = None) -> Report:
    """Rewrite the first ``most_files`` small active files by URI into files of about ``target_bytes``, or of what a task can sort.

    Rows keep their order of arrival: that of the files' URIs, then that within a file. Fewer than two candidates change nothing. The record is the boundary; the files it removes stay on disk.
    """
    if table_mode != "append_only":
        raise ContractError("compaction of keyed_upsert tables is not supported in this version")
    root, files = root.rstrip("/"), Files(spark)
    if namespace is not None and not files.exists(f"{root}/_catalog/{namespace}.json"):
        raise ContractError(f"unknown namespace: {namespace}")
    active = [r["file_uri"] for r in current_files(spark, root).collect()]  # a row for each file
    sized = spark.createDataFrame([(u, files.size(u)) for u in active], "file_uri string, file_size_bytes long")
    small = sized.filter(F.col("file_size_bytes") < small_bytes).count()
    chosen = [r.asDict() for r in compaction_candidates(sized, small_bytes, most_files).collect()]
    overflow = small - len(chosen)
    if len(chosen) < 2:
        return Report(0, 0, overflow + len(chosen), 0, None)
    inputs = [r["file_uri"] for r in chosen]
    rows = in_arrival_order(spark, inputs)
    n, size = rows.count(), sum(r["file_size_bytes"] for r in chosen)
    snapshot = "compaction-" + stable_hash_text(*inputs)
    out = f"{root}/data/{sanitize_output_component(snapshot)}"
    per_file = rows_for_target(target_bytes, max(1, size // max(1, n)))
    write_ordered(rows, ["_file", "_row"], out, per_file)
    added = files.glob(f"{out}/*.parquet")
    names = [(p.rsplit("/", 1)[-1],) for p in files.glob(f"{root}/_compactions/*.json")]
    sequence = next_sequence(spark.createDataFrame(names, "name string")).first()["next_sequence"]
    record = {"sequence": sequence, "snapshot_id": snapshot, "removed_files": inputs, "added_files": added, "created_at": datetime.now(UTC).isoformat()}
    files.write(f"{root}/_compactions/{sequence:06d}-{snapshot}.json", json.dumps(record, sort_keys=True))
    return Report(len(inputs), len(added), overflow, n, snapshot)
