"""Change records from folders of ``batch-*.jsonl`` files: scan, strict decoding, capture sessions with resume."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sorted_map_json
from ..model import COLUMNS, OPERATIONS, ContractError
from ..session import ship
from .files import Files

# What the file source can do, and how a folder's name sets its class and mode.
CAPABILITIES = ("append_only", "deterministic_checkpoints", "initial_snapshot", "resume")
KEYED_CAPABILITIES = ("deletes", "keyed_upsert", "stable_latest_wins_ordering")
KEYED_FOLDERS = {"customer_state": ("keyed_upsert", "database_cdc")}
ORDERING_FIELD = "source_position"
LOW, HIGH = -(2**63), 2**63 - 1


def canonical(value) -> str:
    """Compact JSON text with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_float(text):
    raise ValueError(f"unsupported number: {text}")


def parse(text: str):
    """A JSON value of null, booleans, whole numbers of 64 bits, strings and objects; anything else raises."""
    value = json.loads(text, parse_float=_no_float, parse_constant=_no_float)

    def check(x):
        if isinstance(x, list):
            raise ValueError("arrays are not supported")
        if isinstance(x, int) and not isinstance(x, bool) and not LOW <= x <= HIGH:
            raise ValueError("number out of range")
        if isinstance(x, dict):
            for v in x.values():
                check(v)

    check(value)
    return value


def _whole(record: dict, name: str) -> int:
    """A number or a numeric text; booleans and others raise."""
    value = record.get(name)
    if isinstance(value, str):
        try:
            value = int(value.strip()) if value.strip().lstrip("+-").isdigit() else None
        except ValueError:
            value = None
    if isinstance(value, bool) or not isinstance(value, int) or not LOW <= value <= HIGH:
        raise ValueError(f"missing or invalid {name}")
    return value


def decode(text: str) -> dict:
    """The source's share of a landed row from one line; raises ValueError with the reason."""
    record = parse(text)
    if not isinstance(record, dict):
        raise ValueError("record must be an object")
    op = record.get("op")
    if not isinstance(op, str):
        raise ValueError("missing op")
    if op not in OPERATIONS:
        raise ValueError(f"unknown op: {op}")
    ordering = _whole(record, "ordering_value")
    checkpoint = record.get("source_checkpoint")
    if not isinstance(checkpoint, str):
        raise ValueError("missing source_checkpoint")
    version = _whole(record, "schema_version")
    if not -(2**31) <= version < 2**31:
        raise ValueError("schema_version out of range")
    moment = _whole(record, "ingestion_ts")
    key = record.get("key") if isinstance(record.get("key"), dict) else {}
    event = record.get("source_event_id")
    metadata = record.get("source_metadata")
    pairs = {}
    for name, value in (metadata if isinstance(metadata, dict) else {}).items():
        if isinstance(value, bool) or not isinstance(value, (str, int)):
            raise ValueError(f"source_metadata value for {name} must be a string or number")
        pairs[name] = str(value)
    row = {
        "op": op,
        "key_json": canonical(key),
        "after_json": None if record.get("after") is None else canonical(record["after"]),
        "before_json": None if record.get("before") is None else canonical(record["before"]),
        "ordering_value": ordering,
        "source_checkpoint": checkpoint,
        "source_event_id": str(event) if isinstance(event, (str, int)) and not isinstance(event, bool) else None,
        "schema_version": version,
        "ingestion_ts": datetime.fromtimestamp(moment, UTC).replace(tzinfo=None),
        "source_metadata_json": canonical(pairs),
        "key_names": sorted(key),
    }
    return row


_FIELDS = (
    "op string, key_json string, after_json string, before_json string, ordering_value long, source_checkpoint string, source_event_id string, "
    "schema_version int, ingestion_secs long, source_metadata_json string, key_names array<string>, error string"
)
DECODED = [x.split()[0] for x in _FIELDS.replace("ingestion_secs", "ingestion_ts").split(", ")]

#: Types that aren't taken, and letters that the JVM would order in another way than ``canonical``, in a record's schema.
_OTHER = r"ARRAY|DECIMAL|DOUBLE|FLOAT|[\x{10000}-\x{10FFFF}]"
_LATEST = 253402300799


def _told(line: str | None) -> str | None:
    """What ``decode`` says of a line, as JSON text."""
    if line is None:
        return None
    try:
        row = decode(line)
        row["ingestion_secs"] = int(row.pop("ingestion_ts").replace(tzinfo=UTC).timestamp())
    except (ValueError, OverflowError, OSError, RecursionError) as error:
        row = {"error": str(error) or type(error).__name__}
    return json.dumps(row)


def _slowly(lines: pd.Series) -> pd.Series:
    return lines.map(_told, na_action="ignore")


def decoded(lines: DataFrame) -> DataFrame:
    """``lines`` (file, pos, line, others) with the decoded columns in place of line.

    Plain records are decoded in the JVM by a variant of each line. A line is plain if it parses as one object with nothing
    after it (it is parsed inside an object whose last field is named by the line's hash), holds whole numbers of 64 bits,
    strings, booleans, nulls and objects only, and its fields are of the types that need no conversion. All others, wrong
    ones among them, are told by ``decode`` itself, so results and error texts are the same.
    """
    mark = F.concat(F.lit("h"), F.hex(F.xxhash64("line")))
    whole = F.try_parse_json(F.concat(F.lit('{"r":'), F.col("line"), F.lit(',"'), mark, F.lit('":0}')))
    parsed = lines.withColumn("_v", whole).withColumn("_s", F.schema_of_variant("_v"))
    names = ("op", "ordering_value", "source_checkpoint", "source_event_id", "schema_version", "ingestion_ts", "source_metadata")
    texts = {n: F.to_json(F.try_variant_get("_v", f"$.r.{n}", "variant")) for n in ("key", "after", "before")}
    kinds = {n: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.r.{n}", "variant")), F.lit("VOID")) for n in names}
    parsed = parsed.withColumns({f"_t_{n}": F.nullif(c, F.lit("null")) for n, c in texts.items()} | {f"_k_{n}": c for n, c in kinds.items()})
    kind = lambda n: F.col(f"_k_{n}")
    value = lambda n, t: F.try_variant_get("_v", f"$.r.{n}", t)
    is_plain = (
        # escapes are written back in another way, so lines with some go the other way
        F.contains("_s", mark) & ~F.col("_s").rlike(_OTHER) & ~F.contains("line", F.lit("\\u")) & F.col("line").startswith("{")
        & (kind("op") == "STRING") & value("op", "string").isin(*OPERATIONS) & (kind("source_checkpoint") == "STRING")
        & (kind("ordering_value") == "BIGINT") & (kind("schema_version") == "BIGINT") & value("schema_version", "bigint").between(-(2**31), 2**31 - 1)
        & (kind("ingestion_ts") == "BIGINT") & value("ingestion_ts", "bigint").between(0, _LATEST)
        & (F.col("_t_key").isNull() | F.col("_t_key").startswith("{")) & kind("source_event_id").isin("STRING", "BIGINT", "VOID")
        & ((kind("source_metadata") == "VOID") | kind("source_metadata").startswith("OBJECT<") & ~F.substr(kind("source_metadata"), F.lit(8)).rlike("BOOLEAN|VOID|OBJECT"))
    )
    parsed = parsed.withColumn("_plain", F.coalesce(is_plain, F.lit(False)))
    slow = F.from_json(F.pandas_udf(_slowly, "string")(F.when(~F.col("_plain"), F.col("line"))), _FIELDS)
    parsed = parsed.withColumn("_slow", slow)
    key = F.coalesce("_t_key", F.lit("{}"))
    plain = {
        "op": value("op", "string"), "key_json": key, "after_json": F.col("_t_after"), "before_json": F.col("_t_before"), "ordering_value": value("ordering_value", "bigint"),
        "source_checkpoint": value("source_checkpoint", "string"), "source_event_id": value("source_event_id", "string"), "schema_version": value("schema_version", "int"),
        "ingestion_secs": value("ingestion_ts", "bigint"), "source_metadata_json": sorted_map_json(value("source_metadata", "map<string,string>")),
        "key_names": F.json_object_keys(key), "error": F.lit(None).cast("string"),
    }
    both = {n: F.when(F.col("_plain"), c).otherwise(F.col(f"_slow.{n}")) for n, c in plain.items()}
    seconds = both.pop("ingestion_secs")
    both["ingestion_ts"] = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    rest = [c for c in lines.columns if c != "line"]
    return parsed.select(*rest, *(both[n].alias(n) for n in DECODED))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, name, block, pos, decoded columns, error) of every line that isn't blank, a file in as many tasks as it has splits.

    The order of a file's lines is that of (block, pos), and that of pos alone: a task has no more lines than a split has
    bytes. Of a file read alone pos is the line's number from one in its first split.
    """
    ship(spark)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"),
        F.btrim("value", F.lit(" \t\r")).alias("line"),
    )
    return decoded(lines.filter("line <> ''").select("file", "name", "block", (F.col("block") + F.col("place")).alias("pos"), "line"))


@dataclass(frozen=True)
class Selection:
    """The table that a capture feeds."""

    table_id: str
    source_table: str
    table_mode: str


@dataclass(frozen=True)
class Batch:
    """A bounded batch: landed columns, pos and key_names, with its label and checkpoints."""

    rows: DataFrame
    label: str
    checkpoint_start: str | None
    checkpoint_end: str
    table_mode: str | None = None


@dataclass(frozen=True)
class Group:
    """Batches that one scan reads: landed columns, pos, key_names and ``batch``, a batch's place among ``bounds``."""

    rows: DataFrame
    bounds: list[dict]
    table_mode: str | None = None


class FileSource:
    """A folder of batch files as a source; the folder's name gives table, class and mode unless they are given."""

    def __init__(self, spark: SparkSession, folder: str, table_id: str | None = None, source_id: str | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        name = self.folder.rsplit("/", 1)[-1]
        self.table_mode, self.source_class = KEYED_FOLDERS.get(name, ("append_only", "file_or_object_drop"))
        self.source_table, self.table_id, self.source_id = name, table_id or name, source_id or f"file.{name}"

    def spec(self) -> dict:
        if not self.source_id.strip():
            raise ContractError("source_id is required")
        return {"source_id": self.source_id, "source_class": self.source_class}

    def discover(self) -> list[str]:
        return self.files.glob(f"{self.folder}/batch-*.jsonl")

    def boundaries(self, known: dict[str, dict] | None = None) -> list[dict]:
        """file, checkpoint_start, checkpoint_end, records of each batch file in order; those ``known`` by path aren't read."""
        paths, known = self.discover(), known or {}
        new = [p for p in paths if p not in known]
        if not new:
            return [known[p] for p in paths]
        found = scan(self.spark, new).groupBy("file").agg(
            F.min_by("source_checkpoint", F.struct("block", "pos")).alias("checkpoint_start"),
            F.max_by("source_checkpoint", F.struct("block", "pos")).alias("checkpoint_end"),
            F.count(F.lit(1)).alias("records"),
            F.count("error").alias("broken"),
        )
        rows = {r["file"]: r.asDict() for r in found.collect()}  # a row for each file
        for file, row in sorted(rows.items()):
            if row["broken"]:
                first = scan(self.spark, [file]).filter("error is not null").orderBy("pos").select("pos", "error").first()
                raise ContractError(f"{file}:{first['pos']}: {first['error']}")
        empty = {"checkpoint_start": "", "checkpoint_end": "", "records": 0}
        by_name = {k.rsplit("/", 1)[-1]: v for k, v in rows.items()}
        return [known.get(p) or by_name.get(self.files.name(p), empty) | {"file": p} for p in paths]

    def check(self) -> dict:
        bounds = self.boundaries()
        details = {"batch_count": len(bounds), "record_count": sum(b["records"] for b in bounds), "fixture_dir": self.folder}
        return {"spec": self.spec(), "capabilities": self.capabilities(), "details": details}

    def capabilities(self) -> list[str]:
        return sorted(CAPABILITIES + (KEYED_CAPABILITIES if self.table_mode == "keyed_upsert" else ()))

    def open_capture(self, selection: Selection, resume: str | None = None, known: dict[str, dict] | None = None) -> "Session":
        """A session after the resume checkpoint; ``known`` are boundaries of files that were read before, by path."""
        if not selection.table_id.strip():
            raise ContractError("table_id is required")
        if selection.source_table != self.source_table:
            raise ContractError(f"unknown source table: {selection.source_table}")
        if selection.table_mode != self.table_mode:
            raise ContractError(f"table mode mismatch: {selection.table_mode}")
        bounds = self.boundaries(known)
        cursor = 0
        if resume is not None:
            at = [i for i, b in enumerate(bounds) if b["checkpoint_end"] == resume]
            if not at:
                raise ContractError(f"unknown resume checkpoint: {resume}")
            cursor = at[0] + 1
        return Session(self, replace(selection), bounds, cursor)


def label_of(bound: dict) -> str:
    return bound["file"].rsplit("/", 1)[-1]


class Session:
    """Polls whole files as batches, one by one or in groups, in order; acknowledgements may not go back."""

    def __init__(self, source: FileSource, selection: Selection, bounds: list[dict], cursor: int):
        self.source, self.selection, self.bounds, self.cursor = source, selection, bounds, cursor
        self.acknowledged: str | None = None
        self.closed = False

    def poll_batch(self) -> Batch | None:
        """The next batch, or None when there is none left."""
        if self.cursor >= len(self.bounds):
            return None
        self.cursor += 1
        return self.batch_of(self.bounds[self.cursor - 1])

    def batch_of(self, bound: dict) -> Batch:
        """One of ``bounds`` as a batch."""
        rows = self._landed(scan(self.source.spark, [bound["file"]]))
        return Batch(rows, label_of(bound), bound["checkpoint_start"], bound["checkpoint_end"], self.source.table_mode)

    def poll_group(self, most_bytes: int | None = None, most: int | None = None) -> Group | None:
        """The next batches by one scan, or None when there is none left: all of them, or those whose files have up to
        ``most_bytes`` together, the first in any case, and up to ``most``."""
        begun, files, held = self.cursor, self.source.files, 0
        while self.cursor < len(self.bounds) and (most is None or self.cursor - begun < most):
            held += files.size(self.bounds[self.cursor]["file"]) if most_bytes is not None else 0
            if self.cursor > begun and most_bytes is not None and held > most_bytes:
                break
            self.cursor += 1
        bounds, spark = self.bounds[begun : self.cursor], self.source.spark
        if not bounds:
            return None
        places = spark.createDataFrame([(files.name(b["file"]), i) for i, b in enumerate(bounds)], "name string, batch int")
        rows = scan(spark, [b["file"] for b in bounds]).join(F.broadcast(places), "name", "left")  # a row for each file
        return Group(self._landed(rows, "batch"), bounds, self.source.table_mode)

    def _landed(self, scanned: DataFrame, *more: str) -> DataFrame:
        s = self.source
        rows = scanned.select(
            F.lit(self.selection.table_id).alias("table_id"),
            F.lit(s.source_id).alias("source_id"),
            F.lit(s.source_class).alias("source_class"),
            F.lit(s.table_mode).alias("table_mode"),
            F.lit(ORDERING_FIELD).alias("ordering_field"),
            *[c for c in COLUMNS if c in DECODED],
            "pos",
            "key_names",
            *more,
        )
        return rows.select(*COLUMNS, "pos", "key_names", *more)

    def checkpoint(self, source_id: str, checkpoint: str) -> None:
        if not source_id.strip() or not checkpoint.strip():
            raise ContractError("checkpoint ids must not be blank")
        if source_id != self.source.source_id:
            raise ContractError(f"checkpoint for another source: {source_id}")
        if self.acknowledged is not None and checkpoint < self.acknowledged:  # texts compare as texts
            raise ContractError("checkpoint regression")
        self.acknowledged = checkpoint

    def close(self) -> None:
        self.closed = True
