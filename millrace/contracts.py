"""What a source, a capture session, a sink and a ledger must offer, and constructors of single change records."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .model import COLUMNS, LANDED, ContractError
from .operators.sink import Sink
from .sources.jsonl import Batch, Selection

__all__ = ["CaptureSession", "Sink", "SourceAdapter", "StateStore", "build", "delete", "insert", "upsert"]


class CaptureSession(Protocol):
    def poll_batch(self) -> Batch | None: ...
    def checkpoint(self, source_id: str, checkpoint: str) -> None: ...
    def close(self) -> None: ...


class SourceAdapter(Protocol):
    def spec(self) -> dict: ...
    def check(self) -> dict: ...
    def open_capture(self, selection: Selection, resume: str | None = None) -> CaptureSession: ...


class StateStore(Protocol):
    def register_batch(self, manifest) -> None: ...
    def record_files(self, batch_id: str, manifest) -> None: ...
    def begin_commit(self, batch_id: str, destination: str, snapshot: str, actor: str) -> dict: ...
    def resolve_commit(self, attempt_id: str, resolution: str) -> None: ...
    def link_checkpoint_pending(self, batch_id: str, source_id: str, checkpoint: str, snapshot: str) -> None: ...
    def mark_checkpoint_durable(self, batch_id: str, source_id: str, checkpoint: str, snapshot: str) -> None: ...
    def last_durable_checkpoint(self, table_id: str) -> tuple[str, str] | None: ...
    def mark_quarantine(self, batch_id: str, reason: str, details: str | None = None) -> None: ...
    def list_recovery_candidates(self) -> list[str]: ...
    def list_orphan_candidates(self) -> list[tuple[str, str]]: ...
    def record_cleanup(self, batch_id: str, file_uri: str, action: str) -> None: ...


def _record(op: str, key: list[tuple[str, object]], after: dict | None, ordering_value: int, **more) -> dict:
    """A landed row as a dict; ``key`` keeps the caller's order of parts."""
    names = [n for n, _ in key]
    if any(not n.strip() for n in names):
        raise ContractError("key names must not be blank")
    if len(set(names)) < len(names):
        raise ContractError("key names must be unique")
    row = {
        "table_id": "table",
        "source_id": "source",
        "source_class": "database_cdc",
        "table_mode": "append_only" if op == "insert" else "keyed_upsert",
        "op": op,
        "key_json": json.dumps(dict(key), separators=(",", ":"), ensure_ascii=False),
        "after_json": None if after is None else json.dumps(after, sort_keys=True, separators=(",", ":"), ensure_ascii=False),
        "before_json": None,
        "ordering_field": "source_position",
        "ordering_value": ordering_value,
        "source_checkpoint": f"cp-{ordering_value:012d}",
        "source_event_id": None,
        "schema_version": 1,
        "ingestion_ts": datetime(1970, 1, 1),
        "source_metadata_json": "{}",
    } | more
    if row["table_mode"] == "keyed_upsert" and not key:
        raise ContractError("keyed_upsert requires a key")
    return row | {"key_names": names}


def insert(after: dict, ordering_value: int, **more) -> dict:
    return _record("insert", [], after, ordering_value, **more)


def upsert(key: list[tuple[str, object]], after: dict, ordering_value: int, **more) -> dict:
    return _record("upsert", key, after, ordering_value, **more)


def delete(key: list[tuple[str, object]], ordering_value: int, **more) -> dict:
    return _record("delete", key, None, ordering_value, **more)


def build(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Checked records as landed rows with pos and key_names; the first broken one raises with its violation."""
    from pyspark.sql import types as T

    from .operators.validate import quarantine

    schema = T.StructType([*LANDED.fields, T.StructField("key_names", T.ArrayType(T.StringType())), T.StructField("pos", T.LongType())])
    rows = spark.createDataFrame([(*(r[c] for c in COLUMNS), r["key_names"], i) for i, r in enumerate(records, 1)], schema)
    _, broken = quarantine(rows)
    first = broken.orderBy("pos").first()
    if first:
        raise ContractError(f"record {first['pos']}: {first['violation']}")
    return rows
