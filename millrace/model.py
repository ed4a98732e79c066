"""The data model: landed rows, tags, manifests, ledger vocabularies, reference workloads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .functions.hashing import stable_hash_text

# Tags of the data model.
SOURCE_CLASSES = ("database_cdc", "message_log_or_queue", "file_or_object_drop", "api_incremental")
TABLE_MODES = ("append_only", "keyed_upsert")
OPERATIONS = ("insert", "upsert", "delete")

LANDED = T.StructType(
    [
        T.StructField("table_id", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("source_class", T.StringType(), False),
        T.StructField("table_mode", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key_json", T.StringType(), False),
        T.StructField("after_json", T.StringType(), True),
        T.StructField("before_json", T.StringType(), True),
        T.StructField("ordering_field", T.StringType(), False),
        T.StructField("ordering_value", T.LongType(), False),
        T.StructField("source_checkpoint", T.StringType(), False),
        T.StructField("source_event_id", T.StringType(), True),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("ingestion_ts", T.TimestampNTZType(), False),
        T.StructField("source_metadata_json", T.StringType(), False),
    ]
)
COLUMNS = LANDED.fieldNames()

#: Columns that must have one value in a batch, in the order of the check.
HOMOGENEOUS = ("table_id", "table_mode", "source_id", "source_class", "schema_version", "ordering_field")

FILE_BYTES = 256 << 20
ROW_GROUP_BYTES = 64 << 20


class ContractError(ValueError):
    """A batch, manifest or request breaks the contract."""


@dataclass(frozen=True)
class ManifestFile:
    file_uri: str
    file_kind: str
    content_hash: str
    file_size_bytes: int
    record_count: int
    created_at: str = "0:000000000"

    def checksum(self) -> str:
        """Without the time of creation, which a replay changes."""
        return stable_hash_text(self.file_uri, self.file_kind, self.content_hash, str(self.file_size_bytes), str(self.record_count))


@dataclass(frozen=True)
class BatchManifest:
    batch_id: str
    table_id: str
    table_mode: str
    source_id: str
    source_class: str
    source_checkpoint_start: str
    source_checkpoint_end: str
    ordering_field: str
    ordering_min: int
    ordering_max: int
    schema_version: int
    schema_fingerprint: str
    record_count: int
    op_counts: dict[str, int]
    content_hash: str
    file_set: tuple[ManifestFile, ...] = field(default_factory=tuple)
    created_at: str = "0:000000000"

    def _parts(self) -> list[str]:
        return [
            self.batch_id, self.table_id, self.table_mode, self.source_id, self.source_class, self.source_checkpoint_start,
            self.source_checkpoint_end, self.ordering_field, str(self.ordering_min), str(self.ordering_max), str(self.schema_version),
            self.schema_fingerprint, str(self.record_count), self.content_hash,
            *sorted(f"{op}={n}" for op, n in self.op_counts.items()), *sorted(f"{f.file_uri}:{f.checksum()}" for f in self.file_set),
        ]

    def replay_identity(self) -> str:
        """What two materialisations of the same batch share: neither time of creation nor order of files count."""
        return stable_hash_text(*self._parts())

    def checksum(self) -> str:
        return stable_hash_text(*self._parts(), self.created_at)


# Status words of the ledger.
BATCH_STATUS = (
    "registered", "files_written", "commit_started", "commit_uncertain", "schema_revalidating", "retry_ready", "committed",
    "checkpoint_pending", "checkpointed", "quarantined", "failed_terminal",
)
ATTEMPT_STATUS = ("started", "resolving", "unknown", "committed", "rejected", "failed_retryable", "failed_terminal", "ambiguous_manual")
#: resolution -> (attempt status, batch status, quarantine reason)
RESOLUTIONS = {
    "committed": ("committed", "committed", None),
    "rejected": ("rejected", "schema_revalidating", None),
    "failed_retryable": ("failed_retryable", "schema_revalidating", None),
    "failed_terminal": ("failed_terminal", "failed_terminal", None),
    "unknown": ("unknown", "commit_uncertain", None),
    "ambiguous": ("ambiguous_manual", "quarantined", "ambiguous_resolution"),
}
RECOVERABLE_BATCH = ("files_written", "commit_started", "commit_uncertain", "schema_revalidating", "retry_ready", "checkpoint_pending", "quarantined")
RECOVERABLE_ATTEMPT = ("resolving", "unknown", "ambiguous_manual")
QUARANTINE_REASONS = ("ordering_violation", "schema_violation", "malformed_batch", "ambiguous_resolution")
CLEANUP_ACTIONS = ("deleted", "retained")


@dataclass(frozen=True)
class ReferenceWorkload:
    name: str
    table_mode: str
    batches: int
    rows_per_batch: int
    columns: int
    bytes_per_row: int
    key_columns: tuple[str, ...] = ()
    update_percent: int = 0
    delete_percent: int = 0


# The declared workloads.
WORKLOADS = (
    ReferenceWorkload("append_only.orders_events", "append_only", 100, 25_000, 24, 512),
    ReferenceWorkload("keyed_upsert.customer_state", "keyed_upsert", 100, 10_000, 18, 768, ("tenant_id", "customer_id"), 20, 10),
)
