"""Questions to the ledger, as plans over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import RECOVERABLE_ATTEMPT, RECOVERABLE_BATCH, RESOLUTIONS


def recovery_candidates(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Batches whose own status, or that of an attempt, asks for recovery."""
    both = batches.join(attempts, "batch_id", "left")
    wanted = F.col("batch_status").isin(*RECOVERABLE_BATCH) | F.coalesce(F.col("attempt_status").isin(*RECOVERABLE_ATTEMPT), F.lit(False))
    return both.filter(wanted).select("batch_id").distinct()


def orphan_candidates(files: DataFrame, batches: DataFrame, cleanups: DataFrame) -> DataFrame:
    """Files of quarantined batches without a cleanup record."""
    held = batches.filter("batch_status = 'quarantined'").select("batch_id")
    return files.join(held, "batch_id", "left_semi").join(cleanups, ["batch_id", "file_uri"], "left_anti")


def last_durable_checkpoints(links: DataFrame, batches: DataFrame) -> DataFrame:
    """(table_id, source_id, checkpoint_id): of each table the durable link of its newest batch, not the newest link."""
    order = F.struct("created_secs", "created_nanos", "batch_seq", "link_seq")
    return (
        links.filter("ack_status = 'durable'")
        .join(batches.select("batch_id", "table_id", "created_secs", "created_nanos", "batch_seq"), "batch_id")
        .groupBy("table_id")
        .agg(F.max_by(F.struct("source_id", "checkpoint_id"), order).alias("x"))
        .select("table_id", "x.source_id", "x.checkpoint_id")
    )


def last_durable_checkpoint(links: DataFrame, batches: DataFrame, table_id: str) -> DataFrame:
    """The row of one table, by a top-one plan."""
    own = links.filter("ack_status = 'durable'").join(batches.filter(F.col("table_id") == table_id), "batch_id")
    return own.orderBy(*[F.desc(c) for c in ("created_secs", "created_nanos", "batch_seq", "link_seq")]).limit(1).select("source_id", "checkpoint_id")


def next_attempt_numbers(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    most = attempts.groupBy("batch_id").agg(F.max("attempt_no").alias("m"))
    return batches.select("batch_id").join(most, "batch_id", "left").select("batch_id", (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("next_attempt_no"))


def resolutions(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RESOLUTIONS.items()], "resolution string, attempt_status string, batch_status string, quarantine_reason string")


def resolve(attempts: DataFrame) -> DataFrame:
    """Attempts (with resolution) joined to what the resolution makes of them: a fixed table of six rows."""
    return attempts.join(F.broadcast(resolutions(attempts.sparkSession)), "resolution")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return _edge(rows, key, F.min_by, order)


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return _edge(rows, key, F.max_by, order)


def _edge(rows: DataFrame, key: list[str], pick, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(pick(F.struct(*rest), order).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def ambiguous_keys(commits: DataFrame) -> DataFrame:
    """Idempotency keys committed to more than one destination."""
    return commits.groupBy("idempotency_key").agg(F.count_distinct("destination").alias("destinations")).filter("destinations > 1")


def active_files(events: DataFrame) -> DataFrame:
    """Files whose last event (sequence, phase, place) adds them, with the position of that event.

    Base files have sequence 0; a record removes (phase 0) before it adds (phase 1).
    """
    at = F.struct("sequence", "phase", "place")
    last = events.groupBy("file_uri").agg(F.max_by("kind", at).alias("kind"), F.max(at).alias("at"))
    return last.filter("kind = 'add'").select("file_uri", "at.sequence", "at.phase", "at.place")


def compaction_candidates(files: DataFrame, small_bytes: int, most: int) -> DataFrame:
    """The first ``most`` files below a size, in the order of their URIs: a top-k plan."""
    return files.filter(F.col("file_size_bytes") < small_bytes).orderBy("file_uri").limit(most)


def next_sequence(names: DataFrame) -> DataFrame:
    """One more than the greatest numeric prefix of record file names; names without one don't count; none gives 1."""
    number = F.expr("try_cast(split(name, '-')[0] AS bigint)")
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next_sequence"))


def chunk_sizes(rows: DataFrame, by: list[str], per_chunk: int, position: str = "pos") -> DataFrame:
    """(by, chunk, rows): how rows in order fall into files of ``per_chunk`` rows."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(position)) - 1
    return rows.select(*by, F.floor(place / per_chunk).cast("long").alias("chunk")).groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("rows"))
