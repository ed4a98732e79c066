"""Materialising a batch: size-targeted Parquet files in batch order, and the manifest of what was written."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_digest, digest_text, stable_hash_text
from ..functions.text import mutation_signature
from ..model import COLUMNS, FILE_BYTES, ROW_GROUP_BYTES, BatchManifest, ManifestFile
from ..sources.files import Files
from .aggregate import fingerprint_parts
from .normalize import Normalized, statistics


@dataclass(frozen=True)
class WriterConfig:
    file_bytes: int = FILE_BYTES
    row_group_bytes: int = ROW_GROUP_BYTES


def rows_for_target(target_bytes: int, average_bytes: int) -> int:
    return max(1, target_bytes // max(1, average_bytes))


def write_sized(rows: DataFrame, order: list, path: str, n: int, per_file: int, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Rows in order into files of at most ``per_file`` rows: ranges of the order are written side by side."""
    files = max(1, -(-n // per_file))
    ranged = rows.repartitionByRange(files, *order) if files > 1 else rows.coalesce(1)
    (
        ranged.sortWithinPartitions(*order)
        .select(*COLUMNS)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", per_file)
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def file_entries(rows: DataFrame, path: str, created_at: str) -> list[ManifestFile]:
    """A manifest entry for each file: size, rows, and a hash of its rows.

    The hash is of the content, not of the bytes, so writing a batch again gives the same one.
    """
    back = rows.sparkSession.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})
    found = back.groupBy("file", "size").agg(*content_digest(mutation_signature()))
    return [ManifestFile(r["file"], "data", digest_text([r]), r["size"], r["n"], created_at) for r in sorted(found.collect(), key=lambda r: r["file"])]


def _entries(rows: DataFrame, path: str, n: int, content_hash: str, created_at: str) -> list[ManifestFile]:
    """The same without reading back where there is one file, which then holds all rows."""
    files = Files(rows.sparkSession)
    written = files.glob(f"{path}/*.parquet")
    if len(written) == 1:
        return [ManifestFile(written[0], "data", content_hash, files.size(written[0]), n, created_at)]
    return file_entries(rows, path, created_at)


def materialize(batch: Normalized, label: str | None, folder: str, config: WriterConfig = WriterConfig()) -> BatchManifest:
    """Write a normalised batch below ``folder`` and describe it.

    The path depends on table and batch alone, so a replay overwrites its own files. The batch's content hash is of
    its rows, whatever files they are in.
    """
    rows = batch.rows if batch.stats else batch.rows.persist()  # profiled rows are held already by whoever profiled them
    try:
        stats = batch.stats or statistics(rows)
        n, size = sum(r["n"] for r in stats), sum(r["bytes"] for r in stats)
        content_hash = digest_text(stats)
        name, path = place_of(batch, label, folder, content_hash)
        order = _order(batch)
        with ThreadPoolExecutor(1) as beside:  # the fingerprint needs nothing of the files
            parts = beside.submit(lambda: fingerprint_parts(rows, ["table_id"]).first())
            write_sized(rows, order, path, n, rows_for_target(config.file_bytes, size // max(1, n)), config.row_group_bytes)
            found = parts.result()
        parts = found["parts"] if found else []
    finally:
        if not batch.stats:
            rows.unpersist()
    created = _now()
    return _manifest(batch, name, stats, parts, tuple(_entries(batch.rows, path, n, content_hash, created)), created)


def place_of(batch: Normalized, label: str | None, folder: str, content_hash: str = "") -> tuple[str, str]:
    """A batch's name, and the folder of its files."""
    name = label.rsplit("/", 1)[-1].rsplit(".", 1)[0] if label else f"batch-{content_hash}"
    return name, f"{folder.rstrip('/')}/{batch.table_id}/{name}"


def _order(batch: Normalized) -> list[str]:
    return ["key_json"] if batch.table_mode == "keyed_upsert" else ["pos"]


def _now() -> str:
    now = datetime.now(UTC)
    return f"{int(now.timestamp())}:{now.microsecond * 1000:09d}"


def _manifest(batch: Normalized, name: str, stats: list, parts: list, entries: tuple, created: str) -> BatchManifest:
    return BatchManifest(
        name, batch.table_id, batch.table_mode, batch.source_id, batch.source_class, batch.checkpoint_start, batch.checkpoint_end, batch.ordering_field,
        batch.ordering_min, batch.ordering_max, batch.schema_version, stable_hash_text(*parts), sum(r["n"] for r in stats), {r["op"]: r["n"] for r in sorted(stats, key=lambda r: r["op"])},
        digest_text(stats), entries, created,
    )


def materialize_group(rows: DataFrame, batches: dict[int, tuple[Normalized, str]], folder: str, config: WriterConfig = WriterConfig()) -> dict[int, BatchManifest]:
    """Write batches (normalised batch and label by ``batch`` of the rows) as ``materialize`` does, all by one job.

    A task writes whole batches, each to a file; those that need several files are written one by one.
    """
    wanted = rows.filter(F.col("batch").isin(list(batches))).persist()
    try:
        stats: dict[int, list] = {k: [] for k in batches}
        for r in statistics(wanted, by=("batch",)):  # three rows at most for each batch
            stats[r["batch"]].append(r)
        totals = {k: (sum(r["n"] for r in v), sum(r["bytes"] for r in v)) for k, v in stats.items()}
        single = [k for k, (n, size) in totals.items() if n <= rows_for_target(config.file_bytes, size // max(1, n))]
        files, staged = Files(rows.sparkSession), f"{folder.rstrip('/')}/_group-{uuid.uuid4().hex}"
        out = {}
        try:
            if single:
                with ThreadPoolExecutor(1) as beside:  # the fingerprints need nothing of the files
                    parts = beside.submit(lambda: {r["batch"]: r["parts"] for r in fingerprint_parts(wanted, ["batch"]).collect()})  # a row for each batch
                    (
                        wanted.filter(F.col("batch").isin(single)).repartition(len(single), "batch").sortWithinPartitions("batch", *_order(batches[single[0]][0]))
                        .select("batch", *COLUMNS).write.partitionBy("batch").option("maxRecordsPerFile", 0).option("parquet.block.size", config.row_group_bytes).parquet(staged)
                    )
                    found = parts.result()
                created = _now()
                for k in single:
                    name, path = place_of(*batches[k], folder)
                    files.move(f"{staged}/batch={k}", path)
                    entries = _entries(wanted, path, totals[k][0], digest_text(stats[k]), created)
                    out[k] = _manifest(batches[k][0], name, stats[k], found.get(k, []), tuple(entries), created)
        finally:
            files.delete(staged)
        for k in set(batches) - set(single):
            batch = replace(batches[k][0], rows=wanted.filter(F.col("batch") == k).drop("batch"), stats=tuple(stats[k]))
            out[k] = materialize(batch, batches[k][1], folder, config)
    finally:
        wanted.unpersist()
    return out


def delete_output(files: Files, manifest: BatchManifest) -> None:
    for f in manifest.file_set:
        files.delete(f.file_uri)
