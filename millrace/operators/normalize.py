"""Batch normalisation: homogeneity, spans, per-key order, latest state by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_digest
from ..functions.text import mutation_signature
from ..model import COLUMNS, HOMOGENEOUS, ContractError
from .validate import first_violation


def mismatches(rows: DataFrame, by: list[str], columns=HOMOGENEOUS) -> DataFrame:
    """(by, column): the columns with more than one value in a batch, by one pass of partial minima and maxima."""
    spans = rows.groupBy(*by).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    broken = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return spans.select(*by, F.explode(broken).alias("column_name"))


def ordering_spans(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("ordering_value").alias("ordering_min"), F.max("ordering_value").alias("ordering_max"))


def ordering_violations(rows: DataFrame, key: list[str], value: str = "ordering_value", position: str = "pos") -> DataFrame:
    """Rows whose ordering is below that of the row of the same key before them in arrival order, with prev_value."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(position))
    return rows.withColumn("prev_value", before).filter(F.col(value) < F.col("prev_value"))


def latest_by_key(rows: DataFrame, key: list[str], value: str = "ordering_value", position: str = "pos") -> DataFrame:
    """The row of greatest ordering of each key, of equal ones the later arrival.

    A maximum with partial aggregation: a key with a third of all rows sends one row from each task.
    """
    rest = [c for c in rows.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(value, position)).alias("row"))
    return latest.select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def apply_deletes(latest: DataFrame) -> DataFrame:
    return latest.filter("op <> 'delete'")


@dataclass(frozen=True)
class Normalized:
    """A checked and reduced batch; spans are of the rows as they came."""

    rows: DataFrame
    table_id: str
    table_mode: str
    source_id: str
    source_class: str
    schema_version: int
    ordering_field: str
    ordering_min: int
    ordering_max: int
    checkpoint_start: str
    checkpoint_end: str
    stats: tuple | None = None  # counts, bytes and digests by operation, where the rows are those that were profiled


def statistics(rows: DataFrame, *more, by: tuple = ()) -> list:
    """Count, bytes and content digest of each operation, and further aggregates: one grouped pass, three rows at most (of each batch)."""
    signature = mutation_signature()
    return rows.groupBy(*by, "op").agg(F.sum(F.octet_length(signature).cast("long")).alias("bytes"), *content_digest(signature), *more).collect()


def profile(rows: DataFrame, keyed: bool, by: tuple = ()) -> list:
    """Everything that is asked of a batch's rows before they are written, by operation, in one pass.

    Besides ``statistics``: the first row that breaks a rule of its own (if there is a column key_names), minima and maxima
    of the columns that must agree and of the ordering, and for keyed batches whether a key's ordering ever falls.
    """
    if keyed:
        before = F.lag("ordering_value").over(Window.partitionBy(*by, "key_json").orderBy("pos"))
        rows = rows.withColumn("_falls", F.coalesce(F.col("ordering_value") < before, F.lit(False)))
    if "key_names" in rows.columns:
        rows = rows.withColumn("_violation", first_violation())
        broken = F.min(F.when(F.col("_violation").isNotNull(), F.struct("pos", F.col("_violation").alias("violation")))).alias("broken")
    else:
        broken = F.lit(None).cast("struct<pos:long,violation:string>").alias("broken")
    falls = F.max("_falls") if keyed else F.lit(False)
    spans = [f(c).alias(f"{n}_{c}") for c in (*HOMOGENEOUS, "ordering_value") for n, f in (("min", F.min), ("max", F.max))]
    return statistics(rows, broken, falls.alias("falls"), *spans, by=by)


def normalize_batch(rows: DataFrame, checkpoint_end: str, checkpoint_start: str | None = None, keyed: bool | None = None) -> Normalized:
    """Check a batch (landed columns and pos, perhaps key_names) and reduce it if its table is keyed; raises ContractError.

    Keyed batches come out in the order of their key text, append-only ones in arrival order; ``pos`` is kept for the
    writer. ``keyed`` saves a look at the rows where the mode is known.
    """
    if keyed is None:
        first = rows.select("table_mode").first()
        keyed = bool(first) and first["table_mode"] == "keyed_upsert"
    return _checked(rows.select(*COLUMNS, "pos"), profile(rows, keyed), checkpoint_end, checkpoint_start)


def normalize_group(rows: DataFrame, bounds: list[dict], keyed: bool) -> tuple[DataFrame, list[Normalized | None]]:
    """The same of many batches (as ``normalize_batch`` takes them, and their place among ``bounds`` as batch), by one pass.

    Gives the reduced rows of all, with batch, and for each batch what was found, or None if the batch is wrong.
    """
    found: dict[int, list] = {}
    for r in profile(rows, keyed, ("batch",)):  # three rows at most for each batch
        found.setdefault(r["batch"], []).append(r)
    out, normals = rows.select("batch", *COLUMNS, "pos"), []
    for place, bound in enumerate(bounds):
        try:
            normals.append(_checked(out, found.get(place), bound["checkpoint_end"], bound["checkpoint_start"], False))
        except ContractError:
            normals.append(None)
    if set(found) - set(range(len(bounds))):
        raise ContractError("rows of an unknown file")
    return latest_by_key(out, ["batch", "key_json"]).select("batch", *COLUMNS, "pos") if keyed else out, normals


def _checked(out: DataFrame, found: list | None, checkpoint_end: str, checkpoint_start: str | None, reduce: bool = True) -> Normalized:
    """What a batch's profile tells; raises ContractError."""
    if not found:
        raise ContractError("batch must not be empty")
    broken = min((tuple(r["broken"]) for r in found if r["broken"]), default=None)
    if broken:
        raise ContractError(f"{broken[0]}: {broken[1]}")
    low = {c: min(r[f"min_{c}"] for r in found) for c in (*HOMOGENEOUS, "ordering_value")}
    high = {c: max(r[f"max_{c}"] for r in found) for c in (*HOMOGENEOUS, "ordering_value")}
    for c in HOMOGENEOUS:
        if low[c] != high[c]:
            raise ContractError(f"{c} mismatch within batch")
    if low["table_mode"] == "keyed_upsert":
        if any(r["falls"] for r in found):
            raise ContractError("ordering violation quarantine")
        if reduce:
            out = latest_by_key(out, ["key_json"]).select(*COLUMNS, "pos")
    return Normalized(
        out, low["table_id"], low["table_mode"], low["source_id"], low["source_class"], low["schema_version"], low["ordering_field"],
        low["ordering_value"], high["ordering_value"], checkpoint_start or checkpoint_end, checkpoint_end, None if low["table_mode"] == "keyed_upsert" else tuple(found),
    )
