"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents, in hash order, form blocks. In the fluid schedule every source with blocks left is served at a
rate in proportion to its target weight. Block j of a source is released in the slot in which the fluid schedule begins
it and is due by the slot in which the fluid schedule ends it. The windows come from whole-number arithmetic. Exactly one
block runs in each slot, the released one with the earliest deadline. Unit jobs with such windows always meet their
deadlines, so at no time does a source deviate from its fluid share by a whole block. A source that runs out leaves its
share to the others in proportion; every document is placed exactly once.

The scheduler sees a row for each source and emits a row for each block; its memory holds the sources alone. A block has
BLOCK rows, or as many more as keep the number of blocks near MOST_BLOCKS, so that one task can schedule any corpus.
Documents are ranked within hash buckets, so the largest source is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Aside, table, without

BLOCK = 64
MOST_BLOCKS = 1 << 24
UNITS = 1 << 40
BUCKET_ROWS = 256
GROUP = 1024
TEMPERATURE = 0.5


def whole_weights(weights: list[float]) -> list[int]:
    """Positive weights as whole numbers in the same proportions: shares of UNITS by largest remainders, at least one each."""
    if not all(isfinite(w) and w > 0 for w in weights):
        raise ValueError("weights must be positive")
    if not weights:
        return []
    most = max(weights)
    scaled = [Fraction(w / most) for w in weights]  # no overflow, no underflow of the sum
    total = sum(scaled, Fraction(0))
    exact = [w * UNITS / total for w in scaled]
    out = [int(w) for w in exact]
    short = UNITS - sum(out)
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[:short]:
        out[i] += 1
    return [max(1, w) for w in out]


def windows(counts: list[int], weights: list[int], source: int) -> Iterator[tuple[int, int]]:
    """(release, deadline) of each block of a source: floor and ceiling of the fluid schedule's start and end."""
    order = sorted(range(len(counts)), key=lambda u: Fraction(counts[u], weights[u]))
    rest, done, k = sum(weights), 0, 0
    own, began = weights[source], 0
    for j in range(1, counts[source] + 1):
        # sources that the fluid schedule has finished by the virtual time j / own
        while k < len(order) and counts[order[k]] * own <= j * weights[order[k]]:
            done, rest, k = done + counts[order[k]], rest - weights[order[k]], k + 1
        served = j * rest
        yield began, done + -(-served // own)
        began = done + served // own


def schedule(counts: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) in slot order, earliest deadline first among released blocks."""
    streams = [windows(counts, weights, s) for s in range(len(counts))]
    waiting: list[tuple[int, int, int, int]] = []
    ready: list[tuple[int, int, int, int]] = []

    def follow(source: int, block: int) -> None:
        window = next(streams[source], None)
        if window:
            heapq.heappush(waiting, (window[0], window[1], source, block))

    for source in range(len(counts)):
        follow(source, 0)
    for slot in range(sum(counts)):
        while waiting and waiting[0][0] <= slot:
            release, deadline, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, source, block, release))
        deadline, source, block, release = heapq.heappop(ready)
        yield slot, source, block, release, deadline
        follow(source, block + 1)


def _plan(sources: DataFrame, weights: dict[str, float] | None, temperature: float, rest: float, block: int) -> DataFrame:
    """(_source, block, slot, release, deadline) from (_source, source, rows)."""

    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["_source"])
        if not rows:
            return
        given = [weights.get(r["source"], rest) if weights else r["rows"] ** temperature for r in rows]
        names, counts = [r["_source"] for r in rows], [-(-r["rows"] // block) for r in rows]
        out: list[tuple] = []

        def batch():
            slot, source, number, release, deadline = zip(*out)
            return pa.RecordBatch.from_pydict(
                {"_source": [names[s] for s in source], "block": number, "slot": slot, "release": release, "deadline": deadline},
                pa.schema([("_source", pa.string())] + [(x, pa.int64()) for x in ("block", "slot", "release", "deadline")]),
            )

        for x in schedule(counts, whole_weights(given)):
            out.append(x)
            if len(out) == 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return sources.coalesce(1).mapInArrow(run, "_source string, block long, slot long, release long, deadline long")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    rest: float = 1.0,
    block: int = BLOCK,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with mix_block, mix_slot, mix_release, mix_deadline, mix_position: every row placed once.

    ``weights`` gives target weights by source, ``rest`` those of sources that it doesn't name; without it a source's
    weight is its row count to the power ``temperature``. Reading by (mix_slot, mix_position) gives the mixture. A null
    source is a source of its own, as is an empty one. Rows are ordered within a source by a hash of doc_id, ties by
    doc_id (null first) and a hash of the text if there is one; rows equal in all are interchangeable. Columns named
    mix_* are replaced, others come back as given. An empty table gives no rows.
    """
    given = without(docs, lambda n: n.startswith("mix_"))
    read = ["doc_id", "source"] + ["text"] * ("text" in given.columns)
    whole = Aside(given, *read)
    rows = given.count()
    buckets = max(1, -(-rows // bucket_rows))
    block = block * max(1, -(-rows // (block * MOST_BLOCKS)))
    keyed = whole.frame.select(
        *whole.frame.columns,
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"),
        F.xxhash64("doc_id").alias("_hash"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sizes = keyed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.first("source").cast("string").alias("source"))
    # offsets of buckets within groups of buckets, then of the groups: no task sees all buckets of a source
    sizes = sizes.withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    groups = sizes.groupBy("_source", "_group").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    sources = groups.groupBy("_source").agg(F.sum("n").alias("rows"), F.first("source").alias("source"))
    earlier = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_source", "_group", F.coalesce(F.sum("n").over(earlier("_source", order="_group")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(earlier("_source", "_group", order="_bucket")), F.lit(0))
    sizes = sizes.withColumn("inner", inner).join(groups, ["_source", "_group"]).withColumn("offset", F.col("inner") + F.col("base"))
    slots = (
        sizes.select("_source", "_bucket", "offset", F.explode(F.expr(f"sequence(offset div {block}, (offset + n - 1) div {block})")).alias("block"))
        .join(_plan(sources, weights, temperature, rest, block), ["_source", "block"])
        .groupBy("_source", "_bucket")
        .agg(F.min("offset").alias("_offset"), F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("_slots"))
    )
    ties = F.xxhash64("text") if "text" in read else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", ties)) - 1
    placed = keyed.withColumn("_rank", rank).join(slots, ["_source", "_bucket"])
    placed = placed.withColumn("_rank", F.col("_rank") + F.col("_offset"))
    at = F.expr(f"_slots[cast(_rank div {block} - _offset div {block} as int)]")
    return whole.back(
        placed,
        at["block"].alias("mix_block"),
        at["slot"].alias("mix_slot"),
        at["release"].alias("mix_release"),
        at["deadline"].alias("mix_deadline"),
        F.expr(f"_rank % {block}").alias("mix_position"),
    )


def in_order(docs: DataFrame, **parameters) -> DataFrame:
    """The documents themselves, sorted into the mixture's order; columns as given, whatever their names. Ties, nulls and
    empty tables as in ``mix``."""
    own = ["doc_id", "source"] + ["text"] * ("text" in docs.columns)
    whole = Aside(docs, *own)
    return whole.back(mix(whole.frame, **parameters).orderBy("mix_slot", "mix_position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot, window and position of every document under weights that flatten the sources' sizes. Edge cases as in ``mix``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")
