"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance by anchor-point covering.

Anchors are the codewords of two binary Golay codes of length 23 (perfect, covering radius 3) laid on bits 0-22 and
23-45 of the fingerprint. A fingerprint's home is the one anchor within the covering radius of both blocks. It also
visits each anchor whose distances exceed the radius by no more than the threshold in total. If two fingerprints differ
in at most the threshold's bits, each of them therefore visits the other's home, so comparing homes with visitors per
anchor loses no link. About 61 visits belong to a distinct fingerprint, whatever the corpus; equal fingerprints are
folded into one class first, so a group of copies costs one fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Aside, durable, only, table
from .components import components

SEED = 42
WORDS = 3
THRESHOLD = 2

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY, LENGTH, CHECKS, RADIUS = 0b110001110101, 23, 11, 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is set if it is set in over half of the shingle hashes."""
    tokens = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(joined(x), SEED) for x in zip(*(tokens[i:] for i in range(words)))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 18):
        part = hashes[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, fingerprint): the fingerprint as a signed long, zero for null texts and texts without words.

    ``carried`` are the columns, all of them longs, that stay beside it.
    """

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(found.view(np.int64))], [*carried, "fingerprint"])

    given = only(docs, *carried, "text")
    return given.select(*(F.col(c).cast("long").alias(c) for c in carried), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{c} long" for c in (*carried, "fingerprint"))
    )


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: the syndrome that names a word's coset."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        out ^= np.where((out >> bit) & 1, GOLAY << (bit - CHECKS), 0)
    return out


def cosets(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns up to RADIUS + threshold bits, and by how much each exceeds RADIUS."""
    errors = np.array([sum(1 << b for b in bits) for w in range(RADIUS + threshold + 1) for bits in combinations(range(LENGTH), w)])
    excess = np.array([max(0, int(e).bit_count() - RADIUS) for e in errors], dtype=np.int8)
    syndrome = _remainder(errors)
    order = np.lexsort((excess, syndrome))
    errors, excess, syndrome = errors[order], excess[order], syndrome[order]
    first = np.searchsorted(syndrome, np.arange(1 << CHECKS))
    place = np.arange(len(errors)) - first[syndrome]
    patterns = np.zeros((1 << CHECKS, place.max() + 1), dtype=np.int64)
    over = np.full(patterns.shape, 50, dtype=np.int8)  # twice this still fits
    patterns[syndrome, place], over[syndrome, place] = errors, excess
    return patterns, over


def visits(found: np.ndarray, threshold: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into ``found`` (uint64) and the anchors that each visits; threshold 0 gives homes only."""
    patterns, over = tables
    mask = np.uint64((1 << LENGTH) - 1)
    a, b = (found & mask).astype(np.int64), ((found >> np.uint64(LENGTH)) & mask).astype(np.int64)
    sa, sb = _remainder(a), _remainder(b)
    row, i, j = np.nonzero(over[sa][:, :, None] + over[sb][:, None, :] <= threshold)
    return row, (a[row] ^ patterns[sa[row], i]) | ((b[row] ^ patterns[sb[row], j]) << LENGTH)


def _at_anchors(classes: DataFrame, threshold: int, most: int) -> DataFrame:
    def run(batches):
        tables = cosets(most)
        for batch in batches:
            found = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(found), 4096):
                part = found[k : k + 4096]
                row, anchor = visits(part, threshold, tables)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row].view(np.int64))], ["anchor", "fingerprint"])

    return classes.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long")


def links(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: every two distinct fingerprints of ``classes`` that differ in at most ``threshold`` bits.

    Spark takes visits for as small as the classes, of which they are about 61 times as many, so without the hint it would
    send them all through the driver.
    """
    home = _at_anchors(classes, 0, threshold).withColumnRenamed("fingerprint", "a")
    visitor = _at_anchors(classes, threshold, threshold).withColumnRenamed("fingerprint", "b")
    near = (home["anchor"] == visitor["anchor"]) & (home["a"] < visitor["b"]) & (F.bit_count(home["a"].bitwiseXOR(visitor["b"])) <= threshold)
    return home.join(visitor.hint("merge"), near).select("a", "b")


def _labelled(found: DataFrame, least, threshold: int) -> DataFrame:
    """(fingerprint, least_id, label) of each distinct fingerprint: the least of ``least`` in it, and its component."""
    classes = durable(found.groupBy("fingerprint").agg(F.min(least).alias("least_id")))
    labels = components(links(classes, threshold))
    return classes.join(labels, classes["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("label", "fingerprint").alias("label")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row per document row.

    component_id is the least doc_id that links reach, itself included. Null and empty texts have fingerprint zero and
    link like any other. Rows whose doc_id is null are kept; they take the least id of their component, null if it has
    none. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    found = durable(fingerprints(docs, words))
    labelled = _labelled(found, "doc_id", threshold)
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    member = labelled.join(least, "label").select("fingerprint", "component_id")
    return found.join(member, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component: that of its least doc_id, of the least text hash where ids are alike. Columns as given.

    Rows alike in doc_id and text count as one. A null doc_id comes after all others, so a document without id stays only
    if its whole component has none and its text hash is the least. Null and empty texts are alike. An empty table gives
    no rows; other columns may have any names.
    """
    whole = Aside(docs, "doc_id", "text")
    marked = whole.frame.withColumn("mark", F.xxhash64(F.col("text").cast("string")))
    found = durable(fingerprints(marked, words, ("doc_id", "mark")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = _labelled(found, row, threshold).groupBy("label").agg(F.min("least_id").alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark"))
    same = marked["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (marked["mark"] == kept["kept_mark"])
    return whole.back(marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "mark"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: three-word shingles, links at two or fewer differing bits. Edge cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
