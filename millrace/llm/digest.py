"""Document fingerprints: improbable byte windows gathered in chained Bloom filters, compared by normalised bit overlap.

Every window of a text has an entropy. How often each entropy occurs is counted over the windows of the whole corpus, and
the seldom ones rank best (very regular windows rank worst, so they are never features). Along the text, the window of
best rank in each neighbourhood gains a vote, and windows with enough votes are the text's features. Windows are of 64
bytes; texts of less than SHORT bytes also have features of 16 bytes, and those of less than half as many have these
alone, so that short texts have several. Features enter a Bloom filter of 2,048 bits until it holds 160, then the next
filter of the chain. Likeness is the mean, over the filters of the shorter chain, of the best overlap with a filter of the
longer one beyond what chance gives (its mean and three deviations).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound, only, table

LARGE_WINDOW, SMALL_WINDOW = 64, 16
SHORT = 1024
BITS = 2048
HASHES = 5
FEATURES = 160
PIECE = 1 << 18
HELD = 1 << 21  # characters of texts that a task compares at once, or one text

#: c * log2(c) in whole units of 2**-20, so running sums are exact wherever they begin.
_UNIT = 1 << 20
_TERMS = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, LARGE_WINDOW + 2)], dtype=np.int32)
_STEPS = np.diff(_TERMS, prepend=np.int32(0))  # what the c-th equal byte adds
#: Entropy in thousandths of its maximum by the window's sum in steps of 2**12.
_FINE = 12


def _thousandths(window: int) -> np.ndarray:
    most = int(np.log2(window))
    sums = (np.arange((window * most * _UNIT >> _FINE) + 2) << _FINE) + (1 << _FINE - 1)
    return np.clip(np.rint((most - sums / (window * _UNIT)) / most * 1000), 0, 1000).astype(np.int16)


_THOUSANDTHS = {w: _thousandths(w) for w in (LARGE_WINDOW, SMALL_WINDOW)}
REGULAR = 100  # windows of less entropy are fill characters or repetition


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy in thousandths of the maximum by how often each occurs: the smaller, the more improbable and
    the better a feature. Counts are smoothed over ten neighbours, as they are of a finite corpus; ties go to less entropy."""
    smooth = np.convolve(counts.astype(float), np.ones(21), mode="same")
    rank = np.empty(1001, dtype=np.int64)
    rank[np.lexsort((np.arange(1001), smooth))] = np.arange(1001)
    rank[:REGULAR] = 1001
    return rank


def _usual(window: int) -> np.ndarray:
    """Counts as running text has them, for fingerprints apart from a corpus: entropies crowd around a centre."""
    return 1e6 * np.exp(-0.5 * ((np.arange(1001) - (700 if window == LARGE_WINDOW else 850)) / 60) ** 2)


RANKS = {w: ranks(_usual(w)) for w in (LARGE_WINDOW, SMALL_WINDOW)}


def entropies(raw: np.ndarray, window: int = LARGE_WINDOW) -> np.ndarray:
    """Entropy of every window in thousandths of its maximum, log2 of the window's bytes.

    The window's sum of c*log2(c) changes with its first byte leaving and the next entering, by terms that depend only
    on how often those two bytes occur in the window, so no window's counts are ever built.
    """
    n = len(raw)
    after = np.ones(n, dtype=np.uint8)  # equal bytes among those of the window that starts here
    before = np.ones(n, dtype=np.uint8)  # equal bytes among those of the window that ends here
    for k in range(1, window):
        same = (raw[:-k] == raw[k:]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    first = _TERMS[np.bincount(raw[:window], minlength=256)].sum(dtype=np.int64)
    # the entering byte's own window doesn't hold the byte that leaves, so its count is the one in the window it enters
    change = _STEPS[before[window:]] - _STEPS[after[: n - window]]
    sums = np.empty(n - window + 1, dtype=np.int32)
    sums[0] = first
    np.cumsum(change, out=sums[1:])
    sums[1:] += np.int32(first)
    return _THOUSANDTHS[window][sums >> _FINE]


def _chosen(raw: np.ndarray, ends: np.ndarray, window: int, table: np.ndarray) -> np.ndarray:
    """Starts of the selected windows of texts laid end to end; ``ends`` are their ends, each text a window at least.

    A neighbourhood is of as many windows as a window has bytes, and a quarter of its votes make a feature.
    """
    rank = table[entropies(raw, window)]
    n = len(rank)
    least = (rank.astype(np.int32) << 21) | np.arange(n, dtype=np.int32)
    step = 1
    while step < window:
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        step *= 2
    # a neighbourhood counts if all of its windows lie in one text
    whole = np.ones(len(least), dtype=bool)
    for end in ends:
        whole[max(0, end - 2 * window + 2) : end] = False
    votes = np.bincount(least[whole] & ((1 << 21) - 1), minlength=n)
    sizes = np.diff(ends, prepend=0)
    for k in np.flatnonzero(sizes < 2 * window - 2 + window // 4):  # too few neighbourhoods for the votes: the best window
        start = ends[k - 1] if k else 0
        votes[start + int(rank[start : ends[k] - window + 1].argmin())] = window
    return np.flatnonzero((votes >= window // 4) & (rank <= 1000))


def features(texts: list[np.ndarray], window: int = LARGE_WINDOW, table: np.ndarray | None = None) -> list[np.ndarray]:
    """Starts of the selected windows of each byte array. Short texts are taken together, long ones in pieces."""
    table = RANKS[window] if table is None else table
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    group: list[int] = []

    def flush():
        if group:
            ends = np.cumsum([len(texts[i]) for i in group])
            found = _chosen(np.concatenate([texts[i] for i in group]), ends, window, table)
            for i, low, high in zip(group, [0, *ends[:-1]], ends):
                out[i] = found[np.searchsorted(found, low) : np.searchsorted(found, high)] - low
            group.clear()

    held = 0
    for i, raw in enumerate(texts):
        if len(raw) < window:
            continue
        if len(raw) > PIECE:
            # pieces overlap by what a vote can reach, so the selection doesn't depend on where they are cut
            reach, parts = 2 * window, []
            for start in range(0, len(raw) - window + 1, PIECE):
                low, high = max(0, start - reach), min(len(raw), start + PIECE + reach + window)
                found = _chosen(raw[low:high], np.array([high - low]), window, table) + low
                parts.append(found[(found >= start) & (found < start + PIECE)])
            out[i] = np.concatenate(parts)
            continue
        if held + len(raw) > PIECE:
            flush()
            held = 0
        group.append(i)
        held += len(raw)
    flush()
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(raw: np.ndarray, starts: np.ndarray, window: int = LARGE_WINDOW) -> np.ndarray:
    """A 64-bit hash of each selected window."""
    windows = raw[starts[:, None] + np.arange(window)].reshape(-1, window // 8, 8).view("<u8")[..., 0]
    out = np.full(len(starts), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(window // 8):
        out = _mix(out ^ windows[:, k])
    return out


def fingerprint(text: str | None, tables: dict | None = None) -> np.ndarray:
    """The chain of filters of one text."""
    return fingerprints([text], tables)[0]


def fingerprints(texts: list[str | None], tables: dict | None = None) -> list[np.ndarray]:
    """The chains of filters as bits (filters, 2048). A text too short for a window is one feature itself; an empty one has none."""
    tables = tables or RANKS
    raws = [np.frombuffer((x or "").encode("utf-8", "replace"), dtype=np.uint8) for x in texts]
    none = np.zeros(0, dtype=np.uint8)
    large = features([x if len(x) >= SHORT // 2 else none for x in raws], LARGE_WINDOW, tables[LARGE_WINDOW])
    small = features([x if len(x) < SHORT else none for x in raws], SMALL_WINDOW, tables[SMALL_WINDOW])
    return [_chain(raw, a, b) for raw, a, b in zip(raws, large, small)]


def _chain(raw: np.ndarray, large: np.ndarray, small: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros((0, BITS), dtype=np.uint8)
    if len(large) + len(small):
        each = np.concatenate([hashes(raw, small, SMALL_WINDOW), hashes(raw, large, LARGE_WINDOW)])
        _, first = np.unique(each, return_index=True)  # a feature enters once, at its first place
        each = each[np.sort(first)]
    else:
        each = np.frombuffer(hashlib.sha256(raw.tobytes()).digest()[:8], dtype="<u8")
    chain = np.zeros((-(-len(each) // FEATURES), BITS), dtype=np.uint8)
    place = np.arange(len(each)) // FEATURES
    for k in range(HASHES):
        chain[place, ((each >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return chain


def entropy_counts(texts: DataFrame) -> dict[int, np.ndarray]:
    """For each kind of window how often each entropy occurs in all texts (text): 2,002 sums reach the driver."""

    def run(batches):
        counts = {w: np.zeros(1001, dtype=np.int64) for w in RANKS}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
                for window in [LARGE_WINDOW] * (len(raw) >= SHORT // 2) + [SMALL_WINDOW] * (len(raw) < SHORT):
                    for start in range(0, len(raw) - window + 1, PIECE):
                        counts[window] += np.bincount(entropies(raw[start : start + PIECE + window - 1], window), minlength=1001)
        for window, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1001, window)), pa.array(np.arange(1001)), pa.array(n)], ["size", "entropy", "n"])

    found = texts.select("text").mapInArrow(run, "size long, entropy long, n long").groupBy("size", "entropy").agg(F.sum("n").alias("n")).toArrow()
    out = {w: np.zeros(1001, dtype=np.int64) for w in RANKS}
    for size, entropy, n in zip(*(found[c].to_pylist() for c in ("size", "entropy", "n"))):
        out[size][entropy] = n
    return out


def text_form(chain: np.ndarray) -> str:
    """The chain as base64 text, filter after filter."""
    return base64.b64encode(np.packbits(chain, axis=1, bitorder="little").tobytes()).decode() if len(chain) else ""


def from_text(form: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(form), dtype=np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: equal chains give 1 (two empty ones too), an empty one against another 0."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    na, nb = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
    wide, total = b.astype(np.float32).T, 0.0
    for k in range(0, len(a), 256):
        common = a[k : k + 256].astype(np.float32) @ wide
        own, density = na[k : k + 256, None], nb[None, :] / BITS
        least = np.minimum(own, nb[None, :])
        chance = np.minimum(own * density + 3 * np.sqrt(own * density * (1 - density)), least - 0.5)
        total += float(np.clip((common - chance) / (least - chance), 0, 1).max(axis=1).sum())
    return total / len(a)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the following text's first as many, or all."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_neighbours(docs: DataFrame, per_bucket: int = 2000, most_buckets: int = 20_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row.

    Documents are taken in the order of doc_id, rows of one id in that of a hash of their texts, null ids first; the last
    is followed by the first, a single one by itself. A null text counts as empty. Equal texts have equal fingerprints.
    Other columns are ignored; an empty table gives no rows.

    Ranges of id and text hash form buckets, whose bounds are quantiles of a bounded sample of them. Each bucket gets its
    own rows and one more, the first of the next bucket that has any, so texts are moved once and read in order as a
    stream; a task holds HELD characters of them, or one text and the next. The driver holds a bound and a first row's id
    and hash for each bucket, ``most_buckets`` at most, and 32 times as many ids and hashes to choose bounds from.
    """
    given = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables = {w: ranks(n) for w, n in entropy_counts(given).items()}
    given = given.withColumn("tie", F.xxhash64("text"))
    ids = given.select("doc_id", "tie")
    rows = ids.count()
    want = min(most_buckets, -(-rows // per_bucket))
    first, second = _bounds(ids, rows, want)

    def number(x, tie):
        x, tie = x.fillna(_NULL).to_numpy(dtype=np.int64), tie.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(first, x, side="left"), np.searchsorted(first, x, side="right")
        for a in np.unique(low[low < high]):  # ids that are bounds themselves: by their hashes
            own = (low == a) & (low < high)
            b = high[own][0]
            high[own] = a + np.searchsorted(second[a:b], tie[own], side="right")
        return pd.Series(high, dtype="int32")

    bucket = F.pandas_udf(number, "int")(F.col("doc_id"), F.col("tie")) if len(first) else F.lit(0)
    run = _neighbours(tables)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")).alias("x")
    firsts = ids.withColumn("bucket", bucket).groupBy("bucket").agg(least).orderBy("bucket").collect()
    if not firsts:
        return given.mapInArrow(run, _SCHEMA)
    order = [(r["x"]["doc_id"], r["x"]["tie"], r["bucket"]) for r in firsts]
    follows = [(*after[:2], before[2]) for before, after in zip(order, order[1:] + order[:1])]
    pairs = F.broadcast(docs.sparkSession.createDataFrame(follows, "first long, first_tie long, bucket int"))
    heads = given.join(pairs, given["doc_id"].eqNullSafe(pairs["first"]) & (given["tie"] == pairs["first_tie"])).groupBy("doc_id", "tie", "bucket")
    own = given.select("doc_id", "text", "tie", bucket.alias("bucket"), F.lit(0).alias("head"))
    more = heads.agg(F.min("text").alias("text")).select("doc_id", "text", "tie", "bucket", F.lit(1).alias("head"))
    placed = own.unionByName(more).repartition(len(firsts), "bucket").sortWithinPartitions("bucket", "head", F.asc_nulls_first("doc_id"), "tie", "text")
    return placed.mapInArrow(run, _SCHEMA)


_NULL = -(2**63)


def _bounds(ids: DataFrame, rows: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The (doc_id, tie) at which buckets begin after the first one, in order."""
    if want < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = ids.filter(F.xxhash64("doc_id", "tie", F.lit("bounds")) <= hash_bound(32 * want / rows)).distinct().toArrow()
    first, second = some["doc_id"].fill_null(_NULL).to_numpy(), some["tie"].to_numpy()
    order = np.lexsort((second, first))[np.unique(np.linspace(0, len(first), want + 1).astype(int)[1:-1])] if len(first) else np.zeros(0, int)
    return first[order], second[order]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(tables):
    """Each row against the row after it in its bucket; the bucket's last row is only the following of the one before."""

    def compared(rows):
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[2] == b[2] and not a[3]]
        texts = [x[1] for x in rows]
        new = [edited(a[1], b[1]) for a, b in pairs]
        chains = fingerprints(texts + new, tables)
        of = {id(r): c for r, c in zip(rows, chains)}
        return _compared(pairs, new, [(of[id(a)], of[id(b)]) for a, b in pairs], chains[len(rows) :])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(batch.column(c)[k].as_py() for c in ("doc_id", "text", "bucket", "head"))
                rows.append(row)
                held += len(row[1])
                if len(rows) > 1 and (held > HELD or len(rows) > 64):
                    yield compared(rows)
                    rows = [] if row[3] else [row]
                    held = len(row[1])
        if len(rows) > 1:
            yield compared(rows)

    return run


def _compared(pairs, new, chains, after):
    out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    for (own, _), text, (chain, following), changed in zip(pairs, new, chains, after):
        values = (own[0], len(own[1]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text_form(chain), text_form(changed), likeness(chain, changed), likeness(chain, following))
        for k, v in zip(out, values):
            out[k].append(v)
    return pa.RecordBatch.from_pydict(
        out,
        pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses to the edit and to the next document.

    Edge cases as in ``compare_neighbours``."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
