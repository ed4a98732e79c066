"""Language-model scores: context-tree weighting over binary-decomposed byte contexts, and a unigram base score.

Each byte is eight binary decisions. Every decision has its own context tree over the DEPTH bytes before it. Each node
holds a Krichevsky-Trofimov estimator, and the weighting mixes the estimators of all depths by how well each explained
the training bytes. The counts are taken over every training byte of the corpus. A context is a node of the trees if it
holds at least LEAST training bytes, whatever the size of the corpus, so the trees grow with it; the bytes after a
node's other contexts form one more leaf below it. Scores use the trained, frozen trees. A text begins after DEPTH zero
bytes and ends with an end symbol of its own.

The trees stay distributed. Nodes deeper than HEAD are dealt by their nearest HEAD + 1 bytes and weighted where they lie;
only the nodes up to depth HEAD, of which there are 65,793 at most, meet on the driver. Every cell (a byte and the DEPTH
bytes before it) that occurs in a scored text gets its probability there. Cells with at least 1/KEPT of all training
bytes, of which there can be no more than KEPT, go to every worker; the others are looked up by a join, as rare words are.

Word counts of the base score follow the vocabulary and stay distributed. Only words with at least 1/FREQUENT of all
training tokens, of which there can be no more than FREQUENT, go to every worker; the others are looked up by a join.
Words are compared by their 64-bit XXH64 (of v distinct words about v*v/2**65 pairs share one).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, only, table

DEPTH = 5
LEAST = 16
HEAD = 2
KEPT = 1 << 23
PART = 20_000  # cells that are weighted together
CONTEXTS = 1 << 16  # of Trees, the local form
END = 255  # never a byte of UTF-8
FREQUENT = 1 << 18
PIECE = 1 << 20
WORD, CONTEXT, LAST = 0, 1, 2


def pieces(lowered: bytes):
    """The padded text with its end symbol in pieces, each led by the DEPTH bytes before it."""
    raw = np.frombuffer(bytes(DEPTH) + lowered + bytes([END]), dtype=np.uint8)
    for start in range(DEPTH, len(raw), PIECE):
        yield raw[start - DEPTH : start + PIECE]


def cells(part: np.ndarray) -> np.ndarray:
    """For each byte of a piece the byte and those before it as one number, the nearest in the next higher bits."""
    key = part[DEPTH:].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= part[DEPTH - d : len(part) - d].astype(np.uint64) << np.uint64(8 * d)
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: the recurrence up to x + 8, then Stirling's series."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    inverse = 1 / y
    square = inverse * inverse
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inverse * (1 / 12 - square * (1 / 360 - square / 1260)) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    out = np.zeros(zeros.shape)
    seen = (zeros + ones) > 0
    a, b = zeros[seen].astype(float), ones[seen].astype(float)
    out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
    return out


def decisions(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The binary decisions of cells: context and place in the byte as one sorted number, zeros, ones."""
    byte = cell & np.uint64(255)
    code = np.concatenate([cell ^ byte | np.uint64(1 << level) | byte >> np.uint64(8 - level) for level in range(8)])
    one = np.concatenate([byte >> np.uint64(7 - level) & np.uint64(1) for level in range(8)]).astype(bool)
    every, place = np.unique(code, return_inverse=True)
    n = np.tile(n, 8)
    zeros, ones = (np.bincount(place, x, len(every)).astype(float) for x in (np.where(one, 0, n), np.where(one, n, 0)))  # empty ones are whole numbers
    return every, zeros, ones


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << 8 * d) - 1)


def grow(key: np.ndarray, n: np.ndarray, first: int, last: int, hung=None) -> tuple[dict, tuple]:
    """The nodes of depth ``first`` to ``last`` that cells give, and the sums (code, weighted, zeros, ones) that the nodes
    of depth ``first`` hang on their parents. ``hung`` are those sums of the nodes below ``last``.

    A depth has the sorted contexts that are nodes and, for each decision seen there: code, zeros, ones, zeros and ones of
    the rest, and the share of the node's own estimate.
    """
    depths = {}
    for d in range(last, first - 1, -1):
        cell, place = np.unique(key & _mask(d + 1), return_inverse=True)
        m = np.bincount(place, n, len(cell))
        nodes, at = np.unique(cell >> np.uint64(8), return_inverse=True)
        is_node = np.bincount(at, m, len(nodes)) >= LEAST
        if d == 0:
            nodes, is_node = np.zeros(1, np.uint64), np.ones(1, bool)
        used = is_node[at] & (m > 0)
        code, zeros, ones = decisions(cell[used], m[used])
        weighted = own = log_kt(zeros, ones)
        rest0, rest1, share = zeros, ones, np.zeros(len(code))
        if d < DEPTH:
            rest0, rest1, below = zeros.copy(), ones.copy(), np.zeros(len(code))
            if hung is not None:
                i = np.searchsorted(code, hung[0])
                below[i] += hung[1]
                rest0[i] -= hung[2]
                rest1[i] -= hung[3]
            below += log_kt(rest0, rest1)
            share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            weighted = np.logaddexp(own, below) - np.log(2)
        depths[d] = nodes[is_node], code, zeros, ones, rest0, rest1, share
        up = code >> np.uint64(8) & _mask(max(d - 1, 0))
        parent, place = np.unique(up << np.uint64(8) | code & np.uint64(255), return_inverse=True)
        hung = parent, *(np.bincount(place, x, len(parent)).astype(float) for x in (weighted, zeros, ones))
    return depths, hung


def _find(every: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``every``, and whether they are there."""
    if not len(every):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(every, wanted), len(every) - 1)
    return i, every[i] == wanted


def log_chances(key: np.ndarray, depths: dict) -> np.ndarray:
    """log10 probability of each cell's byte after its context, by the nodes on the context's path."""
    context = [key >> np.uint64(8) & _mask(d) for d in range(DEPTH + 1)]
    is_node = [_find(depths[d][0], context[d])[1] for d in range(DEPTH + 1)]
    byte, out = key & np.uint64(255), np.zeros(len(key))
    for level in range(8):
        code = np.uint64(1 << level) | byte >> np.uint64(8 - level)
        p, left = np.zeros(len(key)), np.ones(len(key))
        for d in range(DEPTH + 1):
            _, codes, *values = depths[d]
            i, hit = _find(codes, context[d] << np.uint64(8) | code)
            zeros, ones, rest0, rest1, share = (np.where(hit, x[i], 0.0) if len(codes) else np.zeros(len(key)) for x in values)
            if d == DEPTH:
                p += left * (ones + 0.5) / (zeros + ones + 1)
                break
            share = np.where(hit, share, 0.5)
            p += left * share * (ones + 0.5) / (zeros + ones + 1)
            left *= 1 - share
            p += np.where(is_node[d + 1], 0, left) * (rest1 + 0.5) / (rest0 + rest1 + 1)
            left = np.where(is_node[d + 1], left, 0)
        out += np.log10(np.where(byte >> np.uint64(7 - level) & np.uint64(1) > 0, p, 1 - p))
    return out


def cell_logs(cells: DataFrame, number: int) -> DataFrame:
    """(key, n, log): log10 probability of every cell of ``cells`` (key, n), about ``number`` of them; n is its count in the
    training texts, zero if it occurs in scored texts only."""
    parts = max(1, -(-number // PART))
    near = F.expr(f"shiftright(key, 8) & {int(_mask(HEAD + 1))}L")
    dealt = cells.select("key", "n", F.pmod(F.xxhash64(near), F.lit(parts)).alias("part"))

    def below(found: pa.Table):
        return grow(found["key"].to_numpy().astype(np.uint64), found["n"].to_numpy(), HEAD + 1, DEPTH)

    def hang(found: pa.Table) -> pa.Table:
        code, *sums = below(found)[1]
        return pa.table([pa.array(code.astype(np.int64)), *map(pa.array, sums)], ["code", "weighted", "zeros", "ones"])

    sums = dealt.groupBy("part").applyInArrow(hang, "code long, weighted double, zeros double, ones double")
    sums = sums.groupBy("code").agg(*(F.sum(x).alias(x) for x in ("weighted", "zeros", "ones"))).orderBy("code").toArrow()
    short = cells.groupBy(F.expr(f"key & {int(_mask(HEAD + 1))}L").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    hung = sums["code"].to_numpy().astype(np.uint64), *(sums[x].to_numpy() for x in ("weighted", "zeros", "ones"))
    top = grow(short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy(), 0, HEAD, hung)[0]
    shared = cells.sparkSession.sparkContext.broadcast(top)

    def run(found: pa.Table) -> pa.Table:
        logs = log_chances(found["key"].to_numpy().astype(np.uint64), shared.value | below(found)[0])
        return pa.table([found["key"], found["n"], pa.array(logs)], ["key", "n", "log"])

    return dealt.groupBy("part").applyInArrow(run, "key long, n long, log double")


class Trees:
    """The weighted trees in one place, with at most CONTEXTS nodes of a depth: the local form that tests hold against
    ``cell_logs``. For each node there is a row of log10 probabilities of bytes, and its children by the next byte back.

    ``counts`` holds for each depth the sorted contexts that are nodes (as in ``cells``, without the lowest byte) and a
    matrix of counts of the bytes after them. A row is that of the leaf in which a context ends whose longest suffix
    among the nodes is the row's node.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        parents = [None] + [
            np.searchsorted(counts[d - 1][0], counts[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, len(counts))
        ]
        sizes = [len(ids) for ids, _ in counts]
        first = np.cumsum([0, *sizes])
        self.logs = np.zeros((first[-1], 256), dtype=np.float32)
        self.child = np.zeros((first[-1], 256), dtype=np.int32)  # 0, the root, is nobody's child: none
        for d in range(1, len(counts)):
            back = (counts[d][0] >> np.uint64(8 * (d - 1))).astype(np.int64) & 255
            self.child[first[d - 1] + parents[d], back] = first[d] + np.arange(sizes[d])
        for level in range(8):
            self._weigh(level, [m.reshape(len(m), 1 << level, 2, 1 << 7 - level).sum(axis=3) for _, m in counts], parents, first)

    def _weigh(self, level: int, split: list[np.ndarray], parents: list, first: np.ndarray) -> None:
        """Add the decisions of one bit. A node's weighted probability is half its own estimate and half the product of
        its children's, its rest being one of them. Below, a node's estimate gets the share that the training bytes give it."""
        last = len(split) - 1
        shares, rests, weighted = [None] * last, [None] * last, log_kt(split[last][..., 0], split[last][..., 1])
        for d in range(last - 1, -1, -1):
            own, rest = log_kt(split[d][..., 0], split[d][..., 1]), split[d].copy()
            np.subtract.at(rest, parents[d + 1], split[d + 1])
            below = log_kt(rest[..., 0], rest[..., 1])
            np.add.at(below, parents[d + 1], weighted)
            shares[d], rests[d] = 1 / (1 + np.exp(np.clip(below - own, -700, 700))), rest
            weighted = np.logaddexp(own, below) - np.log(2)
        given, left = np.zeros((1, 1 << level)), np.ones((1, 1 << level))  # a prediction is given + left * that below
        for d in range(last + 1):
            if d:
                given, left = given[parents[d]], left[parents[d]]
            leaf = split[d]
            if d < last:
                given = given + left * shares[d] * chance(split[d])
                left, leaf = left * (1 - shares[d]), rests[d]
            p = given + left * chance(leaf)
            rows = self.logs[first[d] : first[d + 1]].reshape(len(p), 1 << level, 2, 1 << 7 - level)
            rows[:, :, 1] += np.log10(p)[:, :, None]
            rows[:, :, 0] += np.log10(1 - p)[:, :, None]

    def score(self, lowered: bytes) -> float:
        """log10 probability of a lower-cased text with its end symbol."""
        logs, child, total = self.logs.reshape(-1), self.child.reshape(-1), 0.0
        for part in pieces(lowered):
            node = np.zeros(len(part), dtype=np.int64)
            at = np.arange(DEPTH, len(part))
            for d in range(1, DEPTH + 1):
                step = child[node[at] << 8 | part[at - d]]
                deeper = step > 0
                at = at[deeper]
                node[at] = step[deeper]
            total += float(logs[node[DEPTH:] << 8 | part[DEPTH:]].sum(dtype=np.float64))
        return total


def chance(split: np.ndarray) -> np.ndarray:
    """The estimate of a one from counts of zeros and ones."""
    return (split[..., 1] + 0.5) / (split[..., 0] + split[..., 1] + 1.0)


def tree_counts(counts: DataFrame, total: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the contexts with at least 1/CONTEXTS of ``total`` bytes and the counts of the bytes after them.

    ``counts`` (key, n) are cells of full depth. Their sums over shorter contexts are taken where they lie; only rows of
    nodes reach the driver: 256 for each of at most CONTEXTS nodes of a depth.
    """
    shorter = counts.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("d"), "key", "n")
    kept = F.col("key").bitwiseAND(F.expr("shiftleft(1L, 8 * (d + 1)) - 1"))
    sums = durable(shorter.groupBy("d", kept.alias("cell")).agg(F.sum("n").alias("n")))
    nodes = sums.groupBy("d", F.expr("shiftright(cell, 8)").alias("context")).agg(F.sum("n").alias("t")).filter(F.col("t") * CONTEXTS >= total)
    rows = sums.withColumn("context", F.expr("shiftright(cell, 8)")).join(F.broadcast(nodes.select("d", "context")), ["d", "context"]).select("d", "cell", "n").toArrow()
    depth, cell, n = (rows.column(c).to_numpy() for c in ("d", "cell", "n"))
    out = []
    for d in range(DEPTH + 1):
        own = cell[depth == d].astype(np.uint64)
        ids, place = np.unique(own >> np.uint64(8), return_inverse=True)
        if not d and not len(ids):
            ids = np.zeros(1, dtype=np.uint64)
        matrix = np.zeros((len(ids), 256))
        matrix[place, (own & np.uint64(255)).astype(np.int64)] = n[depth == d]
        out.append((ids, matrix))
    return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").lower() if text else b""  # bytes: only A-Z change


def count(training: DataFrame, most_words: int = 300_000) -> DataFrame:
    """(kind, key, n) over whole training texts: words by hash, cells of the context tree, and the ends."""

    def run(batches):
        words: Counter = Counter()
        sums, waiting, held, ends = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0, 0

        def rows(kind, keys, numbers):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys, pa.int64()), pa.array(numbers, pa.int64())], ["kind", "key", "n"]
            )

        def emit():
            keys = list(map(word_hash, words))
            numbers = list(words.values())
            words.clear()
            for k in range(0, len(keys), 50_000):
                yield rows(WORD, keys[k : k + 50_000], numbers[k : k + 50_000])

        def gather():
            key, n = np.unique(np.concatenate(waiting), return_counts=True)
            every, place = np.unique(np.concatenate([sums[0], key]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([sums[1], n]), len(every)).astype(np.int64)

        def emit_cells():
            for k in range(0, len(sums[0]), 50_000):
                yield rows(CONTEXT, sums[0][k : k + 50_000].astype(np.int64), sums[1][k : k + 50_000])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                lowered, ends = _lowered(text), ends + 1
                words.update(lowered.split())
                if len(words) > most_words:
                    yield from emit()
                for part in pieces(lowered):
                    waiting.append(cells(part))
                    held += len(part)
                    if held > 4 * PIECE:
                        sums, waiting, held = gather(), [], 0
                        if len(sums[0]) > 2 * PIECE:
                            yield from emit_cells()
                            sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if held:
            sums = gather()
        yield from emit()
        yield from emit_cells()
        if ends:
            yield rows(LAST, [0], [ends])

    return training.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def occurring(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of every cell of the texts, with n zero: cells that are to be scored, trained or not."""

    def run(batches):
        every, waiting, held = np.zeros(0, np.uint64), [], 0

        def emit():
            for k in range(0, len(every), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(every[k : k + 50_000].astype(np.int64))], ["key"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for part in pieces(_lowered(text)):
                    waiting.append(cells(part))
                    held += len(part)
                    if held > 4 * PIECE:
                        every, waiting, held = np.unique(np.concatenate([every, *waiting])), [], 0
                        if len(every) > 2 * PIECE:
                            yield from emit()
                            every = np.zeros(0, np.uint64)
        every = np.unique(np.concatenate([every, *waiting]))
        yield from emit()

    found = docs.select("text").mapInArrow(run, "key long")
    return found.select(F.lit(CONTEXT).alias("kind"), "key", F.lit(0).cast("long").alias("n"))


def scores(docs: DataFrame, training: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row per row of ``docs``.

    ``unseen`` are the rows of ``docs`` whose texts may not be among those of ``training``, by default all: only these are
    searched for cells that the training texts don't have.
    A null text counts as empty: one token, its end. Without training rows no token is known, the base score takes
    N = V = 0, and the model gives each bit one half. Rows alike in doc_id and text are scored alike, each of them
    returned; null ids are allowed; other columns are ignored; an empty ``docs`` gives no rows.
    """
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trained = count(only(training, "text").select(F.col("text").cast("string").alias("text")))
    more = texts if unseen is None else only(unseen, "text").select(F.col("text").cast("string").alias("text"))
    counts = durable(trained.unionByName(occurring(more)).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = total[LAST]["n"] if LAST in total else 0
    tokens = ends + (total[WORD]["n"] if WORD in total else 0)
    distinct = (1 if ends else 0) + (total[WORD]["v"] if WORD in total else 0)

    contexts, different = (total[CONTEXT]["n"], total[CONTEXT]["v"]) if CONTEXT in total else (0, 0)
    logs = durable(cell_logs(counts.filter(F.col("kind") == CONTEXT).select("key", "n"), different))
    is_kept = (F.col("n") > 0) & (F.col("n") * KEPT >= contexts)
    kept = logs.filter(is_kept).select("key", "log").orderBy("key").toArrow()
    kept = kept["key"].to_numpy().astype(np.uint64), kept["log"].to_numpy().astype(np.float32)
    frequent = counts.filter((F.col("kind") == WORD) & (F.col("n") * FREQUENT >= tokens)).select("key", "n").toArrow()
    order = np.argsort(frequent["key"].to_numpy())
    known = frequent["key"].to_numpy()[order], np.log10(frequent["n"].to_numpy()[order] + 0.5)
    shared = spark.sparkContext.broadcast((kept, known))
    last = float(np.log10(ends + 0.5))

    def run(batches):
        (kept, kept_logs), (word_keys, word_logs) = shared.value
        names = Names()

        def look_up(waiting, owners, score):
            """Adds the kept cells to ``score`` and returns cell, owner and number of the others."""
            cell, place = np.unique(np.concatenate(waiting), return_inverse=True)
            owner = np.repeat([o for o, _ in owners], [n for _, n in owners])
            i, hit = _find(kept, cell)
            score += np.bincount(owner, np.where(hit, kept_logs[i], 0.0)[place] if len(kept) else None, len(score)) * bool(len(kept))
            other = ~hit[place]
            pair, times = np.unique(place[other] * len(score) + owner[other], return_counts=True)
            return pair % len(score), cell[pair // len(score)].astype(np.int64), times

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                size = part.num_rows
                ids, marks, sizes = part.column("doc_id"), np.zeros(size, np.int64), np.zeros(size)
                keys, times, score, waiting, owners, held, others = [], [], np.zeros(size), [], [], 0, []
                for place, text in enumerate(part.column("text").to_pylist()):
                    lowered = _lowered(text)
                    marks[place] = xxhash.xxh64_intdigest(b"-" if text is None else b"+" + text.encode("utf-8", "replace")) - (1 << 63)
                    sizes[place] = len(lowered)
                    words = Counter(lowered.split())
                    keys.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
                    times.append(np.fromiter(words.values(), np.int64, len(words)))
                    names.forget()
                    for piece in pieces(lowered):
                        waiting.append(cells(piece))
                        owners.append((place, len(waiting[-1])))
                        held += len(piece)
                        if held > PIECE:
                            others.append(look_up(waiting, owners, score))
                            waiting, owners, held = [], [], 0
                if waiting:
                    others.append(look_up(waiting, owners, score))
                owner, key, number = np.repeat(np.arange(size), [len(x) for x in keys]), np.concatenate(keys), np.concatenate(times)
                i, hit = _find(word_keys, key)
                found = np.where(hit, word_logs[i], 0.0) if len(word_keys) else np.zeros(len(key))
                stats = [
                    1 + np.bincount(owner, number, size), int(ends > 0) + np.bincount(owner, np.where(hit, number, 0), size),
                    last + np.bincount(owner, number * found, size), score, sizes,
                ]
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * size + 1, 5, dtype=np.int32)), pa.array(np.stack(stats, axis=1).ravel()))
                yield _rows(ids, marks, LAST, np.arange(size), marks, np.zeros(size), stats)
                for kind, (at, key, number) in [(WORD, (owner[~hit], key[~hit], number[~hit])), *((CONTEXT, x) for x in others)]:
                    for j in range(0, len(at), 50_000):
                        yield _rows(ids, marks, kind, at[j : j + 50_000], key[j : j + 50_000], number[j : j + 50_000])

    rows = texts.mapInArrow(run, "doc_id long, mark long, kind int, key long, times int, stats array<double>")
    rare_words = counts.filter((F.col("kind") == WORD) & (F.col("n") * FREQUENT < tokens)).select("kind", "key", F.col("n").alias("c"), F.log10(F.col("n") + 0.5).alias("log"))
    rare_cells = logs.filter(~is_kept).select(F.lit(CONTEXT).alias("kind"), "key", F.lit(0).cast("long").alias("c"), "log")
    rare = rare_words.unionByName(rare_cells).hint("shuffle_hash")
    times, is_cell = F.col("times"), F.col("kind") == CONTEXT
    gathered = (
        rows.join(rare, ["kind", "key"], "left")
        .groupBy("doc_id", "mark")
        .agg(
            F.count("stats").alias("rows"),
            F.max(F.get("stats", F.lit(0))).cast("long").alias("n"),
            F.max(F.get("stats", F.lit(1))).cast("long").alias("known"),
            F.max(F.get("stats", F.lit(2))).alias("base"),
            F.max(F.get("stats", F.lit(3))).alias("score"),
            F.max(F.get("stats", F.lit(4))).alias("bytes"),
            F.sum(F.when(~is_cell, times * F.coalesce("log", F.lit(float(np.log10(0.5)))))).alias("rare"),
            F.sum(F.when(is_cell, times * F.col("log")).otherwise(0.0)).alias("rare_cells"),
            F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("rare_known"),
        )
    )
    score = F.col("score") + F.col("rare_cells") / F.col("rows")
    norm = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return gathered.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.expr("rare_known div rows")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") / F.col("rows") - F.col("n") * norm).alias("base_score"),
        score.alias("score"),
        (-score * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"),
        F.explode(F.expr("sequence(1, rows)")).alias("_copy"),
    ).drop("_copy")


class Names(dict):
    """The hashes of words, remembered for short ones."""

    def __missing__(self, word: bytes) -> int:
        key = word_hash(word)
        if len(word) < 32:
            self[word] = key
        return key

    def forget(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()


def _rows(ids, marks: np.ndarray, kind: int, at: np.ndarray, key: np.ndarray, times: np.ndarray, stats=None) -> pa.RecordBatch:
    """Rows of the documents ``at`` these places of a part."""
    columns = [ids.take(pa.array(at)), pa.array(marks[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(key), pa.array(times.astype(np.int32))]
    columns.append(pa.nulls(len(at), pa.list_(pa.float64())) if stats is None else stats)
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "kind", "key", "times", "stats"])


def held_out():
    """crc32 of doc_id as text leaves 1 modulo 5; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of all documents, learned from those that aren't held out. Edge cases as in ``scores``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(docs, docs.filter(~held_out()), docs.filter(held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
