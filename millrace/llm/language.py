"""Language identification: the average of hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are all runs of two, three and four bytes of the lower-cased text between blanks, hashed to BUCKETS rows of an
embedding table. Training reads a bounded, documented sample of labelled texts, at most PER_LANGUAGE of each of the
MOST_LANGUAGES most frequent languages, chosen by a hash of doc_id: the whole text, an excerpt, and a few words. Each
also gives a text of no language (its letters dealt anew, its words reversed, or noise), which the softmax learns as one
more class. A fifth of the sample is held back for calibration: the softmax temperature, and the rejection threshold on
the chance that a text is in any language. It is the least chance from which on PRECISION of the held-back texts and
excerpts are in a language, but never so high that more than REFUSED of the whole texts among them are rejected. As the
model is linear after averaging, prediction needs the product of both matrices only: one row of logits per bucket.
Training is one task on an executor; the driver sees the product.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Aside, hash_bound, only, table, without

BUCKETS = 1 << 16
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
PER_LANGUAGE = 400
MOST_LANGUAGES = 128  # the product takes 256 kB for each
EXCERPT = 160
EPOCHS = 6
RATE = 0.5
PIECE = 1 << 20
PRECISION = 0.99
REFUSED = 0.001
UNKNOWN = "und"
NONE = ""  # the class of texts in no language


def subwords(text: str):
    """Arrays of bucket numbers that together hold each subword of the whole text once, in bounded pieces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    for start in range(0, len(raw), PIECE):
        part = raw[start : start + PIECE + max(LENGTHS) - 1].astype(np.uint32)
        key = part
        for n in range(2, max(LENGTHS) + 1):
            key = (key[:-1] << np.uint32(8)) | part[n - 1 :]
            if n in LENGTHS:
                own = key[:PIECE]  # later starts belong to the next piece
                yield ((own * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def no_language(text: str, seed: int) -> str:
    """A text in no language made from one in some: letters dealt anew within it, words reversed, or letters drawn evenly."""
    rng, kind = random.Random(seed), seed % 3
    if kind == 1:
        return " ".join(w[::-1] for w in text.split())
    letters = [c for c in text if not c.isspace()]
    if kind == 2:
        every = sorted(set(letters) | set("abcdefghijklmnopqrstuvwxyz"))
        letters = [rng.choice(every) for _ in letters]
    rng.shuffle(letters)
    rest = iter(letters)
    return "".join(c if c.isspace() else next(rest) for c in text)


def examples(text: str, h: int) -> list[tuple[int, str]]:
    """(kind, text): 0 the whole, 1 an excerpt, 2 a few words; 3 and 4 an excerpt and a few words in no language."""
    at = h % max(1, len(text) - EXCERPT)
    part = text[at : at + EXCERPT]
    words = part.split()
    first = h // 7 % max(1, len(words))
    few = " ".join(words[first : first + 1 + h // 3 % 4])
    return [(0, text), (1, part), (2, few), (3, no_language(part, h)), (4, no_language(few, h // 5))]


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and output matrix from (buckets, counts, class number) by plain SGD with a falling rate."""
    rng = np.random.default_rng(seed)
    inner = rng.uniform(-0.5 / DIMENSIONS, 0.5 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    outer = np.zeros((DIMENSIONS, classes))
    steps, step = EPOCHS * max(1, len(samples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            buckets, counts, own = samples[i]
            share = counts / counts.sum()
            mean = share @ inner[buckets]
            logits = mean @ outer
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[own] -= 1
            rate = RATE * (1 - step / steps)
            back = outer @ p
            outer -= rate * np.outer(mean, p)
            # each bucket moves by its share; scaled so that long texts move their buckets as much as short ones
            inner[buckets] -= rate * np.outer(share * min(len(buckets), 64), back)
            step += 1
    return inner, outer


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, truth: np.ndarray, kinds: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss on held-back texts of these kinds, and the rejection threshold.

    The last class is that of no language. Few words are too little to tell, so they don't count for the threshold.
    """
    if not len(truth):
        return 1.0, 0.0
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    long = np.isin(kinds, (0, 1, 3))
    known, real, whole = 1 - softmax(logits / temperature)[long, -1], kinds[long] < 3, kinds[long] == 0
    if not whole.any():
        return temperature, 0.0
    order = np.argsort(-known, kind="stable")
    good = np.cumsum(real[order]) >= PRECISION * np.arange(1, len(order) + 1)
    wanted = float(known[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return temperature, min(wanted, float(np.quantile(known[whole], REFUSED)))


def labelled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The training sample: for each language the ``per_language`` labelled texts of least hash, none held out."""
    chosen = docs.filter("lang is not null and text is not null and not held_out").withColumn("_h", F.xxhash64("doc_id", F.lit("sample")))
    most = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return chosen.limit(0)
    # a share of the hash range with half as many again first, so that only about the sample is sorted
    near = [
        (F.col("lang") == F.lit(k)) & (F.col("_h") <= F.lit(hash_bound((1.5 * per_language + 50) / n)))
        for k, n in counts.items()
    ]
    some = chosen.filter(near[0] if len(near) == 1 else reduce(or_, near))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text")))
    return some.withColumn("_r", rank).filter(F.col("_r") <= per_language)


_COUNTS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("kind", pa.int32()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])


def _counted(batches):
    """Bucket counts of the examples of sampled texts."""
    for batch in batches:
        out = {k: [] for k in _COUNTS.names}
        for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "_h", "text"))):
            h += 1 << 63
            for kind, x in examples(text, h) if has_letter(text) else ():
                if not has_letter(x):
                    continue
                total = np.zeros(BUCKETS, dtype=np.int64)
                for found in subwords(x):
                    total += np.bincount(found, minlength=BUCKETS)
                used = np.flatnonzero(total)
                values = (lang if kind < 3 else NONE, h >> 1, kind, used.astype(np.int32), total[used].astype(np.float32))
                for k, v in zip(out, values):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, _COUNTS)


def _trained(batches):
    """One row: the model from all bucket counts."""
    rows = [r for b in batches for r in zip(*(b.column(c) for c in _COUNTS.names))]
    rows = sorted(((h.as_py(), lang.as_py(), kind.as_py(), b.values.to_numpy(), c.values.to_numpy()) for lang, h, kind, b, c in rows), key=lambda r: r[:3])
    languages = sorted({r[1] for r in rows} - {NONE})
    number = {k: i for i, k in enumerate([*languages, NONE])}
    every = [(b, c.astype(float), number[lang]) for _, lang, _, b, c in rows]
    back = [h % 5 == 0 for h, *_ in rows]
    inner, outer = train([x for x, b in zip(every, back) if not b], len(number))
    product = (inner @ outer).astype(np.float32)
    tested = [x for x, b in zip(every, back) if b]
    kinds = np.array([kind for (_, _, kind, *_), b in zip(rows, back) if b], dtype=int)
    logits = np.array([(c / c.sum()) @ product[b] for b, c, _ in tested]).reshape(len(tested), len(number))
    temperature, threshold = calibrate(logits, np.array([k for *_, k in tested], dtype=int), kinds)
    yield pa.RecordBatch.from_pydict({"languages": [languages], "product": [product.tobytes()], "temperature": [temperature], "threshold": [threshold]}, _MODEL)


_MODEL = pa.schema([("languages", pa.list_(pa.string())), ("product", pa.binary()), ("temperature", pa.float64()), ("threshold", pa.float64())])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model as a dict: languages, product (logits per bucket, the last class no language), temperature, threshold.

    ``docs`` needs doc_id, text, lang, held_out. Sampled texts are turned into bucket counts where they lie. An empty
    label is no label.
    """
    sample = labelled(docs.filter(F.col("lang") != NONE), per_language).select("lang", "_h", "text")
    counts = sample.mapInArrow(_counted, "lang string, h long, kind int, buckets array<int>, counts array<float>")
    row = counts.repartition(1).mapInArrow(_trained, "languages array<string>, product binary, temperature double, threshold double").first()
    return row.asDict() if row else {"languages": [], "product": b"", "temperature": 1.0, "threshold": 0.0}


def predict(text: str | None, model: dict) -> tuple[str, float, bool]:
    """(language, score, rejected) of a whole text; und, zero and rejected if it is null or has no letter."""
    languages = model["languages"]
    if not languages or not has_letter(text):
        return UNKNOWN, 0.0, True
    product = np.frombuffer(model["product"], dtype=np.float32).reshape(BUCKETS, len(languages) + 1)
    total, n = np.zeros(len(languages) + 1), 0
    for found in subwords(text):
        total += product.take(found, axis=0).sum(axis=0, dtype=np.float64)
        n += len(found)
    p = softmax(total / max(1, n) / model["temperature"])
    best = int(p[:-1].argmax())
    return languages[best], float(p[best]), bool(1 - p[-1] < model["threshold"])


def held_out(doc_id):
    """crc32 of doc_id as text leaves 2 modulo 4; false where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _identified(docs: DataFrame) -> tuple[Aside, DataFrame]:
    whole = Aside(docs, "doc_id", "text", "lang")
    own = only(docs, "doc_id", "text", "lang")
    known = fit(own.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    # a text that isn't a string is sent beside its cast; a string is sent once
    frame, seen = whole.frame, "text"
    if frame.schema["text"].dataType.simpleString() != "string":
        frame, seen = frame.withColumn("_text", F.col("text").cast("string")), "_text"

    def run(batches):
        for batch in batches:
            found = [predict(x, shared.value) for x in batch.column(seen).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            rest = batch.select(names)
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*names, "_pred", "_score", "_rejected"])

    names = whole.frame.columns
    schema = StructType([*whole.frame.schema.fields]).add("_pred", "string").add("_score", "double").add("_rejected", "boolean")
    return whole, frame.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, others) with held_out, lang_pred, score, rejected: one row per input row.

    Learns from text and lang of the rows that aren't held out; a prediction sees the text alone. Null texts and texts
    without letters are und, score 0, rejected. If nothing is labelled, every text is und. Columns that ``docs`` has of
    those four names are replaced; an empty table gives no rows.
    """
    new = ("held_out", "lang_pred", "score", "rejected")
    whole, found = _identified(without(docs, new.__contains__))
    columns = (held_out(F.col("doc_id")), F.col("_pred"), F.col("_score"), F.col("_rejected"))
    return whole.back(found, *(c.alias(n) for c, n in zip(columns, new)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised; columns as given, whatever their names.

    Null texts and texts without letters go, as they are in no language. If no document has a label, no language is known
    and nothing can be recognised: then all documents with a letter stay.
    """
    whole, found = _identified(docs)
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)) & (F.col("_pred") == UNKNOWN)
    return whole.back(found.filter(~F.col("_rejected") | lettered))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and confidence of all documents; null texts and texts without letters are und, score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
