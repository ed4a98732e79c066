"""Operators on texts: BPE, fingerprints, SimHash, language, personal data, scores. Brute force, round trips, edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, digest, language, lm, pii, simhash
from millrace.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, bucket int, held_out string, fingerprint string, spans string"
EDGES = [
    (0, "The cat sat on the mat, and the dog ate it.", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, "   \t\n ", "de"),
    (4, "Der Hund und die Katze sitzen auf der Matte im Haus.", "de"),
    (5, "The cat sat on the mat, and the dog ate it.", "en"),
    (5, "The cat sat on the mat, and the dog ate it.", "en"),
    (None, "no id here at all", None),
    (7, "12345 67890 !!", "en"),
    (8, "wörd " * 40_000, "de"),
    (9, "x" * 100_000, "en"),
    (10, "😀 emoji \x1c sep   line \xa0 space", None),
]


@pytest.fixture(scope="module")
def edges(spark):
    ship(spark)
    rows = [(i, t, lang, "s", 1, "clash", 3, "x", "y", "z") for i, t, lang in EDGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    ship(spark)
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- byte-level BPE


def reference_encoding():
    import tiktoken

    path, pattern = bpe.default_codec()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_public_encoder(docs, edges):
    want = reference_encoding()
    for df in (docs.select("doc_id", "text"), edges):
        for r in bpe.encode(df).join(df.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
            text = r["text"] or ""
            assert r["ids"] == want.encode_ordinary(text)
            assert bytes(r["decoded"]) == text.encode()


def test_bpe_every_kind_of_character():
    tool, want = bpe.codec(*bpe.default_codec()), reference_encoding()
    for start in range(0, 0x11000, 64):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert tool.encode(text) == want.encode_ordinary(text)


def test_bpe_digests_and_rows(edges):
    rows = bpe.digests(bpe.encode(edges)).collect()
    assert len(rows) == len(EDGES)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == r["decoded_sha256"] == empty and r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert bpe.encode(edges.limit(0)).count() == 0


# ---- fingerprints


def brute_entropy(window):
    shares = np.bincount(window)
    shares = shares[shares > 0] / len(window)
    return round(float(-(shares * np.log2(shares)).sum()) / math.log2(len(window)) * 1000)


@pytest.mark.parametrize("window", [64, 16])
def test_entropies_and_selection(window):
    raw = np.frombuffer((" ".join(random.Random(1).choices("the of and entropy window feature rare".split(), k=120))).encode(), dtype=np.uint8)
    found = digest.entropies(raw, window)
    assert all(abs(found[i] - brute_entropy(raw[i : i + window])) <= 1 for i in range(len(found)))
    rank = digest.RANKS[window][found]
    votes = Counter(int(min(range(i, i + window), key=lambda j: (rank[j], j))) for i in range(len(rank) - window + 1))
    assert digest.features([raw], window)[0].tolist() == sorted(i for i, n in votes.items() if n >= window // 4 and rank[i] <= 1000)


@pytest.mark.parametrize("window", [64, 16])
def test_features_do_not_depend_on_pieces(monkeypatch, window):
    raw = np.frombuffer(" ".join(random.Random(2).choices("alpha beta gamma delta eps".split(), k=2000)).encode(), dtype=np.uint8)
    texts = [raw, raw[:63], raw[:64], raw[5:100], raw[:126], raw[:127], raw[:141], raw[:900], raw[300:1000], raw[:0], raw[:16]]
    alone = [digest.features([x], window)[0].tolist() for x in texts]
    assert all(len(a) > 0 for a, x in zip(alone, texts) if len(x) >= window)
    assert [x.tolist() for x in digest.features(texts, window)] == alone
    monkeypatch.setattr(digest, "PIECE", 1000)
    assert [x.tolist() for x in digest.features(texts, window)] == alone


def test_entropy_counts_and_ranks(docs, edges):
    for df in (docs, edges):
        texts = [np.frombuffer((r["text"] or "").encode(), dtype=np.uint8) for r in df.select("text").collect()]
        for window, n in digest.entropy_counts(df.select("text")).items():
            own = [x for x in texts if len(x) >= window and (len(x) >= 512 if window == 64 else len(x) < 1024)]
            want = sum((np.bincount(digest.entropies(x, window), minlength=1001) for x in own), np.zeros(1001, np.int64))
            assert (n == want).all()
    counts = np.zeros(1001, np.int64)
    counts[600:700], counts[300] = 1000, 1
    rank = digest.ranks(counts)
    assert rank[300] < rank[650] and (rank[: digest.REGULAR] == 1001).all() and rank[900] < rank[300]


def test_fingerprints_against_plain_neighbours(docs, edges):
    for df in (docs, edges):
        got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"], r["n_chars"]) for r in digest.compare_neighbours(df, 50).collect())
        tables = {w: digest.ranks(n) for w, n in digest.entropy_counts(df.select("text")).items()}
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["tie"], r["text"]) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect())
        want = []
        for i, (key, _, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][2]
            new = digest.edited(text, following)
            chain = digest.fingerprint(text, tables)
            want.append((key, hashlib.sha256(new.encode()).hexdigest(), digest.text_form(chain), digest.likeness(chain, digest.fingerprint(new, tables)), digest.likeness(chain, digest.fingerprint(following, tables)), len(text)))
        assert got == sorted(want)
    assert digest.compare_neighbours(edges.limit(0)).count() == 0


def test_many_rows_of_one_id_are_split(spark):
    """All rows without an id, or with the same one: buckets are ranges of id and text hash, so they still divide them."""
    rows = [(None if i % 2 else 7, f"text {i} " * 30) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    first, second = digest._bounds(df.select("doc_id", "tie"), 600, 12)
    assert len(first) == 11 and len(set(zip(first.tolist(), second.tolist()))) == 11
    got = digest.compare_neighbours(df, 50).collect()
    order = [r["text"] for r in df.orderBy(F.asc_nulls_first("doc_id"), "tie").collect()]
    want = sorted(hashlib.sha256(digest.edited(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in got) == want


def test_short_texts_are_alike_after_an_edit(docs):
    texts = [r["text"] for r in docs.collect() if r["text"] and 100 <= len(r["text"]) < 700]
    near = [digest.likeness(*digest.fingerprints([t, digest.edited(t, texts[i - 1])])) for i, t in enumerate(texts)]
    far = [digest.likeness(*digest.fingerprints([t, texts[i - 3]])) for i, t in enumerate(texts)]
    assert len(texts) > 10 and np.median(near) > 0.6 and min(near) > 0.3 and np.median(far) < 0.1


def test_likeness_bounds():
    a, b = digest.fingerprint("some words that make a text " * 30), digest.fingerprint("quite other content stands here " * 30)
    empty = digest.fingerprint("")
    assert digest.likeness(a, a) == 1.0 and digest.likeness(empty, empty) == 1.0 and digest.likeness(a, empty) == 0.0
    assert 0 <= digest.likeness(a, b) < 0.3 and digest.likeness(a, b) == digest.likeness(b, a)
    assert (digest.from_text(digest.text_form(a)) == a).all()


# ---- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, threshold=2):
    least = {}
    prints = [f for _, f in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                label[root(i)] = root(j)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def test_simhash_against_brute_force(docs, edges):
    for df in (docs, edges):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(d), f, str(c)) for (d, f), c in zip(rows, brute_components(rows)))
        got = sorted((str(r["doc_id"]), r["fingerprint"] & (2**64 - 1), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
        assert got == want


def test_anchor_links_lose_none(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(120)}
    for f in list(prints)[:60]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                g ^= 1 << b
            prints.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    classes = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(classes).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and want


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.deduplicate])
def test_visits_never_pass_through_the_driver(docs, operator, monkeypatch):
    plans, found = [], simhash.links

    def links(*given):
        out = found(*given)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "links", links)
    assert operator(docs).count()
    assert len(plans) == 1 and "Join" in plans[0] and "Broadcast" not in plans[0]


def test_components_of_a_long_chain(spark):
    from millrace.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each(edges):
    kept = sorted(str(r["doc_id"]) for r in simhash.deduplicate(edges).collect())
    assert kept == sorted(map(str, [0, 1, 4, 7, 8, 9, 10, None]))
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def test_deduplicate_keeps_unlike_texts_without_or_with_the_same_id(spark, edges):
    a, b, c, d = (" ".join(f"{k}{i * i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (7, d), (7, a + " " + d), (7, d), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (3, c), (7, d), (7, a + " " + d)], key=str)
    assert simhash.deduplicate(edges).columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(edges).collect()) == sorted(map(str, [0, 1, 4, 7, 8, 9, 10, None]))


# ---- language


def test_language_held_out_accuracy(docs):
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held if r["lang"]]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_rejection_is_calibrated_against_texts_in_no_language(spark, docs):
    given = docs.select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.fit(given)
    assert 0 < model["threshold"] < 1
    texts = [r["text"] for r in given.filter("held_out").collect() if r["text"] and len(r["text"]) > 40]
    assert np.mean([language.predict(t, model)[2] for t in texts]) < 0.02
    wrong = [language.predict(language.no_language(t[:200], 3 * i + k), model)[2] for i, t in enumerate(texts) for k in range(3)]
    assert np.mean(wrong) > 0.8
    # calibration itself: between separable scores the threshold lies between, and a real text is never given up for it
    logits = np.array([[5.0, 0.0]] * 50 + [[0.0, 5.0]] * 50)
    temperature, threshold = language.calibrate(logits, np.array([0] * 50 + [1] * 50), np.array([0] * 50 + [3] * 50))
    known = 1 - language.softmax(logits / temperature)[:, -1]
    assert known[50] < threshold <= known[0]
    assert language.calibrate(np.zeros((0, 2)), np.zeros(0, int), np.zeros(0, int)) == (1.0, 0.0)


def test_language_edges(edges):
    rows = language.identify(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        letters = bool(r["text"]) and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert language.identify(edges.limit(0)).count() == 0
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    lettered = sum(bool(t) and any(map(str.isalpha, t)) for _, t, _ in EDGES)
    assert language.keep_identified(unlabelled).count() == lettered and language.keep_identified(edges.limit(0)).count() == 0


def test_subwords_hold_each_run_once(monkeypatch):
    text = "abcdefghij" * 30
    whole = np.sort(np.concatenate(list(language.subwords(text))))
    monkeypatch.setattr(language, "PIECE", 64)
    assert (np.sort(np.concatenate(list(language.subwords(text)))) == whole).all()
    assert len(whole) == sum(len(text) + 2 - n + 1 for n in language.LENGTHS)


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PIECES = ["a@b.co", "a.b@c-d.ef.gh", "a@b.c_d@e.f", "user@localhost", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1112",
          "+1 (988) 555-2485", "+12 3", "+1 2 3 4 5 6 7 8 9 10 11 12", "é😀", "word", "\n", ",", "0" * 40, "+", "@", "."]


def test_base_spans_against_brute_force(spark, docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "x"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (made, docs.select("doc_id", "text")):
        rows = pii.find(df).select("text", pii.written(F.col("base")).alias("base"), "base", "spans").toDF("text", "written", "base", "spans").collect()
        for r in rows:
            assert r["written"] == brute_spans(r["text"]), r["text"]
            assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
            assert not any(s["start"] < b["end"] and b["start"] < s["end"] for s in r["spans"] if s not in r["base"] for b in r["base"])


def test_hostile_texts_end(spark):
    hard = ["1" * 20_000, "4111111111111111, " * 20_000, "a" * 100_000, "a." * 30_000 + "@" + "b." * 30_000 + "c", "+" + "1 " * 30_000, "1.2.3.4" * 2_000, "a@b.c " * 2_000]
    rows = pii.find(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).select("doc_id", F.size("base").alias("n")).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["doc_id"])][-1] == 2_000


def test_wider_spans_and_redaction(spark):
    texts = ["call tel 555-123-4567 now", "mail john [at] site [dot] com", "order 4111.1111.1111.1112 x", "a@b.co and 1.2.3.4", None, "nothing"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = by_id(pii.redact(df))
    assert rows[0]["text"] == "call tel [PHONE] now" and rows[1]["text"] == "mail [EMAIL]" and rows[3]["text"] == "[EMAIL] and [IP]"
    assert rows[4]["text"] is None and rows[5]["text"] == "nothing" and rows[0]["n_chars"] == 20 and rows[5]["n_chars"] == 9


def test_times_grow_with_the_number_of_spans(spark):
    import time

    texts = ["card 4111.1111.1111.1111 a@b.co 1.2.3.4, tel 555-123-4567; " * n for n in (20_000, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = time.perf_counter()
    rows = sorted(pii.find(df, ["doc_id"]).collect(), key=lambda r: r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert time.perf_counter() - at < 90
    assert text[0] == text[1] * 20_000 and "1" not in text[1] and "[CARD] [EMAIL] [IP]" in text[1]
    assert len(rows[0]["spans"]) == 20_000 * len(rows[1]["spans"]) == 20_000 * 4
    kinds = ["email", "ip", "card", "phone", "secret"]
    assert rows[0]["spans"] == sorted(rows[0]["spans"], key=lambda s: (kinds.index(s["kind"]), s["start"]))


def test_running_joins_all_before(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(-9, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 64, 100])]
    df = spark.createDataFrame(rows, "i int, x array<int>")
    for r in df.select("i", pii.running(F.col("x"), lambda a, b: a + b).alias("s"), pii.running(F.col("x"), F.greatest).alias("m")).collect():
        x = rows[r["i"]][1]
        assert r["s"] == np.cumsum(x).tolist() and r["m"] == np.maximum.accumulate(x or [0]).tolist()[: len(x)]


def test_trees_decide_about_wide_candidates(spark):
    """The same formats, kept or dropped by what stands around them or by their digits."""
    texts = ["call 555-123-4567 now", "order 555-123-4567", "card 4111.1111.1111.1111", "ref 4111.1111.1111.1112", "api_key: 2d480315a6562b81c25342984c4087344558d00e",
             "commit 2d480315a6562b81c25342984c4087344558d00e", "10 100 1000 and 20.000.000 EUR", "path usr/local/share/doc/package/v12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(df).collect()}
    assert got == {0: ["phone"], 1: [], 2: ["card"], 3: [], 4: ["secret"], 5: [], 6: [], 7: []}


def test_filters_on_results_can_be_planned(spark, docs):
    assert pii.redact(docs).filter("text like '%[EMAIL]%'").count() > 0
    assert pii.find(docs).filter("size(spans) > 0").count() > 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _rank int, _offset string, _slots array<int>, _email string, base string, spans int, score string, held_out date, _mark int, Text string, kind string, _row int, c0 int, _text binary"


def test_columns_of_any_name_come_back_value_for_value(spark, edges):
    import corpus_pipeline

    assert spark
    texts = [*(t for _, t, _ in EDGES[:5]), *(" ".join(f"the {k}{i * i} of and {i}" for i in range(30)) for k in "abcdefgh")]
    rows = [(None if i % 3 == 0 else i // 2, t, "en" if i % 4 else None, "ab"[i % 2], len(t or ""), i, str(i), [i], f"e{i}", "b", i, "s", None, -i, f"T{i}", "k", i, i, b"x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CLASHING)
    rest = lambda frame: {r["_rank"]: tuple(v for c, v in zip(frame.columns, r) if c not in ("text", "n_chars")) for r in frame.collect()}
    given, texts_of = rest(df), {r["_rank"]: r["text"] for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        after = rest(out)
        assert all(given[k] == v for k, v in after.items()), name
        assert {r["_rank"]: r["text"] for r in out.collect()} == {k: texts_of[k] for k in after}, name
        if name in ("personal_data", "mixing"):
            assert len(after) == len(rows)
        if name == "near_duplicates":  # null, empty and blank texts are alike; all others differ
            assert len(after) == len(rows) - 2
        if name == "language":
            assert len(after) >= len(rows) - 3
    assert len(simhash.near_duplicates(df).collect()) == len(digest.compare_neighbours(df).collect()) == len(bpe.encode(df).collect()) == len(rows)
    assert len(lm.scores(df, df).collect()) == len(rows) == len(mixing_rows(df))


def mixing_rows(df):
    from millrace.llm import mixing

    return mixing.mix(df).collect()


def test_personal_data_edges(edges):
    found = pii.find(edges, ["doc_id", "tie", "spans"])
    assert found.count() == len(EDGES) and pii.find(edges.limit(0)).count() == 0
    assert pii.redact(edges).columns == edges.columns


# ---- scores


def plain_scores(rows, held):
    counts, words = Counter(), []
    for doc, text in rows:
        own = (text or "").encode().lower().split() + [None]
        words.append(own)
        if not held(doc):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for w in words]


@pytest.mark.parametrize("frequent", [1 << 18, 8])
def test_base_scores_against_plain_counts(docs, edges, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for df in (docs.select("doc_id", "text"), edges):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        n, want = plain_scores(rows, held)
        got = lm.scores(df, df.filter(~lm.held_out())).collect()
        assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
        left = sorted((str(d), t, k, round(b, 6)) for (d, _), (t, k, b) in zip(rows, want))
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == left


def test_model_scores_are_probabilities_and_learn(docs):
    df = docs.select("doc_id", "text")
    got = lm.scores(df, df.filter(~lm.held_out())).collect()
    assert all(r["score"] < 0 for r in got)
    assert np.mean([r["bits_per_byte"] for r in got]) < 4


def test_trees_against_a_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(lm, "DEPTH", 2)
    monkeypatch.setattr(lm, "CONTEXTS", 40)
    text = b"abracadabra abba cab " * 9 + b"xyz"
    cells = np.concatenate([lm.cells(p) for p in lm.pieces(text)]).astype(np.int64)
    keys, n = np.unique(cells, return_counts=True)
    frame = spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long")
    trees = lm.Trees(lm.tree_counts(frame, len(cells)))
    assert np.allclose((10.0 ** trees.logs.astype(float)).sum(axis=1), 1, atol=1e-4)

    padded = bytes(2) + text + b"\xff"
    after = [(padded[i - 1 :: -1][:2], padded[i]) for i in range(2, len(padded))]  # bytes before, nearest first

    def symbols(context):
        return [x for before, x in after if before[: len(context)] == context]

    def kids(context):
        return [c for c in {before[: len(context) + 1] for before, _ in after if before[: len(context)] == context} if len(symbols(c)) * 40 >= len(after)] if len(context) < 2 else []

    def ab(some, prefix, level):
        bits = [x >> (7 - level) & 1 for x in some if x >> (8 - level) == prefix]
        return bits.count(0), bits.count(1)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def rest(context):
        taken = kids(context)
        return [x for before, x in after if before[: len(context)] == context and before[: len(context) + 1] not in taken]

    def below(context, prefix, level):
        return kt(*ab(rest(context), prefix, level)) + sum(weighted(c, prefix, level) for c in kids(context))

    def weighted(context, prefix, level):
        own = kt(*ab(symbols(context), prefix, level))
        return own if len(context) == 2 else np.logaddexp(own, below(context, prefix, level)) - math.log(2)

    def predict(path, context, prefix, level, bit):
        def chance(some):
            counts = ab(some, prefix, level)
            return (counts[bit] + 0.5) / (sum(counts) + 1)

        if len(context) == 2:
            return chance(symbols(context))
        share = 1 / (1 + math.exp(below(context, prefix, level) - kt(*ab(symbols(context), prefix, level))))
        deeper = path[: len(context) + 1]
        inner = predict(path, deeper, prefix, level, bit) if deeper in kids(context) else chance(rest(context))
        return share * chance(symbols(context)) + (1 - share) * inner

    def plain(string):
        padded, total = bytes(2) + string + b"\xff", 0.0
        for i in range(2, len(padded)):
            for level in range(8):
                total += math.log10(predict(padded[i - 1 :: -1][:2], b"", padded[i] >> (8 - level), level, padded[i] >> (7 - level) & 1))
        return total

    for string in (b"", b"abba", b"zq cab"):
        assert abs(plain(string) - trees.score(string)) < 1e-3


@pytest.mark.parametrize("kept", [1 << 22, 8])
def test_every_context_of_sixteen_bytes_is_scored(docs, edges, kept, monkeypatch):
    """Against the local trees, given each context of 16 bytes or more as a node; with few cells kept, most are joined."""
    monkeypatch.setattr(lm, "KEPT", kept)
    for df in (docs.select("doc_id", "text").limit(60), edges):
        df = df.checkpoint()
        training = df.filter(~lm.held_out())
        counts = lm.count(training).filter(F.col("kind") == lm.CONTEXT).select("key", "n").checkpoint()
        total = counts.agg(F.sum("n")).first()[0]
        monkeypatch.setattr(lm, "CONTEXTS", total / 16 + 1e-6)
        trees = lm.Trees(lm.tree_counts(counts, total))
        want = sorted((str(r["doc_id"]), trees.score(lm._lowered(r["text"]))) for r in df.collect())
        got = sorted((str(r["doc_id"]), r["score"]) for r in lm.scores(df, training, df.filter(lm.held_out())).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-5, atol=1e-3)


def test_nodes_grow_with_the_training_texts(spark):
    """A context seen 20 times is used however many other bytes there are."""
    rng = random.Random(2)
    filler = [(2 * i + 10, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(2000))) for i in range(130)]
    docs = spark.createDataFrame([(1, "qzxwv" * 20), *filler], "doc_id long, text string")
    row = lm.scores(docs.filter("doc_id = 1"), docs).first()
    assert row["bits_per_byte"] < 1.5


def test_counts_and_scores_do_not_depend_on_pieces(spark, monkeypatch):
    text = b"some text to be cut " * 20
    whole = np.concatenate([lm.cells(p) for p in lm.pieces(text)])
    keys, n = np.unique(whole, return_counts=True)
    trees = lm.Trees(lm.tree_counts(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long"), len(whole)))
    score = trees.score(text)
    monkeypatch.setattr(lm, "PIECE", 7)
    assert np.concatenate([lm.cells(p) for p in lm.pieces(text)]).tolist() == whole.tolist() and len(whole) == len(text) + 1
    assert abs(trees.score(text) - score) < 1e-6


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 8000").select("doc_id", "text")
    held = [r for r in lm.scores(docs, docs.filter(~lm.held_out())).filter(lm.held_out()).collect()]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_without_rows_or_training(edges):
    assert lm.scores(edges.limit(0), edges.limit(0)).count() == 0
    rows = lm.scores(edges, edges.limit(0)).collect()
    assert len(rows) == len(EDGES) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
