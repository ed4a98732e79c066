"""Mixing, URL filter, HTML extraction, embedding near-duplicates, boosting, and the pipeline."""

import html as entities
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import boosting, html, mixing, urls, vectors
from millrace.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# ---- mixing


def fluid(counts, weights, slots):
    """Blocks of each source that the ideal schedule has served after so many slots, exactly."""
    left, served = [Fraction(c) for c in counts], [Fraction(0)] * len(counts)
    time = Fraction(slots)
    while time > 0 and any(left):
        rest = sum(w for w, n in zip(weights, left) if n)
        step = min([time, *(n * rest / w for w, n in zip(weights, left) if n)])
        for i, (w, n) in enumerate(zip(weights, left)):
            if n:
                served[i] += step * w / rest
                left[i] -= step * w / rest
        time -= step
    return served


@pytest.mark.parametrize("seed", range(12))
def test_no_source_deviates_by_a_block(seed):
    rng = random.Random(seed)
    counts = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 7))]
    weights = [rng.randrange(1, 20) for _ in counts]
    plan = list(mixing.schedule(counts, weights))
    assert [p[0] for p in plan] == list(range(sum(counts)))
    done = [0] * len(counts)
    for slot, source, block, release, deadline in plan:
        assert release <= slot < deadline and block == done[source]
        done[source] += 1
        assert all(abs(d - f) < 1 for d, f in zip(done, fluid(counts, weights, slot + 1)))
    assert done == counts


def plain_schedule(counts, weights):
    """Earliest deadline first by the windows' definition: in each slot the released block with the least due slot."""
    blocks = []
    for s, n in enumerate(counts):
        ends, slot = [], 0
        times = [Fraction(0)]
        for j in range(1, n + 1):  # when the ideal schedule has served j blocks, by bisection over its pieces
            left, time = [Fraction(c) for c in counts], Fraction(0)
            served = Fraction(0)
            while served < j:
                rest = sum(w for w, c in zip(weights, left) if c)
                step = min(*(c * rest / w for w, c in zip(weights, left) if c), (j - served) * Fraction(rest, weights[s])) if left[s] else Fraction(0)
                time += step
                for i, (w, c) in enumerate(zip(weights, left)):
                    if c:
                        left[i] -= step * w / rest
                        served += step * w / rest if i == s else 0
            times.append(time)
        blocks += [(int(times[j]), -int(-times[j + 1] // 1), s, j) for j in range(n)]
    out, todo = [], set(blocks)
    for slot in range(len(blocks)):
        best = min((b for b in todo if b[0] <= slot and not any(o[2] == b[2] and o[3] < b[3] for o in todo)), key=lambda b: (b[1], b[2], b[3]))
        todo.remove(best)
        out.append((slot, best[2], best[3], best[0], best[1]))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_schedule_against_the_definition(seed):
    rng = random.Random(100 + seed)
    counts = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 5))]
    weights = [rng.randrange(1, 9) for _ in counts]
    assert list(mixing.schedule(counts, weights)) == plain_schedule(counts, weights)


def test_whole_weights():
    parts = mixing.whole_weights([0.5, 0.25, 1])
    assert sum(parts) == mixing.UNITS and parts[2] == pytest.approx(4 * parts[1]) and parts[0] == pytest.approx(2 * parts[1])
    far = mixing.whole_weights([1.0, 1e-7, 1e-30])
    assert far[1] / far[0] == pytest.approx(1e-7, rel=1e-4) and far[2] == 1
    many = mixing.whole_weights([i**0.5 for i in range(1, 301)])
    assert max(many).bit_length() <= 41 and many[-1] / many[0] == pytest.approx(300**0.5)
    assert mixing.whole_weights([1e308, 1e308]) == [mixing.UNITS // 2] * 2 and mixing.whole_weights([]) == []
    for bad in ([0.0], [-1.0], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


def test_blocks_grow_so_that_one_task_can_schedule_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    df = spark.createDataFrame([(i, "ab"[i % 3 > 0]) for i in range(700)], "doc_id long, source string")
    rows = mixing.mix(df, block=8).collect()
    assert len({(r["mix_slot"], r["mix_position"]) for r in rows}) == 700 and max(r["mix_slot"] for r in rows) < 12


def test_every_row_is_placed_once(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.choice(["a", "a", "a", "b", "c", None, ""]), f"t{i % 9}", "clash", 1) for i in range(700)] + [(1, "b", "t", "x", 2)] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string, _rank int")
    out = mixing.mix(df, {"a": 1.0, "b": 2.0}, block=8, bucket_rows=64).collect()
    assert len(out) == len(rows)
    places = [(r["mix_slot"], r["mix_position"]) for r in out]
    assert len(set(places)) == len(rows) and sorted({p[0] for p in places}) == list(range(max(p[0] for p in places) + 1))
    for source in {r["source"] for r in out}:
        own = sorted((r["mix_block"], r["mix_position"]) for r in out if r["source"] == source)
        assert own == [(i // 8, i % 8) for i in range(len(own))]
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    assert {r["_rank"] for r in out} == {1, 2}
    ordered = mixing.in_order(df, block=8)
    assert ordered.columns == df.columns and sorted(map(str, ordered.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(df.limit(0)).count() == 0


# ---- URLs


@pytest.mark.parametrize(
    "url,host,path",
    [("http://A.Example.COM/x?y#z", "a.example.com", "/x"), ("https://h", "h", ""), ("h://u@h:8/p/q#f", "u@h:8", "/p/q"), ("no scheme", "", ""), (None, "", ""), ("", "", ""),
     ("a://b?c://d/e", "b", ""), ("x://É.com/ä", "É.com", "/ä"), ("://h/p", "h", "/p")],
)
def test_host_and_path(spark, url, host, path):
    h, p = urls.host_and_path(F.col("u"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(h, p).first()) == (host, path)


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def test_judge_rules_and_learning(spark):
    rng = random.Random(2)
    made = []
    for i in range(600):
        tld, lang = rng.choice(["net", "com", "org"]), rng.choice(["en", "de", "fr"])
        name = rng.choice(["x9-99", "q-7-7"]) if tld == "net" else rng.choice(["news", "home"])
        made.append((i, f"http://{name}.example.{tld}/{lang}/{rng.randrange(99)}"))
    made += [(900, None), (901, ""), (902, "http://example.net"), (902, "http://example.net"), (903, "http://notexample.net/en/"), (904, "x" * 50_000), (905, "http://net/")]
    df = spark.createDataFrame([(*r, "clash", "rule") for r in made], "page_id long, url string, host string, verdict string")
    rows = urls.judge(df).collect()
    assert len(rows) == len(made)
    for r in rows:
        rule, verdict = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, rules=()).collect()} == {"allow"}


def test_predictions_for_hosts_that_were_not_seen(spark):
    """Trained as by default, on what rules say of other hosts' URLs, the trees say the same of each fold's."""
    host, path = urls.host_and_path(F.col("url"))
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", host.alias("h"), path.alias("p")).collect()
    known = [((r["url"], r["h"], r["p"]), float(brute_rule(r["h"], r["p"])[1] == "block")) for r in rows if brute_rule(r["h"], r["p"])[1]]
    right = []
    for k in range(4):
        seen, held = ([x for x in known if (hash_of(x[0][1]) % 4 == k) == side] for side in (False, True))
        model = urls.train([x for x, _ in seen], np.array([y for _, y in seen]))
        right += ((urls.chances([x for x, _ in held], model) > 0.5) == np.array([y for _, y in held])).tolist()
    assert len(right) == len(known) > 1000 and np.mean(right) >= 0.95


def hash_of(text):
    import zlib

    return zlib.crc32(text.encode())


def test_no_row_is_in_its_own_rates():
    """With one URL of each host and kind, labels that nothing else tells can't be learned, and rates don't tell them."""
    rng = random.Random(8)
    rows = [(f"http://h{i}.com/s{i}/", f"h{i}.com", f"/s{i}/") for i in range(200)]
    y = np.array([float(rng.random() < 0.5) for _ in rows])
    x = urls.training_features(rows, y)[:200]
    for name in ("suffix_two_rate", "segment_rate", "pair_rate"):
        column = x[:, urls.FEATURES.index(name)]
        assert abs(np.corrcoef(column, y)[0, 1]) < 0.3  # the fold's own rate leaves a little


def test_given_labels_are_learned(spark):
    rng = random.Random(5)
    label = lambda i: int(i % 2)
    rows = [(i, f"http://{'a1b2c3d4' if label(i) else 'garden'}{rng.randrange(10)}.com/p{'?a=1&b=2&c=3' if label(i) else ''}", label(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    found = urls.judge(df.drop("blocked"), rules=(), labelled=df.filter("page_id < 300")).collect()
    held = [r for r in found if r["page_id"] >= 300]
    assert np.mean([(r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in held]) > 0.95


def test_boosting_forms_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    model = boosting.fit(x, y)
    assert ((boosting.chance(model, x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = [r["m"] for r in df.select("i", F.expr(boosting.sql(model, ["a", "b", "c"])).alias("m")).orderBy("i").collect()]
    assert np.allclose(got, boosting.margin(model, x))
    flat = boosting.fit(np.zeros((0, 3)), np.zeros(0))
    assert boosting.margin(flat, x).tolist() == [flat["prior"]] * len(x)
    assert boosting.threshold(np.array([3.0, 2, 1]), np.array([1, 0, 0]), 0.99) == 3.0 and boosting.threshold(np.array([1.0]), np.array([0]), 0.9) == float("inf")


# ---- HTML


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_articles_of_the_pages(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == want
    assert {r["page_id"]: r["text"] for r in html.extract(pages, broadcast_bytes=0).collect()} == want


def page(body, side="Menu"):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><div id=top><p>Site name</p><p>Slogan</p></div><nav><a href=/>{side}</a></nav>"
        f"<div class='post-body'>{body}</div><aside>Related</aside><form><p>Search</p></form><div class='comments'><p>Great!</p></div><footer>&copy; x</footer></body></html>"
    )


def neutral(page):
    """A page without names: the article and all around it are divs without attributes."""
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|nav|header|footer|aside|form)\b", r"<\1div", page))


def test_neutral_pages_by_their_hosts_templates(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], neutral(r["html"])) for r in pages], "page_id long, url string, html string")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages}
    got = {r["page_id"]: r["text"] for r in html.extract(bare).collect()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99
    alone = {r["page_id"]: html.article(neutral(r["html"]), None, {}) for r in pages}
    assert sum(got[i] != alone[i] for i in want) > 20 and np.mean([alone[i] == want[i] for i in want]) < np.mean([got[i] == want[i] for i in want])


def of_host(pages):
    whole = None
    for p in pages:
        tree, _ = html.parse(p)
        whole = tree if whole is None else (html.unite(whole, tree), whole)[1]
    whole = html.unpacked(html.packed(whole))
    return [html.article(p, whole, {}) for p in pages]


def test_constant_slots_in_the_article_are_template():
    pages = [f"<article><h1>T{i}</h1><p>Text {i} of a page</p><div class=x>Written by our team</div></article>" for i in range(5)]
    assert of_host(pages) == [f"T{i}\nText {i} of a page" for i in range(5)]
    assert of_host([pages[0]] * 5)[0].startswith("T0\nText 0")  # copies: nothing varies, all stays


def test_templates_united_in_any_grouping(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN_IN", 2)
    rows = [(i, f"http://host{i % 2}.com/{i}", page(f"<h1>Title {i}</h1><p>Text number {i} of this host, long enough", f"Menu {i}")) for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    want = {i: f"Title {i}\nText number {i} of this host, long enough" for i in range(24)}
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == want
    assert {r["page_id"]: r["text"] for r in html.extract(df, broadcast_bytes=0).collect()} == want
    assert {r["page_id"]: r["text"] for r in html.extract(df, broadcast_bytes=0, frequent=1).collect()} == want


def page(body, side="Menu"):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><div id=top><p>Site name</p><p>Slogan</p></div><nav><a href=/>{side}</a></nav>"
        f"<div class='post-body'>{body}</div><aside>Related</aside><form><p>Search</p></form><div class='comments'><p>Great!</p></div><footer>&copy; x</footer></body></html>"
    )


def test_template_without_article_elements(spark):
    bodies = [f"<h1>Title {i}</h1><p>Text  of&nbsp;page {i} &amp; more</p><p>Line<br>two <b>bold</b>{i}" for i in range(6)]
    rows = [(i, f"http://host.com/{i}", page(b, f"Menu {i}")) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {i: f"Title {i}\nText of page {i} & more\nLine two bold{i}" for i in range(6)}


@pytest.mark.parametrize(
    "markup,text",
    [
        ("<div><article>deep" + "<div>" * 300 + "</div>" * 300 + "<p>after text</p></article></div>", "deep\nafter text"),
        ('<div style="overflow:hidden"><p>over</p></div>', "over"), ('<div data-hidden="false"><p>dh</p></div>', "dh"), ("<div hidden><p>no</p></div><p>yes</p>", "yes"),
        ('<body class="page no-sidebar"><p>x body</p></body>', "x body"), ('<article class="post has-sidebar"><p>y</p></article>', "y"), ('<p data-id="comment">z</p>', "z"),
        ("<p data-x=it's>Hello world</p><p>it's fine</p>", "Hello world\nit's fine"), ('<p title="abc>text</p><p>more</p>', "text\nmore"), ('<p title="a>b">c</p>', "c"),
        ("<article class=story><p>main story text</p></article><article class=teaser><p>tea</p></article>", "main story text"),
        ("<article class=story><p>main story</p></article><section class=comments><article><p>a comment longer than the story</p></article></section>", "main story"),
        ("<article><header><h1>T</h1></header><p>x</article><header>no</header>", "T\nx"), ("<p><b>bold<p>next</b> rest</p>", "bold\nnext rest"), ("<head><title>t</title><p>no head end", "no head end"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("a<script>x</script>b", "ab"), ("", ""),
    ],
)
def test_markup(markup, text):
    assert html.article(markup, None, {}) == text


@pytest.mark.parametrize(
    "markup",
    ["<b>" * 100_000, "<li>" * 100_000, "<div><p>" * 50_000 + "x", "<a " * 100_000, "<a b='" * 50_000, "<!--" * 100_000, "<b><div>" * 50_000 + "</b>" * 50_000, "<" * 200_000,
     "<article>" + "".join(f"<p>a{j}</p><h2>b{j}</h2>" for j in range(20_000)), "<article>" + "".join(f"<div class=c{chr(97 + j * j % 26)}>{j}</div>" for j in range(20_000)),
     "<article>" + "".join(f"<{x}>" for x in ("div", "section") * 20_000) + "deep"],
)
def test_hostile_pages_end_soon(markup):
    import time

    at = time.perf_counter()
    of_host([markup, markup + "<p>more"])
    assert time.perf_counter() - at < 20


def test_page_edges(spark):
    rows = [(1, "http://a/1", None), (2, None, ""), (3, "http://a/2", "<p>only <i>one</i> page"), (3, "http://a/2", "<p>only <i>one</i> page"), (4, "", "no markup at all"), (5, "http://b/", "<<<a <p"),
            (6, "http://c/", "<article>" + "<div>" * 3000 + "deep" + "</article>"), (7, "http://d/", "<article><p>" + "long " * 50_000 + "</article>"), (8, "http://e", "<article><p>x<!-- c --><style>s</style><p>&lt;b&gt;</article>after"),
            (None, "http://f", "<p>no id")]
    df = spark.createDataFrame([(*r, "clash", "t") for r in rows], "page_id long, url string, html string, host string, text string")
    found = html.extract(df).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: r["text"] for r in found}
    assert got[1] == got[2] == "" and got[3] == "only one page" and got[4] == "no markup at all" and got[6] == "deep" and len(got[7]) == 249_999 and got[8] == "x\n<b>" and got[None] == "no id"
    assert html.extract(df.limit(0)).count() == 0


def tree_of(rng, depth):
    node = html.Node("", rng.choice("ab"), False)
    node.kids = [tree_of(rng, depth - 1) for _ in range(rng.randrange(3))] if depth else []
    return node


def test_simple_tree_matching_is_the_largest_mapping():
    rng = random.Random(3)

    def brute(a, b):
        if a.name != b.name:
            return 0
        def best(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0
            return max(best(i + 1, j), best(i, j + 1), brute(a.kids[i], b.kids[j]) + best(i + 1, j + 1))
        return 1 + best(0, 0)

    for _ in range(60):
        a, b = tree_of(rng, 3), tree_of(rng, 3)
        assert html.match(a, b)[0] == brute(a, b)


def test_many_siblings_are_matched_like_few():
    rng = random.Random(8)

    def full(a, b):
        if a.name != b.name:
            return 0, []
        x, y = a.kids, b.kids
        each = {(i, j): full(p, q) for i, p in enumerate(x, 1) for j, q in enumerate(y, 1) if p.name == q.name}
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + each.get((i, j), (0,))[0])
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if (i, j) in each and best[i][j] == best[i - 1][j - 1] + each[i, j][0]:
                i, j = i - 1, j - 1
                pairs.append((i, j, each[i + 1, j + 1][1]))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return 1 + best[-1][-1], pairs[::-1]

    for n, m in ((3, 4), (9, 30), (99, 101), (130, 120), (40, 300)):
        a, b = html.Node("", "a", False), html.Node("", "a", False)
        a.kids, b.kids = [tree_of(rng, 2) for _ in range(n)], [tree_of(rng, 2) for _ in range(m)]
        assert html.match(a, b) == full(a, b)


def test_packed_templates_come_back():
    tree, _ = html.parse(page("<h1>T</h1><p>a<p>b<ul><li>c</ul>"))
    assert html.packed(html.unpacked(html.packed(tree))) == html.packed(tree)


# ---- embeddings


def brute_links(rows, threshold=0.95):
    good, unit = [], []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(ok)
        unit.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in near[i])])
            changed |= low < label[i]
            label[i] = low
    return [(rows[i][0], len(near[i]), rows[label[i]][0]) for i in range(n)]


def clustered(rng, n, d=16):
    centres = rng.normal(size=(12, d))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.02, 0.2, 3.0])
        out.append((i, v.astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = clustered(rng, 400)
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None] * 8), (2005, [1.0, 0.0]), (2006, [2.0, 0.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string").repartition(4)
    got = vectors.near_vectors(df, cell=40, block=block).collect()
    want = brute_links(rows)
    pairs = sum(n for _, n, _ in want)
    assert len(got) == len(rows) and sum(r["n_links"] for r in got) >= 0.99 * pairs
    if sum(r["n_links"] for r in got) == pairs:
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("effective,d", [(3, 64), (6, 256), (16, 128)])
@pytest.mark.parametrize("margin", [vectors.MARGIN, None])
def test_recall_on_uneven_vectors(spark, effective, d, margin):
    """Vectors that vary in few directions, half of them near copies of the others: all links found with the exact reach."""
    rng = np.random.default_rng(effective)
    base = rng.normal(size=(500, effective)) @ rng.normal(size=(effective, d))
    rows = np.concatenate([base, base + 0.2 * rng.normal(size=base.shape) @ np.diag(np.arange(1, d + 1) ** -0.5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, margin=margin, cell=40, block=64).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.sum() > 500 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) == want.sum() if margin is None else sum(got.values()) >= 0.99 * want.sum()


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    lone = vectors.near_vectors(spark.createDataFrame([(1, None), (None, [0.0])], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in lone) == [("1", 0, True), ("None", 0, False)]
    tiny = vectors.near_vectors(spark.createDataFrame([(1, [1e-30, 0.0]), (2, [1e30, 0.0])], schema)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in tiny} == {(1, 1, 1), (2, 1, 1)}


# ---- pipeline


def test_pipeline_stages(spark, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs = docs.checkpoint()
            left = docs.count()
            assert (left < n) if name == "near_duplicates" else (left == n or name == "language" and left > 0.98 * n), name
            n = left
    assert docs.count() == n and set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
