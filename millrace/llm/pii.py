"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Four base kinds (email, ip, card, phone) have fixed formats; whatever meets them is a span. Wider generators propose
further, overlapping candidates: spelled-out or bracketed emails, IPv6 addresses, card numbers with other separators,
national and prefixed phone numbers, and, as a fifth kind, long random strings that may be secrets. Boosted trees weigh a
candidate's format and the words around it; a threshold for each kind, calibrated to a precision on held-back examples,
selects. The trees are fitted on the driver on bounded examples: matches of the base formats in a sample of the documents,
whose labels say whether they are valid or near misses (a failed Luhn sum, an octet over 255, too few or many digits), and
examples made from format rules for the formats that the documents may lack. On the executors they are a SQL expression.

Every pattern is written so that a regular-expression engine needs linear time and constant stack: possessive loops, and
starts only where a run of the pattern's first characters begins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import Aside, hash_bound, only, table

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
PRECISION = 0.99
EXAMPLES = 6000
SAMPLE, SAMPLED = 4000, 4000  # documents that are looked through for examples, and examples taken from them

#: The base formats. Possessive forms match what the plain greedy ones do, as nothing after a loop can match inside it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a valid span of a base format to occur at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}
#: Wider generators, with the kind that each proposes.
WIDE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\.)\s?[A-Za-z0-9-]{1,63}+){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    ("secret", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[0-9A-Za-z+/_-]{24,128}+(?![0-9A-Za-z+/_-])"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20.-][0-9]{1,4}(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9])"),
)
BEFORE, AFTER = 24, 12
HINTS = {
    "contact": r"(?:tel|phone|call|fax|mobile|cell|telefon|handy|tél|tel[eé]fono|m[oó]vil|appel)[\s:.]*$",
    "payment": r"(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pan)[\s:.#]*$",
    "address": r"(?:mail|e-mail|contact|write to|ip|host|server|address|from)[\s:.]*$",
    "secret": r"(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential|signature)[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$",
    "digest": r"(?:sha-?[0-9]*|md5|commit|revision|checksum|hash|etag|digest|build|uuid|blob)[\"']?\s*[:=@/]?\s*[\"']?$",
    "number": r"(?:order|invoice|no|nr|num|page|p|id|ref|version|v|isbn|section|art|item|part|serial|#|\$|€|£)[\s:.#]*$",
}
FEATURES = ("digits", "letters", "length", "separators", "kinds_of_separator", "groups", "parentheses", "leading_zero", "luhn", "contact", "payment", "address", "secret", "digest", "number", "after_unit", "in_run", "joined", "ten_digits")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        # a part of more than three digits is at most 255 only with leading zeros
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, need: str) -> Column:
    """struct<pieces, found>: all matches of a pattern and the texts before, between and after them."""
    some = text.rlike(need)
    pieces = F.when(some, F.split(text, pattern, -1)).otherwise(F.array(text))
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.struct(pieces.alias("pieces"), found.alias("found"))


_POWERS = [1 << k for k in range(31)]


def running(values: Column, join) -> Column:
    """Each element joined with all before it, for an associative ``join``, in n log n steps."""
    steps = F.filter(F.array(*map(F.lit, _POWERS)), lambda k: k < F.size(values))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, join(x, F.get(acc, i - k))).otherwise(x)))


def _spans(at: Column) -> Column:
    """array<struct<start, end, value, before, after>> of a located struct; code points, ends exclusive."""
    n = F.size(at["found"])
    ends = running(F.zip_with(F.slice(at["pieces"], F.lit(1), n), at["found"], lambda p, v: F.length(p) + F.length(v)), lambda x, y: x + y)
    return F.transform(
        ends,
        lambda end, i: F.struct(
            (end - F.length(F.get(at["found"], i))).alias("start"),
            end.alias("end"),
            F.get(at["found"], i).alias("value"),
            F.lower(F.right(F.get(at["pieces"], i), F.lit(BEFORE))).alias("before"),
            F.lower(F.left(F.get(at["pieces"], i + 1), F.lit(AFTER))).alias("after"),
        ),
    )


def _features(c: Column) -> dict[str, Column]:
    """Format and context features of a candidate (fields value, before, after), as doubles."""
    value, before, after = c["value"], c["before"], c["after"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    separators = F.regexp_replace(value, "[0-9A-Za-z]", "")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    out = {
        "digits": F.length(digits).cast("double"),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
        "length": F.length(value).cast("double"),
        "separators": F.length(separators).cast("double"),
        "kinds_of_separator": F.size(F.array_distinct(F.split(separators, ""))).cast("double"),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"),
        "parentheses": flag(F.contains(value, F.lit("("))),
        "leading_zero": flag(value.startswith("0")),
        "luhn": flag(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))),
        "after_unit": flag(after.rlike(r"^\s?(?:%|eur|usd|km|kg|cm|mm|mb|gb|pp|pages|am|pm|[/:=*])")),
        "in_run": flag(before.rlike(r"[0-9][\x20.,;:|/-]{1,2}$") | after.rlike(r"^[\x20.,;:|/-]{1,2}[0-9]")),
        "joined": flag(before.rlike(r"[\p{L}0-9_/#$€£]$") | after.rlike(r"^[\p{L}0-9_]")),
        "ten_digits": flag(F.length(digits) == 10),
    }
    out |= {k: flag(before.rlike(p)) for k, p in HINTS.items()}
    return {k: out[k] for k in FEATURES}


def examples(seed: int = 5, n: int = EXAMPLES) -> list[tuple[str, str, str, str, int]]:
    """(kind, value, before, after, label): made candidates of the wider generators, a third of them not personal data."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9)))
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def with_luhn(k):
        body = number(k - 1)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    out = []
    for _ in range(n):
        kind = pick(*EVERY)
        good = rng.random() < 0.6
        before = pick("", word() + " ", word() + ", ", word() + " " + word() + " ")
        after = pick("", " " + word(), ".", ", " + word())
        if kind == "email":
            if good:
                value = f"{word()}{pick('.', '_', '')}{word()}{pick(' [at] ', '(at)', '[@]', ' (at) ')}{word()}{pick('.', ' [dot] ', '(dot)')}{pick('com', 'org', 'net', 'de')}"
                before += pick("", "mail: ", "contact ", "write to ")
            else:
                value = f"{word()}(at){number(1)}.{number(2)}" if rng.random() < 0.5 else f"{number(2)} (at) {number(1)}.{number(1)}"
        elif kind == "ip":
            value = ":".join("".join(rng.choice(list("0123456789abcdef"), rng.integers(1, 5))) for _ in range(8))
            if not good:
                value, before = ":".join(number(2) for _ in range(8)), before + pick("#", "id ", "no. ")
            else:
                before += pick("", "ip ", "host ", "server: ")
        elif kind == "secret":
            size = pick(24, 32, 40, 40, 48, 64)
            letters = pick("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
            value = "".join(rng.choice(list(letters), size))
            if good:
                before += pick("token = ", "token: ", "api_key=", "secret: ", "password = ", "auth ", "key ") + pick('"', "'", "")
            elif rng.random() < 0.5:
                before += pick("commit ", "sha256:", "md5 ", "revision ", "checksum: ", "build ")
            else:
                value = pick("/", "-", "_").join(word() for _ in range(6)) + "/" + number(4)
        elif kind == "card":
            mark = pick(".", "/", "_")
            digits = with_luhn(16) if good else number(16)
            value = mark.join(digits[i : i + 4] for i in range(0, 16, 4))
            before += pick("", "card ", "visa: ") if good else pick("", "order ", "id ", "ref ")
        else:
            if good:
                value = pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"00{pick('1', '44', '49', '33')} {number(3)} {number(3)} {number(4)}")
                before += pick("", "tel ", "call ", "phone: ", "mobile ", "fax ")
            else:
                value = pick(f"{number(2)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)} {number(4)}", f"{number(2)} {number(3)} {number(3)}", f"{number(2)} {number(3)} {number(4)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)}-{number(4)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}")
                before += pick("", "", "order ", "no. ", "page ", "ref ", "isbn ", "$", "version ", "#")
                after = pick(after, " eur", "%", " km", "/", ":")
                if rng.random() < 0.4:  # one of a row of numbers
                    mark = pick(" ", ", ", "-", ".")
                    before, after = pick("", word() + " ") + number(3) + mark, pick("", mark + number(3))
        out.append((kind, value, before[-BEFORE:].lower(), after[:AFTER].lower(), int(good)))
    return out


@lru_cache(maxsize=1)
def _made() -> tuple:
    return tuple(examples())


def _sampled(docs: DataFrame) -> DataFrame:
    """(kind, value, before, after, label) of matches of the base formats in a sample of texts, those of least hash."""
    rows = max(1, docs.count())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.filter(F.xxhash64("text", F.lit("sample")) <= hash_bound(SAMPLE / rows)).select(text.alias("text")).filter(F.col("text").rlike("[0-9@]"))
    located = some.select(*(_located(F.col("text"), BASE[k], NEEDS[k] if k == "email" else BASE[k]).alias(k) for k in KINDS))
    named = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"))
    each = F.concat(*(F.transform(_spans(F.col(k)), named(k)) for k in KINDS))
    found = located.select(F.explode(each).alias("s")).select("s.*").filter((F.length("value") >= 6) & (F.length("value") <= 80))
    valid = F.coalesce(*(F.when(F.col("kind") == k, _valid(k, F.col("value"))) for k in KINDS))
    return found.withColumn("label", valid.cast("int")).orderBy(F.xxhash64("value", "before"), "kind").limit(SAMPLED)


def fit(docs: DataFrame) -> dict[str, tuple[str, float]]:
    """For each kind the trees as SQL over the features' names, and the calibrated threshold on the log odds."""
    made = docs.sparkSession.createDataFrame(list(_made()), "kind string, value string, before string, after string, label int")
    rows = made.withColumn("wide", F.lit(True)).unionByName(_sampled(docs).withColumn("wide", F.lit(False)))
    c = F.struct("value", "before", "after")
    found = rows.select("kind", "label", "wide", F.xxhash64("value", "before").alias("h"), *[v.alias(k) for k, v in _features(c).items()]).collect()
    out = {}
    for kind in EVERY:
        own = sorted((r for r in found if r["kind"] == kind), key=lambda r: (r["h"], r["label"]))
        x, y = np.array([[r[f] for f in FEATURES] for r in own]), np.array([r["label"] for r in own])
        back = np.array([r["h"] % 4 == 0 for r in own], dtype=bool)  # one value is on one side
        model = boosting.fit(x[~back], y[~back], trees=20, depth=3)
        back &= np.array([r["wide"] for r in own], dtype=bool)  # the formats that are to be judged
        out[kind] = boosting.sql(model, [f"f.{k}" for k in FEATURES]), boosting.threshold(boosting.margin(model, x[back]), y[back], PRECISION)
    return out


_CANDIDATE = "struct<kind:string,s:struct<start:int,end:int,value:string,before:string,after:string>>"
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _tagged(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _found(texts: DataFrame, model: dict) -> DataFrame:
    """``texts`` with base and spans beside its columns; text is a string and not null. Adds columns that begin with _."""
    text, none = F.col("text"), F.array().cast(_SPAN)
    located = texts.withColumns(
        {f"_{k}": _located(text, BASE[k], NEEDS[k]) for k in KINDS} | {f"_w{i}": _located(text, p, p) for i, (_, p) in enumerate(WIDE)}
    )
    valid = lambda kind: lambda s: _valid(kind, s["value"])
    base = {
        k: F.when(F.size(F.col(f"_{k}.found")) > 0, F.transform(F.filter(_spans(F.col(f"_{k}")), valid(k)), _tagged(k))).otherwise(none) for k in KINDS
    }
    proposal = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))
    # all candidates of the wider generators, with their kinds
    proposed = F.concat(
        *(
            F.when(F.size(F.col(f"_w{i}.found")) > 0, F.transform(_spans(F.col(f"_w{i}")), proposal(kind)))
            .otherwise(F.array().cast(f"array<{_CANDIDATE}>"))
            for i, (kind, _) in enumerate(WIDE)
        )
    )
    any_wide = F.exists(F.array(*(F.size(F.col(f"_w{i}.found")) for i in range(len(WIDE)))), lambda n: n > 0)
    based = located.withColumn("base", F.concat(*(base[k] for k in KINDS))).withColumn("_all", F.when(any_wide, proposed))
    # base spans and candidates in order: a candidate is clear of base spans if none before it ends, and none after it begins, inside
    order = F.array_sort(
        F.concat(
            F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("at"), b["end"].alias("end"), F.lit(None).cast(_CANDIDATE).alias("c"))),
            F.transform("_all", lambda c, i: F.struct(c["s"]["start"].alias("start"), i.alias("at"), c["s"]["end"].alias("end"), c.alias("c"))),
        )
    )
    far = 2**31 - 1
    placed = based.withColumn("_order", F.when(any_wide, order))
    placed = placed.withColumn("_ended", running(F.transform("_order", lambda x: F.when(x["at"] < 0, x["end"]).otherwise(F.lit(0))), F.greatest))
    placed = placed.withColumn("_next", F.reverse(running(F.reverse(F.transform("_order", lambda x: F.when(x["at"] < 0, x["start"]).otherwise(F.lit(far)))), F.least)))
    # no column stands inside these functions, as the planner would put its whole computation there
    zipped = F.arrays_zip("_order", "_ended", "_next")
    clear = F.filter(zipped, lambda z: (z["_order"]["at"] >= 0) & (z["_ended"] <= z["_order"]["start"]) & (z["_next"] >= z["_order"]["end"]))

    def judged(z):
        x, c = z["_order"], z["_order"]["c"]
        return F.struct(c["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.struct(*[v.alias(k) for k, v in _features(c["s"]).items()]).alias("f"))

    # the features as one field f of each candidate, so that the trees' expression names them
    weighed = placed.withColumn("_clear", F.transform(clear, judged))
    enough = " ".join(f"WHEN '{k}' THEN ({score.replace('f.', 's.f.')}) >= {least!r}D" for k, (score, least) in model.items() if np.isfinite(least))
    chosen = F.expr(f"transform(filter(_clear, s -> CASE s.kind {enough} ELSE false END), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))") if enough else none
    rank = lambda s: F.create_map(*[x for i, k in enumerate(EVERY) for x in (F.lit(k), F.lit(i))])[s["kind"]]
    chosen = weighed.withColumn("_chosen", F.coalesce(chosen, none))
    ordered = F.array_sort(F.transform(F.concat("base", "_chosen"), lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    united = chosen.withColumn("_united", F.when(F.size("_chosen") > 0, ordered))
    once = F.filter("_united", lambda s, i: (i == 0) | (s != F.get("_united", i - 1)))
    spans = F.when(F.size("_chosen") > 0, F.transform(once, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return _held(united.withColumn("_spans", F.coalesce(spans, F.col("base"))), "_spans").withColumnRenamed("_spans", "spans")


def _held(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is, but a filter on the column ``name`` stays above what computes it.

    Pushed down, the filter would hold that computation over and over, which the planner can't take.
    """
    marked = df.withColumn("_place", F.monotonically_increasing_id())
    return marked.withColumn(name, F.when(F.col("_place") >= 0, F.col(name))).drop("_place")


def find(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all but text) with text, base and spans.

    base and spans are arrays of struct<kind, start, end>, kinds in the order email, ip, card, phone, secret, then by
    start; positions are code points, ends exclusive. base holds the fixed formats, spans those and the candidates
    selected by the trees, which never overlap a base span but may overlap each other. A null text counts as empty and has
    no spans. One row per input row; an empty table gives no rows. Columns named text, base or spans in ``columns`` are
    replaced; others may have any names.
    """
    keep = [c for c in (columns if columns is not None else docs.columns) if c.lower() not in ("text", "base", "spans")]
    whole = Aside(docs, "text")
    found = _found(whole.frame.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), fit(only(docs, "text")))
    packed = {n: F.col(f"_row.c{i}") for i, n in enumerate(whole.names) if i not in whole.read}
    return found.select(*(packed[c].alias(c) for c in keep), "text", "base", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


CHUNK = 1024


def _between(start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text by its chunks, in time of their length."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    own = F.array_join(F.slice(F.col("_chunks"), first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(own, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; other columns as given, whatever their names.

    Overlapping spans are replaced as one, under the name of the one that starts first (the longest of those). A null text
    stays null; n_chars, if there is such a column, becomes the new length where a text changes. An empty table gives no
    rows.
    """
    read = ["text"] + [n for n in ("n_chars",) if n in docs.columns]
    whole = Aside(docs, *read)
    null = F.col("text").isNull()
    found = _found(whole.frame.withColumn("_null", null).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), fit(only(docs, "text")))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    some = F.size("spans") > 0
    found = found.withColumn("_sorted", F.when(some, by_start)).withColumn("_until", running(F.transform("_sorted", lambda s: -s["e"]), F.greatest))
    found = found.withColumn("_chunks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_until", i - 1))
    pieces = F.transform(
        "_sorted",
        lambda s, i: F.when(s["start"] < before(i), F.lit("")).otherwise(F.concat(_between(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))),
    )
    rest = _between(F.element_at("_until", -1), F.char_length("text"))
    text = F.when(F.col("_null"), F.lit(None)).when(some, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    out = found.withColumn("_new", text)
    if "n_chars" in read:
        out = out.withColumn("n_chars", F.when(some, F.char_length("_new").cast(whole.frame.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return whole.back(_held(out, "_new").withColumn("text", F.col("_new")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in all documents. Edge cases as in ``find``."""
    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
