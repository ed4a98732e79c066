"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: by default those that a rule fits, with the rule's verdict. At most LABELLED of them
are read, those of least hash, so fitting is bounded; every URL is judged. The features are lengths, depth, digit shares,
entropies, parameter counts, and the block rates of the URL's suffixes (last label, last two labels), of its first path
segment and of last label and segment together among the labelled URLs. A training row's rates are those of the other
FOLDS of hosts, smoothed as in prediction, so neither its own label nor its host's is in them. Each row stands twice, the
second time as if last label and segment had never been seen together, so the trees learn what to make of such URLs.
"""

from __future__ import annotations

from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import ascii_lower, hash_bound, only, table

LABELLED = 5000
FOLDS = 5
SMOOTHING = 4.0
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = (
    "length", "host_length", "path_length", "labels", "segments", "digits", "host_digits", "hyphens", "escapes", "parameters", "query_length",
    "secure", "entropy", "host_entropy", "longest_label", "longest_segment", "suffix_rate", "suffix_two_rate", "segment_rate", "pair_rate", "pair_known",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values()) if n else 0.0


def parts(host: str, path: str) -> tuple[str, str, str, str]:
    """Last label, last two labels, first path segment, last label and segment: what block rates are kept for."""
    labels, segment = host.split("."), path.split("/", 2)[1] if path.startswith("/") else ""
    return "." + labels[-1], ".." + ".".join(labels[-2:]), "/" + segment, labels[-1] + "/" + segment


def part_statistics(rows: list[tuple[str, str]], blocked: np.ndarray) -> dict:
    """Block rate of all labelled URLs, and blocked ones and number of those with each part."""
    seen: dict[str, list[float]] = {}
    for (host, path), y in zip(rows, blocked):
        for x in parts(host, path):
            entry = seen.setdefault(x, [0.0, 0.0])
            entry[0] += y
            entry[1] += 1
    return {"rate": float(np.mean(blocked)) if len(blocked) else 0.5, "by": {k: tuple(v) for k, v in seen.items()}}


def rates(host: str, path: str, statistics: dict) -> list[float]:
    """The smoothed block rate of each part, and whether the last is known at all."""
    prior, by = statistics["rate"], statistics["by"]
    known = [by.get(x, (0.0, 0.0)) for x in parts(host, path)]
    return [(b + SMOOTHING * prior) / (n + SMOOTHING) for b, n in known] + [float(known[-1][1] > 0)]


def features(url: str | None, host: str, path: str, statistics: dict) -> list[float]:
    url = url or ""
    head, _, rest = url.partition("?")
    query = rest.partition("#")[0]
    labels, segments = host.split(".") if host else [], [x for x in path.split("/") if x]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(labels), len(segments), digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        url.count("-"), url.count("%"), len([x for x in query.split("&") if x]), len(query), float(head[:8].lower() == "https://"), entropy(url), entropy(host),
        max(map(len, labels), default=0), max(map(len, segments), default=0), *rates(host, path, statistics),
    ]


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, null if none: its host or a subdomain, its path a prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def fold(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) % FOLDS


def training_features(rows: list[tuple[str, str, str]], blocked: np.ndarray) -> np.ndarray:
    """The features of each row twice: first all by other folds of hosts, then all as URLs whose pair of label and segment is new."""
    where = np.array([fold(host) for _, host, _ in rows], dtype=int)
    x: list = [None] * (2 * len(rows))
    for k in set(where.tolist()):
        own, others = np.flatnonzero(where == k), np.flatnonzero(where != k)
        statistics = part_statistics([rows[i][1:] for i in others], blocked[others])
        for i in own:
            x[i] = features(*rows[i], statistics)
            x[len(rows) + i] = [*x[i][:-2], statistics["rate"], 0.0]
    return np.array(x, dtype=float).reshape(len(x), len(FEATURES))


def train(rows: list[tuple[str, str, str]], blocked: np.ndarray) -> dict:
    """Model from (url, host, path) and their labels."""
    x, y = training_features(rows, blocked), np.concatenate([blocked, blocked])
    return {"trees": boosting.fit(x, y), "statistics": part_statistics([r[1:] for r in rows], blocked)}


def chances(rows: list[tuple[str, str, str]], model: dict) -> np.ndarray:
    """The chance of a block of each (url, host, path)."""
    x = [features(*r, model["statistics"]) for r in rows]
    return boosting.chance(model["trees"], np.array(x, dtype=float).reshape(len(x), len(FEATURES)))


def fit(labelled: DataFrame, most: int = LABELLED) -> dict:
    """Model from (url, host, path, blocked 0/1). At most ``most`` rows are read: those of least hash."""
    mark = F.xxhash64("url", F.lit("sample"))
    n = labelled.count()
    some = labelled.filter(mark <= hash_bound(2 * most / max(1, n))).orderBy(mark, "url", "blocked").limit(most).collect()
    return train([(r["url"], r["host"], r["path"]) for r in some], np.array([r["blocked"] for r in some], dtype=float))


def judge(pages: DataFrame, rules=RULES, most: int = LABELLED, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score): one row per input row.

    ``labelled`` (url, blocked) replaces the URLs that rules fit as training rows; rows with a null in either are left out.
    score is the trees' chance of a block; without a rule the verdict is block above 0.5.
    Null URLs and URLs without ``://`` have empty host and path and are judged by the trees like others. Without training
    rows the score is 0.5 and the verdict allow. Other columns are ignored; repeated rows give repeated results; an empty
    table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    given = only(pages, "page_id", "url").select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = given.withColumns({"rule": rule, "by_rule": verdict})
    if labelled is None:
        known = ruled.filter("rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("blocked"))
    else:
        known = only(labelled, "url", "blocked").select(F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), "blocked").filter("url is not null and blocked is not null")
    model = fit(known, most)

    def run(batches):
        for batch in batches:
            score = chances(list(zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    kind = ruled.schema["page_id"].dataType.simpleString()
    scored = ruled.mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, by_rule string, score double")
    return scored.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page. Edge cases as in ``judge``."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
