"""Scalar text functions: names, keys, URIs, canonical JSON, timestamps. Column forms, with driver forms where both are needed."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import stable_hash


def sanitize_identifier(x: Column) -> Column:
    """Every character but ASCII letters and digits becomes an underscore; nothing left gives ``batch``."""
    return F.coalesce(F.nullif(F.regexp_replace(x, "[^A-Za-z0-9]", "_"), F.lit("")), F.lit("batch"))


def sanitize_output_component(path: str) -> str:
    """Last normal part of a path, characters other than letters, digits, ``-_.`` made underscores; empty gives ``batch``."""
    parts = [p for p in path.split("/") if p not in ("", ".", "..")]
    return re.sub(r"[^A-Za-z0-9._-]", "_", parts[-1]) if parts else "batch"


def batch_id(label: Column, content_hash: Column) -> Column:
    """The label's file stem, or ``batch-`` and the content hash where there is no label."""
    name = F.element_at(F.split(label, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.concat(F.lit("batch-"), content_hash))


def trim_trailing_slash(x: Column) -> Column:
    return F.rtrim(x, F.lit("/"))


def scoped_commit_key(destination: Column, key: Column) -> Column:
    return F.concat(destination, F.lit("::"), key)


def connector_table_id(namespace: str, table: str) -> str:
    return f"{namespace}.{table}" if namespace else table


def file_uri(path: str) -> str:
    return f"file://{path}"


def file_uri_path(uri: str) -> str:
    if not uri.startswith("file://"):
        raise ValueError(f"unsupported uri: {uri}")
    return uri[len("file://") :]


def catalog_url(endpoint: str, *parts: str) -> str:
    return "/".join([endpoint.rstrip("/"), *(quote(p, safe="") for p in parts)])


def snapshot_id(batch: Column, destination: Column, key: Column, content: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("snapshot-"), stable_hash(batch, destination, key, content, fingerprint))


def canonical_json(x: Column) -> Column:
    """Compact JSON text with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(x))


def sorted_map_json(x: Column) -> Column:
    """A string map as JSON with sorted keys; null gives an empty object."""
    pairs = F.array_sort(F.map_entries(F.coalesce(x, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(pairs))


def key_identity(parts: list[tuple[str, Column, str]]) -> Column:
    """Identity text of a key from (name, value, type tag) in key order: name=Tag(value), joined by vertical bars."""
    def shown(value, tag):
        return F.concat(F.lit('String("'), value.cast("string"), F.lit('")')) if tag == "String" else F.concat(F.lit(f"{tag}("), value.cast("string"), F.lit(")"))

    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), F.coalesce(shown(value, tag), F.lit("Null"))) for name, value, tag in parts])


def mutation_signature() -> Column:
    """Ten fields of a landed row joined by vertical bars: what two replays of one change share."""
    return F.concat_ws(
        "|",
        "table_id", "source_id", "op", "key_json", F.coalesce("after_json", F.lit("null")), F.coalesce("before_json", F.lit("null")),
        "ordering_field", F.col("ordering_value").cast("string"), "source_checkpoint", "source_metadata_json",
    )


def seconds_and_nanos(ts: Column) -> Column:
    """secs:nanos with nine digits; the fraction of a time before 1970 stays positive."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.format_string("%d:%09d", F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000)) * 1000)


def ingestion_time(seconds: Column) -> Column:
    """Epoch seconds as a time without zone (the session's zone must be UTC)."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")
