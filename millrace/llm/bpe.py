"""Byte-level BPE with a public rank file: encoding by a sentencepiece model made from the ranks, decoding by look-up.

The model is serialised here, field by field: a piece for each rank with its bytes mapped to printable characters, the
negative rank as its score, identity normalisation, no dummy prefix. Highest score first is then lowest rank first, so
the merges are those of the rank file. Texts are cut by the pre-token pattern; each distinct pre-token is encoded once
per worker (between texts a worker keeps at most CACHE pre-tokens of at most CACHE_CHARS characters).
"""

from __future__ import annotations

import base64
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE, CACHE_CHARS = 300_000, 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is rank i; the unknown piece comes last and is never met."""
    characters, order = byte_characters(), sorted(ranks, key=ranks.get)
    if [ranks[x] for x in order] != list(range(len(order))):
        raise ValueError("ranks must be 0..n-1")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    normal, unknown = 1, 2
    pieces = [piece("".join(characters[b] for b in x), -float(i), normal) for i, x in enumerate(order)]
    pieces.append(piece("<unk>", 0.0, unknown))
    bpe = 2
    trainer = _number(3, bpe) + _number(40, len(order)) + b"".join(
        _varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43)  # ids -1: no begin, end or padding piece
    )
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.pieces = sorted(self.ranks, key=self.ranks.get)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.ranks))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        # White space as Unicode's property has it: \s of this library also takes U+001C to U+001F.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall
        self.cache: dict[str, bytes] = {}  # ids of a pre-token, four bytes each

    def learn(self, pre_tokens: list[str]) -> None:
        """Put pre-tokens into the table: whole ranks as they are, the others encoded in one call."""
        rest, mapped = [], []
        for x in pre_tokens:
            raw = x.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[x] = array("i", (whole,)).tobytes()
            else:
                rest.append(x)
                mapped.append(raw.decode("latin-1").translate(self.table))
        if rest:
            for x, ids in zip(rest, self.model.Encode(mapped, out_type=int, num_threads=1)):
                self.cache[x] = array("i", ids).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each; special-token strings are ordinary text."""
        cache, words = self.cache, self.cut(text)
        new = [x for x in set(words) if x not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(set(words))
        self.learn(new)
        ids = b"".join(map(cache.__getitem__, words))
        for x in new:
            if len(x) > CACHE_CHARS:
                del cache[x]
        return ids

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_codec() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the whole text's ids, and the bytes that decoding them gives back.

    A null text counts as empty: no ids, no bytes. One row per input row, null ids and repeated rows included; other
    columns are ignored; an empty table gives no rows. The rank file is
    read on the executors, where the tokenizer package is installed; without ``path`` each worker asks that package.
    """

    def run(batches):
        own = default_codec()
        tool = codec(path or own[0], pattern or own[1])
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                packed = [tool.encode_packed(x) if x else b"" for x in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
                decoded = pa.array([tool.decode(array("i", x)) for x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.cast(pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    given = only(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the exact round trip, as digests. Edge cases as in ``encode``."""
    return digests(encode(table(spark, sf_dir, "documents")))
