"""FNV-1a with 64 bits as a column expression and as plain Python.

The state is kept as two 32-bit halves, because a 64-bit product overflows under ANSI arithmetic. The prime is
2**40 + 435.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: offset basis and prime.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3
MASK = 0xFFFFFFFF


def fnv1a64_bytes(data: bytes) -> str:
    """16 lower-case hex digits, on the driver."""
    state = OFFSET
    for x in data:
        state = (state ^ x) * PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{state:016x}"


def stable_hash_text(*parts: str) -> str:
    """Hash of several texts on the driver: byte 255 follows each part."""
    return fnv1a64_bytes(b"".join(p.encode() + b"\xff" for p in parts))


def fnv1a64(data: Column) -> Column:
    """Hash of a binary column; null stays null, empty gives the offset basis."""
    octets = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    state = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & MASK).cast("long").alias("lo"))

    def step(s: Column, octet: Column) -> Column:
        x = s["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("long"))
        low = x * (PRIME & MASK)
        return F.struct(
            (s["hi"] * (PRIME & MASK) + x * (PRIME >> 32) + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK).cast("long")).alias("hi"),
            low.bitwiseAND(F.lit(MASK).cast("long")).alias("lo"),
        )

    half = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.when(data.isNotNull(), F.aggregate(octets, state, step, lambda s: F.lower(F.concat(half(s["hi"]), half(s["lo"])))))


def stable_hash(*parts: Column) -> Column:
    """Hash of several text columns: byte 255, which no UTF-8 text holds, follows each part; null if any part is."""
    end = F.unhex(F.lit("FF"))
    return fnv1a64(F.concat(*[x for p in parts for x in (p.cast("string").cast("binary"), end)]))


def stable_hash_array(parts: Column) -> Column:
    """Hash of the texts of an array in their order, byte 255 after each."""
    return fnv1a64(F.unhex(F.array_join(F.transform(parts, lambda p: F.concat(F.hex(p.cast("binary")), F.lit("FF"))), "")))


def content_digest(signature: Column) -> list[Column]:
    """Aggregates over rows that together tell their multiset: count, two xors and a sum of 64-bit hashes.

    They are of fixed size and combine before a shuffle, so a group of any size can be hashed.
    """
    a, b = F.xxhash64(signature), F.xxhash64(signature, F.lit("second"))
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(a).alias("xa"), F.bit_xor(b).alias("xb"), F.sum(a.cast("decimal(20,0)")).alias("sa")]


def digest_text(rows) -> str:
    """The hash of one or more results of ``content_digest``, whatever way the rows were grouped."""
    n = xa = xb = sa = 0
    for r in rows:
        n, xa, xb, sa = n + r["n"], xa ^ r["xa"], xb ^ r["xb"], sa + int(r["sa"])
    return stable_hash_text(str(n), str(xa), str(xb), str(sa))
