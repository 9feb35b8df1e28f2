"""A 64-bit FNV-1a variant, in two 32-bit halves since BIGINT products overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# This variant's offset basis, the prime, and 2^64.
OFFSET = 1469598103934665603
PRIME = 1099511628211
MODULUS = 1 << 64


def fnv1a_hex(text: Column | str) -> Column:
    """16 hex digits of the hash of the UTF-8 bytes; null for null."""
    col = F.col(text) if isinstance(text, str) else text
    # two 32-bit halves: neither product leaves BIGINT's range
    hexes = F.regexp_extract_all(F.hex(F.encode(col, "UTF-8")), F.lit("(..)"), F.lit(1))
    high, low, mask = OFFSET >> 32, OFFSET & 0xFFFFFFFF, 0xFFFFFFFF
    p_high, p_low = PRIME >> 32, PRIME & 0xFFFFFFFF

    def step(acc: Column, byte: Column) -> Column:
        mixed = acc["low"].bitwiseXOR(F.conv(byte, 16, 10).cast("long"))
        product = mixed * F.lit(p_low)
        carried = F.shiftrightunsigned(product, 32) + acc["high"] * F.lit(p_low) + mixed * F.lit(p_high)
        return F.struct(carried.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low"))
    return F.aggregate(hexes, start, step, lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["high"]), 8, "0"), F.lpad(F.hex(acc["low"]), 8, "0"))))


def fnv1a(data: bytes) -> int:
    """The same on the driver."""
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME % MODULUS
    return h
