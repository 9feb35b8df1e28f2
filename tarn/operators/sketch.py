"""Bloom filter: geometry in closed form, build and probe as DataFrame steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 32_768  # bits a stored row covers


def geometry(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n keys at error rate p; n is 1 at least, p <= 0 counts as 1e-4, p >= 1 as 0.5."""
    n = max(1, n)
    p = 1e-4 if p <= 0 else 0.5 if p >= 1 else p
    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def geometry_columns(n: Column, p: Column) -> tuple[Column, Column]:
    """The same as expressions."""
    keys = F.greatest(n.cast("double"), F.lit(1.0))
    rate = F.when(p <= 0, 1e-4).when(p >= 1, 0.5).otherwise(p)
    ln2 = math.log(2)
    bits = F.greatest(F.ceil(-keys * F.log(rate) / (ln2 * ln2)), F.lit(1))
    return bits, F.greatest(F.round(bits / keys * ln2).cast("long"), F.lit(1))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key by double hashing; the second hash is made odd, so never 0."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit(1), key).bitwiseOR(F.lit(1).cast("long"))
    terms = [F.pmod(F.pmod(h1, F.lit(bits)) + F.lit(i) * F.pmod(h2, F.lit(bits)), F.lit(bits)) for i in range(hashes)]
    return F.array(*terms)


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """block, at: the set bits as sorted arrays, WORD_BITS to a row; of any size, never on the driver."""
    spread = keys.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), bits, hashes)).alias("bit"))
    block = F.floor(F.col("bit") / WORD_BITS).cast("long")
    return spread.select(block.alias("block"), (F.col("bit") % WORD_BITS).cast("int").alias("at")).groupBy("block").agg(F.sort_array(F.collect_set("at")).alias("at"))


def clear(sketch: DataFrame) -> DataFrame:
    """The sketch without a key."""
    return sketch.where(F.lit(False))


def probe(rows: DataFrame, key: str, sketch: DataFrame, bits: int, hashes: int) -> DataFrame:
    """`rows` with maybe: true for every inserted key, rarely for others; false for a null key."""
    set_bits = sketch.select("block", F.explode("at").alias("at")).select((F.col("block") * WORD_BITS + F.col("at")).alias("bit"))
    asked = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("bit", F.explode(F.array_distinct(positions(F.col(key), bits, hashes))))
    hit = asked.join(set_bits.withColumn("hit", F.lit(True)), "bit", "left").groupBy(key).agg(F.count("hit").alias("n"), F.count("*").alias("of"))
    known = hit.select(key, (F.col("n") == F.col("of")).alias("maybe"))
    return rows.join(known, key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
