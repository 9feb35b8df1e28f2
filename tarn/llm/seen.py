"""Problem 2: has this key been seen before?

Keys are hashed and spread over partitions; each partition walks its keys in order of arrival
through a growing cuckoo filter of 16-bit fingerprints. Before the exchange every task collapses
the keys of its own input: only the first row of a key in a chunk has to ask the table, later rows
of the chunk are repeats already. So a key that holds a third of all rows reaches its partition as
one row per chunk.

A table never misses a key it holds, so a row it doesn't flag is new. The rows it flags, and only
they, are looked up among the first arrivals of their 128-bit keys, which stand in the same
exchange already; a flagged first arrival is a false positive and turned over.

Tables can also be kept between runs (advance, forget): then the answers are the tables' own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.cuckoo import GrowingCuckoo, seen_before
from tarn.plans.session import shipped, stored

CHUNK = 1 << 20  # rows a task collapses at a time: bounded memory, whatever the split
PARTS = 64  # tables of a kept state
_ROWS = "seq long, h long, g long, repeat boolean"
_ASKED = "seq long, h long, g long, flagged boolean"
_STATE = "part int, kind int, seq long, h long, flagged boolean, table binary"
TABLE, REMOVE, ASK = 0, 1, 2  # kinds of rows, in the order in which a part takes them


def _ints(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows whose key stands earlier (by seq) in the same chunk; drop a row delivered twice."""

    def chunk(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        seq, h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, g, h))
        seq, h, g = seq[order], h[order], g[order]
        same_key = np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
        again = np.r_[False, same_key[1:] & (seq[1:] == seq[:-1])]
        seq, h, g, repeat = seq[~again], h[~again], g[~again], same_key[~again]
        # repeats ask no table: they are spread by seq
        return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(np.where(repeat, seq, h)), pa.array(np.where(repeat, 0, g)), pa.array(repeat)], names=["seq", "h", "g", "repeat"])

    held, rows = [], 0
    for batch in batches:
        held.append(_ints(batch))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield chunk(held)
            held, rows = [], 0
    if rows:
        yield chunk(held)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's keys, sorted by seq, through its own table; chunk repeats are left out."""
    table = GrowingCuckoo()
    last = np.int64(-1), np.int64(0), np.int64(0)
    for batch in batches:
        seq, h, g = _ints(batch)
        asks = ~batch.column(3).to_numpy(zero_copy_only=False)
        seq, h, g = seq[asks], h[asks], g[asks]
        # a row delivered twice comes as neighbours: the second isn't a repeat and isn't kept
        before = [np.r_[last[i], x[:-1]] for i, x in enumerate((seq, h, g))]
        keep = ~((seq == before[0]) & (h == before[1]) & (g == before[2]))
        if len(seq):
            last = seq[-1], h[-1], g[-1]
        seq, h, g = seq[keep], h[keep], g[keep]
        yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(h), pa.array(g), pa.array(seen_before(table, h.view(np.uint64)))], names=["seq", "h", "g", "flagged"])


def key_hashes(key: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key under different seeds: neither follows from the other."""
    col = F.col(key) if isinstance(key, str) else key
    return F.xxhash64(col), F.xxhash64(F.lit("second"), col)


def _collapsed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """seq, h, g, repeat: rows with a key and an order, repeats within a chunk marked."""
    h, g = key_hashes(key)
    hashed = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("long").alias("seq"), h.alias("h"), g.alias("g"))
    return shipped(hashed).mapInArrow(_collapse, _ROWS)


def checked_rows(rows: DataFrame, key: str = "url", order: str = "seq", every: bool = False) -> DataFrame:
    """seq, flagged (the tables, or the row's own chunk, say that the key came earlier) and seen
    (it did). Without `every` only flagged rows.

    Rows with a null key or a null order are left out: they repeat nothing. `order` names the row:
    equal values of one key count as one row, which may come twice, once as a repeat of its chunk
    and once by way of the table. The empty key is a key.

    The exchange of the keys serves both the tables and the first arrivals; what is exchanged
    besides are the flagged rows. The keys' second hashes are compared outside the join's keys, for
    else the first arrivals would be exchanged once more to be spread by both.
    """
    parted = _collapsed(rows, key, order).repartition("h")
    asked = parted.sortWithinPartitions("seq", "h", "g").mapInArrow(_ask, _ASKED)
    asked = (asked if every else asked.where("flagged")).select(F.col("seq").alias("asked"), F.col("h").alias("own_h"), F.col("g").alias("own_g"), "flagged")
    firsts = parted.groupBy("h", "g", "repeat").agg(F.min("seq").alias("first"))
    same = (F.col("own_h") == F.col("h")) & (F.col("own_g").bitwiseXOR(F.col("g")) == 0) & ~F.col("repeat")
    joined = asked.join(firsts, same, "right").where(F.col("repeat") | F.col("asked").isNotNull())
    return joined.select(
        F.coalesce("asked", "first").alias("seq"),
        F.coalesce("flagged", F.lit(True)).alias("flagged"),
        (F.col("repeat") | (F.col("asked") > F.col("first"))).alias("seen"),
    )


def seen_rows(rows: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The rows (their `seq`) whose key stands in a row with a smaller `seq`, each once."""
    return checked_rows(rows, key, order).where("flagged and seen").select("seq").distinct()


def error_report(rows: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """One row: rows, new and seen ones, rows called seen by the tables, of them wrong, seen rows that
    the tables missed, and the rate of wrong answers among rows that were new."""
    new = ~F.col("seen")
    return (
        checked_rows(rows, key, order, every=True)
        .groupBy("seq")
        .agg(F.max("seen").alias("seen"), F.max("flagged").alias("flagged"))
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(new).alias("n_new"),
            F.count_if("seen").alias("n_seen"),
            F.count_if("flagged").alias("n_flagged"),
            F.count_if(F.col("flagged") & new).alias("n_wrong"),
            F.count_if(~F.col("flagged") & F.col("seen")).alias("n_missed"),
        )
        .withColumn("wrong_rate", F.when(F.col("n_new") > 0, F.col("n_wrong") / F.col("n_new")).otherwise(F.lit(0.0)))
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts one after another: a kept table, keys to remove, keys that ask; then the table again."""
    part, table = None, GrowingCuckoo()

    def kept() -> pa.RecordBatch:
        data = io.BytesIO()
        np.savez(data, **table.arrays())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, TABLE, None, None, None, data.getvalue()), types, strict=True)], names=names)

    names = [f.split()[0] for f in _STATE.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])]) if len(parts) else []
        for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
            if parts[a] != part:
                if part is not None:
                    yield kept()
                part, table = int(parts[a]), GrowingCuckoo()
            run = batch.slice(int(a), int(b - a))
            if kinds[a] == TABLE:
                table = GrowingCuckoo.of(dict(np.load(io.BytesIO(run.column(5)[0].as_py()))))
                continue
            h = run.column(3).to_numpy(zero_copy_only=False)
            if kinds[a] == REMOVE:
                table.delete(np.unique(h).view(np.uint64))
                continue
            flagged = seen_before(table, h.view(np.uint64))
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), run.column(2), run.column(3), pa.array(flagged), pa.nulls(len(h), pa.binary())], names=names)
    if part is not None:
        yield kept()


def _stepped(state: DataFrame | None, rows: DataFrame, parts: int) -> DataFrame:
    """The walk over `rows` (kind, seq, h) and the kept tables, stored."""
    asked = rows.select(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), "kind", "seq", "h", F.lit(None).cast("boolean").alias("flagged"), F.lit(None).cast("binary").alias("table"))
    both = asked if state is None else asked.unionByName(state)
    return stored(shipped(both.repartition("part").sortWithinPartitions("part", "kind", "seq", "h")).mapInArrow(_walk, _STATE))


def advance(state: DataFrame | None, rows: DataFrame, key: str = "url", order: str = "seq", parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(answers, state): seq and flagged of each distinct row, and the tables with these keys added.

    Start with state None; write the state where the next run can read it. `parts` is the number of
    tables and stays the same as long as they live: a part's keys pass one task. Memory is the
    tables', about 2.4 bytes a key; keys themselves aren't kept, so a rate of about 1e-4 a table
    generation is wrong. Null keys and orders are left out.
    """
    collapsed = _collapsed(rows, key, order)
    walked = _stepped(state, collapsed.select(F.lit(ASK).alias("kind"), "seq", "h", "repeat").where("not repeat"), parts)
    own = walked.where(F.col("kind") == ASK).select("seq", "flagged")
    answers = own.unionByName(collapsed.where("repeat").select("seq", F.lit(True).alias("flagged"))).groupBy("seq").agg(F.max("flagged").alias("flagged"))
    return answers, walked.where(F.col("kind") == TABLE)


def forget(state: DataFrame, rows: DataFrame, key: str = "url", parts: int = PARTS) -> DataFrame:
    """The state without the keys of `rows`, which must have been added: a cuckoo filter can't tell a
    key that it never held from one with the same fingerprint."""
    h, _ = key_hashes(key)
    gone = rows.where(F.col(key).isNotNull()).select(F.lit(REMOVE).alias("kind"), F.lit(None).cast("long").alias("seq"), h.alias("h")).distinct()
    return _stepped(state, gone, parts).where(F.col("kind") == TABLE)
