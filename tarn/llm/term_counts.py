"""Problem 1: occurrences and record presence of every distinct term.

A global dictionary gives every term a dense integer. Pairs of term and record, each taken once,
are encoded; blocks of `BLOCK` neighbouring identifiers get count arrays, first within each
partition (map side), then summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.ids import dense_ids
from tarn.plans.session import shipped

BLOCK = 2048  # identifiers a count array covers
HELD_BLOCKS = 1024  # arrays a task holds before it hands them on: 1024 * 2048 * 16 bytes = 32 MB
RARE_MAX_DOCS = 2
COMMON_MIN_SHARE = 0.54
_PARTIAL = "block long, slots array<int>, occurrences array<long>, records array<long>"
_COUNTS = "term_id long, occurrences long, records long"


def distinct_pairs(postings: DataFrame) -> DataFrame:
    """One row per (term, doc_id) with its term_freq.

    Rows with a null term or doc_id don't count. Where a pair stands in several rows the largest
    term_freq holds, null counting as 0. The key is the pair, so a term that holds a third of the
    rows is spread by its records.
    """
    return (
        postings.select("term", "doc_id", "term_freq")
        .where(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("term", "doc_id")
        .agg(F.coalesce(F.max("term_freq"), F.lit(0)).alias("term_freq"))
    )


def dictionary(pairs: DataFrame) -> DataFrame:
    """term, term_id: dense identifiers in byte order of the terms."""
    return dense_ids(pairs.select("term").distinct(), ["term"], "term_id")


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block-wise count arrays of a partition's encoded pairs."""
    held: dict[int, np.ndarray] = {}

    def hand_on() -> pa.RecordBatch:
        blocks, slots, occurrences, records = [], [], [], []
        for block, counts in held.items():
            at = np.flatnonzero(counts[1])
            blocks.append(block)
            slots.append(at.astype(np.int32))
            occurrences.append(counts[0][at])
            records.append(counts[1][at])
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array(occurrences, pa.list_(pa.int64())), pa.array(records, pa.list_(pa.int64()))],
            names=["block", "slots", "occurrences", "records"],
        )

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        freq = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, freq = ids[order], freq[order]
        cuts = np.flatnonzero(np.diff(ids // BLOCK)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if a == b:
                continue
            block = int(ids[a] // BLOCK)
            counts = held.get(block)
            if counts is None:
                counts = held[block] = np.zeros((2, BLOCK), dtype=np.int64)
            slot = ids[a:b] - block * BLOCK
            np.add.at(counts[0], slot, freq[a:b])
            counts[1] += np.bincount(slot, minlength=BLOCK)
        if len(held) > HELD_BLOCKS:
            yield hand_on()
    if held:
        yield hand_on()


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum partial arrays; the partition is sorted by block, so one array is held at a time."""
    block, counts = None, np.zeros((2, BLOCK), dtype=np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(counts[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(at + block * BLOCK, pa.int64()), pa.array(counts[0][at]), pa.array(counts[1][at])],
            names=["term_id", "occurrences", "records"],
        )

    for batch in batches:
        for row in range(batch.num_rows):
            this = batch.column(0)[row].as_py()
            if this != block:
                if block is not None:
                    yield done()
                block, counts = this, np.zeros((2, BLOCK), dtype=np.int64)
            slot, occurrences, records = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            counts[0][slot] += occurrences
            counts[1][slot] += records
    if block is not None:
        yield done()


def term_counts(postings: DataFrame) -> DataFrame:
    """term, term_id, occurrences (sum of term_freq), records (distinct doc_id).

    An empty table gives an empty result; other columns of `postings` are ignored.
    """
    pairs = distinct_pairs(postings)
    terms = dictionary(pairs)
    # a hot term's pairs make one partition of this join large, which adaptive execution splits by its
    # size: the dictionary's side is one row, and nothing behind the join asks for a distribution
    encoded = pairs.join(terms, "term").select("term_id", "term_freq")
    partial = shipped(encoded).mapInArrow(_accumulate, _PARTIAL)
    summed = partial.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, _COUNTS)
    return summed.join(terms, "term_id").select("term", "term_id", "occurrences", "records")


def marked_terms(postings: DataFrame, rare_max_docs: int = RARE_MAX_DOCS, common_min_share: float = COMMON_MIN_SHARE) -> DataFrame:
    """term_counts() with mark: rare (at most `rare_max_docs` records), common (in more than
    `common_min_share` of all records that `postings` names), or null.

    A term that is both, as in a collection of two records, is rare.
    """
    named = postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    total = named.select("doc_id").distinct().count()
    mark = F.when(F.col("records") <= rare_max_docs, "rare").when(F.col("records") > common_min_share * total, "common")
    return term_counts(postings).withColumn("mark", mark)
