import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import seen
from tarn.llm.cuckoo import CuckooTable, GrowingCuckoo, seen_before

ROW = "seq long, url string"


def brute(rows):
    first = {}
    for s, u in rows:
        if s is not None and u is not None:
            first[u] = min(s, first.get(u, s))
    return {s for s, u in rows if s is not None and u is not None and s > first[u]}


def run(spark, rows, schema=ROW, n=5):
    return [r.seq for r in seen.seen_rows(spark.createDataFrame(rows, schema).repartition(n)).collect()]


def test_against_brute_force(spark):
    random.seed(4)
    rows = [(i, random.choice(["hot", "", f"u{random.randint(0, 900)}", None])) for i in range(4000)]
    rows += random.sample(rows, 400) + [(None, "hot")]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_row_delivered_twice_is_no_repeat(spark):
    assert run(spark, [(5, "a"), (5, "a"), (5, "a")]) == []
    assert run(spark, []) == []


def test_case_and_bytes_count(spark):
    assert run(spark, [(1, "http://a"), (2, "http://A"), (3, "http://a/"), (4, "http://a")]) == [4]


def test_extra_columns_and_order(spark):
    rows = [(9, "x", 1, 2), (3, "x", 0, 0), (4, "x", None, None)]
    assert set(run(spark, rows, "seq long, url string, h long, flagged long")) == {9, 4}


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", 10)
    rows = [(i, f"u{i % 7}") for i in range(300)] * 2
    assert set(run(spark, rows)) == brute(rows)


def test_report(spark):
    rows = [(i, f"u{i % 500}") for i in range(2000)]
    r = seen.error_report(spark.createDataFrame(rows, ROW)).first()
    assert (r.n_rows, r.n_new, r.n_seen, r.n_missed) == (2000, 500, 1500, 0) and r.n_flagged >= 1500 and 0 <= r.wrong_rate < 0.05
    none = seen.error_report(spark.createDataFrame([], ROW)).first()
    assert (none.n_rows, none.wrong_rate) == (0, 0.0)


def test_second_hash_is_no_function_of_the_first(spark):
    h, g = seen.key_hashes("url")
    rows = spark.createDataFrame([(f"u{i}",) for i in range(50)], "url string").select(h.alias("h"), g.alias("g"), F.xxhash64("url", F.lit("second")).alias("chained")).collect()
    again = spark.createDataFrame([(r.h,) for r in rows], "h long")
    assert len({r.g for r in rows}) == 50 and not {r.g for r in rows} & {r.chained for r in rows} and again.count() == 50


def test_false_positives_are_turned_over(spark, monkeypatch):
    """With tables that flag every row only the look among first arrivals is left to tell."""
    rows = [(i, f"u{i % 90}") for i in range(400)]
    asked = seen._ask

    def all_flagged(batches):
        for b in asked(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([True] * b.num_rows)], names=b.schema.names)

    monkeypatch.setattr(seen, "_ask", all_flagged)
    assert set(run(spark, rows)) == brute(rows)
    r = seen.error_report(spark.createDataFrame(rows, ROW)).first()
    assert (r.n_wrong, r.n_new, r.wrong_rate) == (90, 90, 1.0)


def test_rows_the_tables_dont_flag_are_new(spark, monkeypatch):
    """The tables decide which rows get the exact look."""
    monkeypatch.setattr(seen, "CHUNK", 1)  # no repeats within a chunk
    asked = seen._ask

    def none_flagged(batches):
        for b in asked(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([False] * b.num_rows)], names=b.schema.names)

    monkeypatch.setattr(seen, "_ask", none_flagged)
    monkeypatch.setattr(seen, "_collapse", lambda batches: (pa.RecordBatch.from_arrays([*b.columns, pa.array([False] * b.num_rows)], names=["seq", "h", "g", "repeat"]) for b in batches))
    assert run(spark, [(i, f"u{i % 9}") for i in range(40)]) == []


def test_tables_kept_between_runs(spark, tmp_path):
    first = [(i, f"u{i}") for i in range(300)] + [(400, "u7"), (401, None)]
    answers, state = seen.advance(None, spark.createDataFrame(first, ROW), parts=5)
    assert {r.seq for r in answers.where("flagged").collect()} == {400} and answers.count() == 301
    state.write.parquet(str(tmp_path / "state"))
    state = seen.forget(spark.read.parquet(str(tmp_path / "state")), spark.createDataFrame([(0, f"u{i}") for i in range(100)] * 2, ROW), parts=5)
    second = [(1000 + i, f"u{i}") for i in range(200)] + [(2000 + i, f"v{i}") for i in range(200)]
    answers, state = seen.advance(state, spark.createDataFrame(second, ROW), parts=5)
    flagged = {r.seq for r in answers.where("flagged").collect()}
    assert set(range(1100, 1200)) <= flagged and len(flagged - set(range(1100, 1200))) <= 3 and state.count() == 5


def hashes(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def test_filter_never_misses_and_grows():
    table, keys = GrowingCuckoo(64), np.unique(hashes(50_000))
    for part in np.array_split(keys, 40):
        table.insert(part)
    assert table.contains(keys).all() and len(table) == len(keys) and len(table.tables) > 3
    assert table.contains(hashes(100_000, 9)).mean() < 0.005


def test_delete():
    table, keys = GrowingCuckoo(64), np.unique(hashes(3000))
    table.insert(keys)
    assert table.delete(keys[:1500]).all()
    assert table.contains(keys[1500:]).all() and table.contains(keys[:1500]).mean() < 0.02 and len(table) == len(keys) - 1500
    assert not CuckooTable(8).delete(keys[:3]).any()


def test_arrays_round_trip():
    table, keys = GrowingCuckoo(4), np.unique(hashes(900))
    for part in np.array_split(keys, 9):
        table.insert(part)
    again = GrowingCuckoo.of(table.arrays())
    assert len(again) == len(table) and again.contains(keys).all() and again.delete(keys).all() and len(again) == 0


def test_overfull_table_keeps_all():
    table, keys = CuckooTable(8), np.unique(hashes(60))
    table.insert(keys)
    assert table.contains(keys).all() and table.homeless and table.room == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=200), st.integers(1, 50))
def test_batches_like_a_set(values, size):
    table, known = GrowingCuckoo(16), set()
    mixed = (np.array(values, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(mixed), size):
        part = mixed[a : a + size]
        for h, s in zip(part.tolist(), seen_before(table, part).tolist(), strict=True):
            assert s or h not in known
            known.add(h)
