import random
from collections import defaultdict

from tarn.llm import term_counts

POST = "term string, doc_id long, term_freq long"


def run(spark, rows, schema=POST, **k):
    return {r.term: (r.occurrences, r.records, r.mark) for r in term_counts.marked_terms(spark.createDataFrame(rows, schema), **k).collect()}


def test_pairs_count_once(spark):
    rows = [("a", 1, 2), ("a", 1, 2), ("a", 1, 5), ("a", 2, None), ("a", 3, 0), ("", 1, 1), (None, 1, 1), ("a", None, 1), ("b", 4, 1), ("a", 4, 1)]
    assert run(spark, rows) == {"a": (6, 4, "common"), "": (1, 1, "rare"), "b": (1, 1, "rare")}


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("a", 1, 1, 9, "x")], "term string, doc_id long, term_freq long, term_id long, block string")
    assert [tuple(r) for r in term_counts.term_counts(df).collect()] == [("a", 0, 1, 1)]


def test_against_a_dictionary(spark):
    random.seed(2)
    rows = [(random.choice("abcdefghij") * random.randint(1, 9), random.randint(1, 60), random.randint(0, 5)) for _ in range(4000)]
    rows += [("hot", i % 60, 1) for i in range(3000)]
    best = defaultdict(int)
    for t, d, f in rows:
        best[t, d] = max(best[t, d], f)
    terms = defaultdict(lambda: [0, 0])
    for (t, _), f in best.items():
        terms[t][0] += f
        terms[t][1] += 1
    got = run(spark, rows)
    assert {t: v[:2] for t, v in got.items()} == {t: tuple(v) for t, v in terms.items()}
    total = len({d for _, d, _ in rows})
    assert all(m == ("rare" if n <= 2 else "common" if n > 0.54 * total else None) for _, n, m in got.values())


def test_ids_are_dense_and_sorted(spark):
    df = spark.createDataFrame([(f"t{i:04d}", i, 1) for i in range(500)], POST)
    got = sorted((r.term_id, r.term) for r in term_counts.dictionary(term_counts.distinct_pairs(df)).collect())
    assert [i for i, _ in got] == list(range(500)) and [t for _, t in got] == sorted(t for _, t in got)


def test_blocks_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "HELD_BLOCKS", 0)
    df = spark.createDataFrame([(f"t{i % 50}", i, 1) for i in range(5000)], POST)
    got = term_counts.term_counts(df).collect()
    assert len(got) == 50 and all(r.records == 100 for r in got)
