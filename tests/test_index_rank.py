import pytest

from tarn.operators import rank
from tarn.operators.index import Index, latest_versions, with_stable_ids

DOC = "doc_id long, url string, title string, snippet string, content string, source string, depth int"


def index(spark, *docs):
    rows = [(i, f"http://x/{i}", t, "", c, "clearweb", 0) for i, (t, c) in enumerate(docs, 1)]
    return Index.build(spark.createDataFrame(rows, DOC))


def ranked(ix, text, **k):
    return [(r.doc_id, r.score) for r in rank.search(ix, text, **k).collect()]


def test_weighted_frequencies(spark):
    ix = index(spark, ("Alpha Page", "alpha beta alpha"), ("hello hello", ""))
    tf = {(r.term, r.doc_id): r.tf for r in ix.postings.collect()}
    assert tf == {("alpha", 1): 5, ("page", 1): 3, ("beta", 1): 1, ("hello", 2): 6}
    assert [tuple(r) for r in ix.lookup("beta").collect()] == [(1, 1)]
    assert ix.lookup("gamma").count() == 0


def test_statistics_count_empty_documents(spark):
    ix = index(spark, ("hello", ""), ("", "world"), ("", "!!!"))
    s = ix.stats().first()
    assert (s.ndocs, s.nterms, s.total_terms) == (3, 2, 4)
    assert s.avgdl == pytest.approx(4 / 3)
    assert {r.doc_id: r.dl for r in ix.lengths.collect()} == {1: 3, 2: 1, 3: 0}
    none = Index.empty(ix).stats().first()
    assert (none.ndocs, none.avgdl, none.nterms) == (0, 0.0, 0)


def test_upsert_keeps_ids_and_remove_never_reuses(spark):
    ix = index(spark, ("", "old words"), ("", "other"))
    change = spark.createDataFrame([(1, "http://x/1", "", "", "new text", "clearweb", 0), (2, "http://x/9", "", "", "added", "clearweb", 0), (3, "http://x/1", "", "", "newest", "clearweb", 0)], "seq long, url string, title string, snippet string, content string, source string, depth int")
    after = ix.upsert(change)
    assert {(r.doc_id, r.content) for r in after.docs.collect()} == {(1, "newest"), (2, "other"), (3, "added")}
    assert after.lookup("old").count() == 0 and after.lookup("text").count() == 0
    gone = after.remove(spark.createDataFrame([(3,), (77,)], "doc_id long"))
    assert gone.docs.count() == 2 and gone.lookup("added").count() == 0
    again = gone.upsert(spark.createDataFrame([(1, "http://x/9", "", "", "added", "clearweb", 0)], change.schema))
    assert {r.doc_id for r in again.docs.collect()} == {1, 2, 4}


def test_latest_versions_and_ids(spark):
    rows = [(1, "a", "x"), (2, None, "y"), (3, "a", "z"), (3, "a", "z"), (4, "", "w")]
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    assert {(r.seq, r.url) for r in latest_versions(df).collect()} == {(3, "a"), (4, "")}
    assert {(r.doc_id, r.url, r.title) for r in with_stable_ids(df).collect()} == {(1, "a", "z"), (2, "", "w")}


def test_or_semantics_ties_and_limit(spark):
    ix = index(spark, ("", "alpha"), ("", "beta"), ("", "gamma"))
    assert [i for i, _ in ranked(ix, "beta alpha beta")] == [1, 2]
    same = index(spark, *[("", "word")] * 5)
    assert [i for i, _ in ranked(same, "word", k=3)] == [1, 2, 3]


def test_title_beats_body_and_frequency_orders(spark):
    assert [i for i, _ in ranked(index(spark, ("", "fox"), ("fox", "")), "fox")] == [2, 1]
    assert [i for i, _ in ranked(index(spark, ("", "cat"), ("", "cat cat cat"), ("", "cat cat")), "cat")] == [2, 3, 1]


def test_edges(spark):
    two = index(spark, ("", "common common"), ("", "common common"))
    hits = ranked(two, "common")
    assert len(hits) == 2 and all(0 < s < 1 for _, s in hits)
    assert ranked(two, "") == [] and ranked(two, "!!") == [] and ranked(Index.empty(two), "common") == []
    rare = index(spark, ("", "common rare"), ("", "common"), ("", "common"))
    assert ranked(rare, "rare")[0][1] > ranked(rare, "common")[0][1]
    flat = ranked(index(spark, ("", "term term"), ("", "term")), "term", k1=0.0, b=0.0)
    assert flat[0][1] == flat[1][1]
    assert [i for i, _ in flat] == [1, 2]


def test_filtered_search(spark):
    ix = index(spark, ("", "fox"), ("", "fox"), ("", "fox"))
    only = ix.docs.where("doc_id > 1")
    assert [r.doc_id for r in rank.top(ix, ["fox"], where=only).collect()] == [2, 3]


def test_search_reads_only_matching_postings(spark, tmp_path):
    index(spark, ("", "fox dog")).postings.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = stored.where(stored.term.isin(["fox"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "fox" in plan


def test_scan_scores_equal_the_index(spark):
    rows = [(i, "", "the fox" if i % 3 else "", "a", f"the quick fox {'jumps ' * (i % 5)}", "clearweb", 0) for i in range(1, 30)] + [(30, "", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    for terms in (["fox", "the", "jumps"], ["nothing"], []):
        indexed = {r.doc_id: r.score for r in rank.scores(Index.build(docs), terms).collect()}
        scanned = {r.doc_id: r.score for r in rank.scan_scores(docs, terms).collect()}
        assert scanned == pytest.approx(indexed)
    assert rank.scan_top(docs.where("false"), ["fox"]).count() == 0


def test_ranking_plan_has_no_join(spark):
    plan = rank.scores(index(spark, ("", "fox"), ("", "dog")), ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
