import pytest

from tarn.llm import suite
from tests.compare import differences

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["term", "mark"], "p2_found": ["seq"], "p3_found": ["seq", "line_no"], "p4_found": ["seq"], "p5_found": ["fetch_id", "block"],
    "p6_found": ["seq", "line_no", "lang"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_same_as_sql(spark, name):
    here, there, only_here, only_there = differences(spark, SMALL, suite.queries()[name], suite.oracle_sql()[name])
    assert here == there and not only_here and not only_there


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_runs_and_is_distinct(spark, name):
    df = suite.queries()[name](spark, SMALL)
    assert COLUMNS.get(name, df.columns) == df.columns
    rows = df.collect()
    assert len({str(r) for r in rows}) == len(rows)
