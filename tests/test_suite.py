import pytest

from tarn.plans import suite
from tests.compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_same_as_sql(spark, name):
    here, there, only_here, only_there = differences(spark, SMALL, suite.queries()[name], suite.oracle_sql()[name])
    assert here == there and not only_here and not only_there


def test_the_rest_runs(spark):
    for name in set(suite.queries()) - set(suite.oracle_sql()):
        assert suite.queries()[name](spark, SMALL).count() >= 1


def test_flagship(spark):
    assert suite.flagship(spark, SMALL).columns == ["rank", "doc_id", "url", "source", "score"]


def test_sql_has_only_known_names():
    assert set(suite.oracle_sql()) <= set(suite.queries())
