import pytest
from comparing import oracle, spark_rows

from vecframe import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == oracle(SF, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_other_queries_have_rows(spark, name):
    assert q.queries()[name](spark, SF).count() > 0
