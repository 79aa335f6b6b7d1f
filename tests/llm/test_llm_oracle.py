import pytest
from comparing import oracle, spark_rows
from llm_cases import SF

from vecframe.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == oracle(SF, q.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))
