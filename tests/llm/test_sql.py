import pytest
from oracle_check import compare, connect

from lodgeframe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLE[name]) is None


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
