import pytest

from quill.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) > 0
