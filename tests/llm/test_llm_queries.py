import pytest
from oracle import connect, spark_rows, sql_rows

from lodestrata.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = spark_rows(queries.QUERIES[name](spark, data))
    if name in queries.ORACLE:
        assert got == sql_rows(connect(data), queries.ORACLE[name])
    else:
        assert got[1]
