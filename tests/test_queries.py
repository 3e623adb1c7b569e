"""Every core query that has SQL gives the same rows; the others run."""

import pytest
from oracle import connect, spark_rows, sql_rows

from lodestrata.plans import registry

SLOW = {"cross_repo_summary", "repo_ranking"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, data, name):
    got = spark_rows(registry.QUERIES[name](spark, data))
    if name in registry.ORACLE:
        assert got == sql_rows(connect(data), registry.ORACLE[name])
    else:
        assert got[1]


def test_repo_ranking(spark, data):
    assert spark_rows(registry.QUERIES["repo_ranking"](spark, data)) == sql_rows(connect(data), registry.ORACLE["repo_ranking"])


def test_cross_repo_summary(spark, data):
    columns, rows = spark_rows(registry.QUERIES["cross_repo_summary"](spark, data))
    assert (columns, rows) == sql_rows(connect(data), registry.ORACLE["cross_repo_summary"])
    at = {c: i for i, c in enumerate(columns)}
    assert rows and all(r[at["least"]] <= r[at["median"]] <= r[at["most"]] and 0 <= r[at["n_positive"]] <= r[at["n_repos"]] for r in rows)
    ranking = spark_rows(registry.QUERIES["repo_ranking"](spark, data))
    known = sorted(r[ranking[0].index("partial_mut")] for r in ranking[1] if r[ranking[0].index("partial_mut")] is not None)
    mine = next(r for r in rows if (r[at["metric"]], r[at["predictor"]], r[at["control"]]) == ("partial", "impact", "churn"))
    assert mine[at["n_repos"]] == len(known) and abs(mine[at["median"]] - known[len(known) // 2]) < 1e-6 and mine[at["n_positive"]] == sum(v > 0 for v in known)
