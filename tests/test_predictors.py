import random

import pytest

from lodestrata.operators import predictors, summary

SCHEMA = (
    "repo string, file_id bigint, impact bigint, impact_comp bigint, churn bigint, commits bigint, hotspot bigint, size double, wmc double, "
    "entropy double, ndev bigint, prior_fixes bigint, fixes bigint, label int"
)


def rows(seed, n, repo, known=0.7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.randint(0, 9) for _ in range(8)]
        fixes = rng.randint(0, 3)
        size, wmc = (float(rng.randint(1, 50)) if rng.random() < known else None for _ in range(2))
        out.append((repo, seed * 1000 + i, *v[:5], size, wmc, float(v[5]), v[6], v[7], fixes, int(fixes > 0)))
    return out


def as_dict(df):
    return {(r.metric, r.predictor, r.control): r.value for r in df.collect()}


def test_many_repositories_are_many_single_ones(spark):
    parts = {"a": rows(1, 60, "a"), "b": rows(2, 25, "b"), "c": rows(3, 2, "c"), "d": rows(4, 12, "d", known=0.0)}
    everything = spark.createDataFrame([r for p in parts.values() for r in p], SCHEMA)
    matrix = predictors.predictor_matrix(everything, ["repo"])
    together = {}
    for r in matrix.collect():
        together.setdefault(r.repo, {})[r.metric, r.predictor, r.control] = r.value
    for repo, part in parts.items():
        alone = as_dict(predictors.predictor_matrix(spark.createDataFrame(part, SCHEMA).drop("repo")))
        assert alone.keys() == together[repo].keys()
        assert all(v == pytest.approx(together[repo][k], abs=1e-12) if v is not None else together[repo][k] is None for k, v in alone.items())
    assert together["c"].get(("spearman", "size", "")) is None and ("spearman", "size", "") not in together["d"]
    over = {(r.metric, r.predictor, r.control): r for r in summary.cross_repo_summary(matrix).collect()}
    key = ("partial", "impact", "churn")
    values = sorted(round(v[key], 6) for v in together.values() if v[key] is not None)
    assert (over[key].n_repos, over[key].n_positive, over[key].median, over[key].least, over[key].most) == (len(values), sum(v > 0 for v in values), values[len(values) // 2], values[0], values[-1])
    order = [r.partial_mut for r in summary.repo_ranking(matrix).collect()]
    assert [v for v in order if v is not None] == sorted((v for v in order if v is not None), reverse=True) and all(v is None for v in order[len([v for v in order if v is not None]) :])


def test_empty(spark):
    assert all(v in (None, 0) for v in as_dict(predictors.predictor_matrix(spark.createDataFrame([], SCHEMA).drop("repo"))).values())


def test_repository(spark):
    df = spark.createDataFrame([(" ./a\\b/c.py",), ("top.py",), ("x/y",), (None,)], "path string")
    assert [r[0] for r in df.select(summary.repository("path")).collect()] == ["a", "", "x", ""]


def test_splits_by_repository(spark):
    times = [("a", 10 * i) for i in range(1, 21)] + [("b", i) for i in range(5)] + [("c", 7)] * 40 + [("a", 0), ("a", None)]
    got = {r.repo: r.split_ts for r in summary.split_timestamps(spark.createDataFrame(times, "repo string, ts bigint"), ["repo"]).collect()}
    assert got == {"a": 160, "c": 7}
