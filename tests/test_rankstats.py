import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestrata.operators import rankstats as rs


def frame(spark, rows, schema="k bigint, x double, y double, z double"):
    return spark.createDataFrame(rows, schema)


def average_ranks(xs):
    return [sum(v < x for v in xs) + (sum(v == x for v in xs) + 1) / 2 for x in xs]


def value(df):
    return df.first().value


def test_average_ranks(spark):
    rows = [(i, float(v), 0.0, 0.0) for i, v in enumerate([3, 1, 1, 2, 3, 3])]
    got = {r.k: r.x / 2 for r in rs.rank_columns(frame(spark, rows), "k", ["x"]).collect()}
    assert [got[i] for i in range(6)] == [5, 1.5, 1.5, 3, 5, 5]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-50, 50)), min_size=2, max_size=40))
def test_against_definition(spark, pairs):
    rows = [(i, float(a), float(b), float(a * b)) for i, (a, b) in enumerate(pairs)]
    df = frame(spark, rows)
    ranks = [average_ranks([r[c] for r in rows]) for c in (1, 2)]
    got = {r.k: (r.x / 2, r.y / 2) for r in rs.rank_columns(df, "k", ["x", "y"]).collect()}
    assert [got[i] for i in range(len(rows))] == list(zip(*ranks, strict=True))
    assert sum(v[0] for v in got.values()) == len(rows) * (len(rows) + 1) / 2
    constant = any(np.std(r) == 0 for r in ranks)
    want = None if constant else np.corrcoef(*ranks)[0, 1]
    have = value(rs.spearman(df, "x", "y", "k"))
    assert have is None if want is None else math.isclose(have, want, abs_tol=1e-9)


def test_undefined(spark):
    flat = frame(spark, [(i, 1.0, float(i), 2.0 * i) for i in range(5)])
    assert value(rs.pearson(flat, "x", "y")) is None
    assert value(rs.pearson(flat.limit(1), "y", "z")) is None
    assert value(rs.spearman(flat, "x", "y", "k")) is None
    assert value(rs.partial_spearman(flat, "y", "x", "z", "k")) is None
    perfect = frame(spark, [(i, float(v), float(i), float(v)) for i, v in enumerate([3, 1, 4, 1, 5])])
    assert value(rs.partial_spearman(perfect, "x", "y", "z", "k")) is None
    assert rs.spearman(flat.limit(0), "x", "y", "k").collect() in ([], [(None,)])


def test_partials_against_residuals(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "k bigint, a double, b double, c double, d double, e double")
    ranks = np.array([average_ranks(list(m[:, j])) for j in range(5)])
    z = np.vstack([np.ones(60), ranks[2:]]).T
    residual = [r - z @ np.linalg.lstsq(z, r, rcond=None)[0] for r in ranks[:2]]
    want = np.corrcoef(*residual)[0, 1]
    assert value(rs.partial_spearman_multi(df, "a", "b", ["c", "d", "e"], "k")) == pytest.approx(want, abs=1e-9)
    assert value(rs.partial_spearman_multi(df, "a", "b", ["c", "d"], "k").limit(1)) is not None
    twice = df.withColumn("c2", df.c)
    assert value(rs.partial_spearman_multi(twice, "a", "b", ["c", "c2"], "k")) is None
    assert value(rs.partial_spearman_multi(df.limit(4), "a", "b", ["c", "d"], "k")) is None


def test_auc(spark):
    auc = lambda scores, labels: value(rs.auc(spark.createDataFrame(list(zip(scores, labels, strict=True)), "s double, l int"), "s", "l"))
    assert auc([1.0, 2.0, 3.0, 4.0], [0, 1, 0, 1]) == 0.75
    assert auc([1.0, 1.0], [0, 1]) == 0.5
    assert auc([1.0, 2.0], [1, 1]) is None
    scores, labels = [0.3, 0.1, 0.7, 0.7, 0.2], [1, 0, 1, 0, 0]
    assert auc(scores, labels) == pytest.approx(1 - auc([-s for s in scores], labels))


def test_precision_and_slices(spark):
    df = spark.createDataFrame([(0, 5.0, 1), (1, 3.0, 0), (2, 3.0, 1)], "k int, s double, l int")
    assert value(rs.precision_at_k(df, "s", "l", "k", 2)) == 0.5
    assert value(rs.precision_at_k(df, "s", "l", "k", 0)) is None
    assert value(rs.precision_at_k(df.limit(0), "s", "l", "k", 3)) is None
    from pyspark.sql import functions as F

    for n in (1, 2, 5, 7, 12):
        got = [r[0] for r in spark.range(n).select(rs.slice_of_four(F.col("id"), F.lit(n))).collect()]
        assert got == [q for q in range(4) for _ in range(q * n // 4, (q + 1) * n // 4)]
    assert [r[0] for r in spark.range(5).select(rs.slice_of_four(F.col("id"), F.lit(5))).collect()].count(3) == 2


def test_partitions_do_not_matter(spark):
    df = frame(spark, [(i, float(i * 7 % 13), float(i * 5 % 11), float(i % 3)) for i in range(200)])
    got = set()
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.add(value(rs.partial_spearman(df.repartition(n), "x", "y", "z", "k")))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == 1


def test_group_precisions(spark):
    """Against a plain loop: groups of 0 to 60 rows, ties, null scores and a null group."""
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, 1.0, 2.0, 3.0]), float(i % 7), rng.choice([0, 1])) for g, n in (("a", 3), ("b", 9), ("c", 10), ("d", 27), ("e", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, label int")
    got = {(r.g, r.k, r.score): r.value for r in rs.group_precisions(df, ["x", "y"], "label", "id", ["g"]).collect()}
    expected = {}
    for g in "abcde":
        mine = [r for r in rows if r[0] == g]
        for k in [k for k in (10, 25, 50) if k <= len(mine)] or [max(1, len(mine) // 10)]:
            for score, at in (("x", 2), ("y", 3)):
                best = sorted(mine, key=lambda r: (r[at] is None, -(r[at] or 0), r[1]))[:k]
                expected[g, k, score] = sum(r[4] for r in best) / k
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in expected.items()}
    assert rs.group_precisions(df.limit(0), ["x"], "label", "id", ["g"]).count() == 0
