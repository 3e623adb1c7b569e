import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import packing as p


def best_padding(sizes, counts, buckets):
    m = len(sizes)
    best = [[0.0] + [float("inf")] * m]
    for _ in range(buckets):
        row = [0.0] + [min(best[-1][i] + sum(counts[k] * (sizes[j] - sizes[k]) for k in range(i, j + 1)) for i in range(j + 1)) for j in range(m)]
        best.append(row)
    return best[-1][m]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=14), st.integers(1, 6))
def test_buckets_are_optimal(histogram, buckets):
    sizes = sorted(histogram)
    counts = [histogram[s] for s in sizes]
    bounds = p.optimal_buckets(sizes, counts, buckets)
    assert len(bounds) <= buckets and bounds[-1] == sizes[-1] and bounds == sorted(bounds)
    padding = sum(n * (min(b for b in bounds if b >= s) - s) for s, n in histogram.items())
    assert padding == best_padding(sizes, counts, min(buckets, len(sizes)))


def pack(spark, sizes, capacities, **options):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint").withColumns({"bucket": F.lit("b"), "rest": F.lit(0), "_p": F.lit(1), "salt": F.lit("s"), "capacity": F.lit(3)})
    return p.pack_items(df, capacities, **options)


def check(sizes, capacity, rows):
    used, parts = {}, {}
    for r in rows:
        used[r.pack_id] = used.get(r.pack_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
    assert max(used.values(), default=0) <= capacity and set(parts) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        mine = sorted(parts[i])
        assert sum(x[2] for x in mine) == (s or 0) and len(mine) == max(1, -(-(s or 0) // capacity))
        assert [x[0] for x in mine] == list(range(len(mine))) and [x[1] for x in mine] == [k * capacity for k in range(len(mine))]
    return used


def test_packs(spark):
    rng = random.Random(4)
    sizes = [min(5_000, int(rng.paretovariate(0.8) * 8)) for _ in range(1_500)] + [0, 0, None, 64, 64, 256, 512, 1024] + [30] * 800
    for salts in (1, 16):
        rows = pack(spark, sizes, [("a", 64), ("b", 256)], salts=salts).collect()
        for name, capacity in (("a", 64), ("b", 256)):
            used = check(sizes, capacity, [r for r in rows if r.pack_name == name])
            total = sum(s or 0 for s in sizes)
            assert total / (len(used) * capacity) > 0.97
    filled = {r.pack_name: r for r in p.fill(pack(spark, sizes, [("a", 64)])).collect()}["a"]
    assert filled.fullest <= 64 and filled.n_tokens == sum(s or 0 for s in sizes)


def test_few_buckets_still_fit(spark):
    sizes = [random.Random(i).randint(1, 100) for i in range(400)]
    check(sizes, 100, pack(spark, sizes, [("a", 100)], buckets=3).collect())


def test_small_inputs(spark):
    assert pack(spark, [], [("a", 8)]).collect() == []
    assert [(r.pack_id, r.n_tokens) for r in pack(spark, [0], [("a", 8)]).collect()] == [("0", 0)]
    assert len({r.pack_id for r in pack(spark, [8], [("a", 8)]).collect()}) == 1
    check([20], 8, pack(spark, [20], [("a", 8)]).collect())
    with pytest.raises(ValueError):
        pack(spark, [1], [("a", 0)])


def test_comparison_with_buckets_alone(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 90) for i in range(900)], "doc_id bigint, n_tokens bigint")
    [(name, packs, tokens)] = list(p.bucket_batches(sizes, [("a", 100)]))
    assert name == "a" and tokens == sum(1 + i % 90 for i in range(900)) and packs > p.pack_items(sizes, [("a", 100)]).select("pack_id").distinct().count()
