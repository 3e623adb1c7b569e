import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import cooccurrence as c

ROWS = "sha string, file_id bigint"


def brute(rows, least=5, share=0.5, lift=3.0):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None:
            baskets[b] |= {i} - {None}
    single, both = defaultdict(int), defaultdict(int)
    for items in baskets.values():
        for i in items:
            single[i] += 1
        for p in combinations(sorted(items), 2):
            both[p] += 1
    n = len(baskets)
    return {(a, b, k) for (a, b), k in both.items() if k >= least and k >= share * min(single[a], single[b]) and k * n >= lift * single[a] * single[b]}


def random_rows(seed, baskets=120, items=40, wide=()):
    rng = random.Random(seed)
    rows = []
    for i in range(baskets):
        base = rng.randrange(items)
        rows += [(f"c{i}", (base + j) % items) for j in range(rng.randint(1, 4))]
    for w in wide:
        rows += [(f"w{w}", i) for i in range(w)]
    return rows + rows[:30] + [("only-null", None), (None, 3), (None, None)]


def found(df, **options):
    return {(r.item_a, r.item_b, r.n_ab) for r in c.cooccurrence(df, "sha", "file_id", **options).collect()}


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_against_brute_force(spark, block):
    rows = random_rows(1, wide=(30, 38))
    df = spark.createDataFrame(rows, ROWS).withColumns({"k1": F.lit("x"), "item": F.lit(0), "n": F.lit(1), "n_baskets": F.lit(9), "side": F.lit(1)})
    assert found(df, block_items=block) == brute(rows) != set()
    loose = {"min_count": 1, "min_share": 0.0, "min_lift": 0.0}
    assert found(df, block_items=block, **loose) == brute(rows, 1, 0, 0)


def test_small_chunks(spark, monkeypatch):
    rows = random_rows(2, wide=(25,))
    monkeypatch.setattr(c, "CHUNK_PAIRS", 7)
    batches = [b for b in c._products(__import__("numpy").array([1, 2, 3, 4]), __import__("numpy").array([1, 2, 3, 4]), __import__("numpy").array([3, 2, 1, 0]))]
    assert sum(b.num_rows for b in batches) == 6
    assert found(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_one_item_in_most_rows(spark):
    rows = [(f"c{i}", 7) for i in range(200)] + [(f"c{i}", 100 + i % 5) for i in range(60)] + [(f"c{i}", 200 + i % 5) for i in range(60)]
    assert found(spark.createDataFrame(rows, ROWS)) == brute(rows) != set()


def test_empty_and_long_names(spark):
    assert found(spark.createDataFrame([], ROWS)) == set()
    rows = [("x" * 100_000 + str(i), j) for i in range(6) for j in (1, 2)] + [(f"y{i}", 9) for i in range(30)]
    assert found(spark.createDataFrame(rows, ROWS)) == {(1, 2, 6)}
