import random

from pyspark.sql import functions as F

from lodestrata.operators import charts, features, identity, impact, szz
from lodestrata.operators.impact import _claims

CHANGES = "sha string, file_id bigint, path string, lang string, add_lines int, del_lines int, mutation_cost bigint, godclass_cost bigint, is_test boolean, ts bigint, is_fix boolean, seq bigint, status string"
COMMITS = "sha string, email string, author string, subject string, ts bigint, seq bigint, is_merge boolean, ingested_at timestamp"


def change(sha, file_id, add=1, gone=0, ts=1, seq=1, fix=False, lang="java", mut=0, god=0, test=False):
    return (sha, file_id, f"f{file_id}.java", lang, add, gone, mut, god, test, ts, fix, seq, "M")


def test_entropy(spark):
    df = spark.createDataFrame([change("a", 1, 1), change("a", 2, 3), change("b", 1, 5), change("c", 1, None, None), change("c", 3, 0)], CHANGES)
    got = {r.file_id: round(r.entropy, 7) for r in features.change_entropy(df).collect()}
    assert got == {1: 0.8112781, 2: 0.8112781}
    assert {r.sha: round(r.entropy, 7) for r in features.commit_entropy(df).collect()} == {"a": 0.8112781, "b": 0.0}


def test_file_features(spark):
    rows = [
        change("a", 1, 2, 1, ts=5, seq=1, mut=10, god=4), change("a", 1, 2, 1, ts=5, seq=1, mut=10, god=4), change("b", 1, ts=20, seq=2, fix=True, lang=""),
        change("c", 1, ts=4, seq=3, fix=True, lang="kotlin"), change("d", 2, ts=30, seq=4, test=True), change("e", None, ts=1, seq=5), change("f", 3, None, None, ts=None, seq=6, lang=None),
    ]
    commits = spark.createDataFrame([("a", "x", "A", "s", 5, 1, False, None), ("a", "x", "A", "s", 5, 1, False, None), ("c", "", "A", "s", 4, 3, False, None)], COMMITS)
    units = spark.createDataFrame([("a", 1, "u", 3), ("b", 1, "u", 9), ("b", 2, "u", None)], "sha string, file_id bigint, unit string, cc int")
    ids = spark.createDataFrame([(1, "src/F.java")], "id bigint, canonical_path string")
    got = {r.file_id: r for r in features.file_features(spark.createDataFrame(rows, CHANGES), commits, units, ids, 10).collect()}
    one = got[1]
    assert (one.path, one.lang, one.impact_mut, one.impact_comp, one.churn, one.n_commits, one.n_authors, one.max_cc, one.hotspot) == ("src/F.java", "kotlin", 20, 28, 7, 2, 1, 9, 18)
    assert (one.fix_all, one.fix_after) == (2, 1)
    assert (got[2].path, got[2].churn, got[2].is_test, got[2].max_cc) == ("?", 0, True, 0) and None not in got
    strict = {r.file_id: r for r in features.file_features(spark.createDataFrame(rows, CHANGES), commits, units, ids, 10, strict_split=True).collect()}
    assert (strict[1].max_cc, strict[2].is_test, strict[2].lang) == (3, False, "")
    whole = {r.file_id: r for r in features.file_features(spark.createDataFrame(rows, CHANGES), commits, units, ids).collect()}
    assert (whole[1].churn, whole[1].fix_after) == (8, 0)


def test_split(spark):
    times = lambda n: spark.createDataFrame([(10 * i,) for i in range(1, n + 1)] + [(0,), (None,)], "ts bigint")
    assert features.split_timestamp(times(20), 0.75).first().split_ts == 160
    assert features.split_timestamp(times(19), 0.75).first().split_ts is None
    assert features.split_timestamp(times(20), 1.0).first().split_ts == 200
    assert features.split_timestamp(times(0), 0.75).first().split_ts is None


def test_coupling(spark):
    rows = [change(f"c{i}", f) for i in range(3) for f in (1, 2)] + [change("x", 1)] + [change("wide", f) for f in range(1, 32)]
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, canonical_path string")
    got = features.coupling(spark.createDataFrame(rows, CHANGES), ids).collect()
    assert [(r.support, r.confidence, r.file_a, r.file_b) for r in got] == [(3, 0.75, "a", "b")]
    assert features.coupling(spark.createDataFrame(rows, CHANGES), ids, max_files=40, min_support=4).count() == 1
    assert features.coupling(spark.createDataFrame([], CHANGES), ids).collect() == []


def test_last_writers(spark):
    rows = [change("a", 1, seq=1), change("b", 1, seq=2), change("b2", 1, seq=2), change("f", 1, gone=2, seq=3, fix=True), change("g", 1, gone=0, seq=4, fix=True), change("h", 2, gone=1, seq=1, fix=True)]
    got = {(r.fix_sha, r.inducing_sha, r.file_id) for r in szz.last_writer_links(spark.createDataFrame(rows * 2, CHANGES)).collect()}
    assert got == {("f", "b", 1), ("f", "b2", 1)}
    assert szz.last_writer_links(spark.createDataFrame([], CHANGES)).collect() == []


UNIT = "array<struct<name:string,container:string,start_line:int,end_line:int,cc:int>>"
RANGE = "array<struct<start:int,count:int>>"
VERSION = f"k int, before {UNIT}, after {UNIT}, before_lines array<string>, after_lines array<string>, added {RANGE}, removed {RANGE}"


def impacts(spark, *rows, **options):
    got = impact.unit_impacts(spark.createDataFrame(list(rows), VERSION), ["k"], **options).collect()
    return {(r.k, r.unit): (r.kind, r.cc, r.dlines, r.wmc_other, r.cost) for r in got}


def test_impact(spark):
    new = (1, None, [("C::m", "C", 1, 10, 4)], None, ["x"] * 10, [(1, 10)], None)
    before = [("C::a", "C", 1, 3, 2), ("C::b", "C", 4, 6, 7)]
    changed = (2, before, [("C::a", "C", 1, 4, 3), ("C::b", "C", 5, 7, 7)], ["x"] * 6, ["x"] * 7, [(2, 2)], [(2, 1)])
    only_removed = (3, before, before, ["x"] * 6, ["x"] * 6, [], [(2, 1)])
    got = impacts(spark, new, changed, only_removed)
    assert got == {(1, "C::m"): ("godclass", 4, 10, 0, 40), (2, "C::a"): ("mutation", 3, 3, 7, 63)}
    assert impacts(spark, changed, wmc_context="after")[2, "C::a"] == ("mutation", 3, 3, 7, 63)
    assert impacts(spark, new, wmc_context="after")[1, "C::m"][3] == 0
    twice = (4, [("f", "", 1, 1, 2), ("f", "", 2, 2, 5)], [("f", "", 1, 1, 3)], ["a", "b"], ["c"], [(1, 1)], [(1, 2)])
    assert impacts(spark, twice)[4, "f"] == ("mutation", 3, 2, 2, 12)


def test_renames(spark):
    old = [("a", "", 1, 1, 1), ("b", "", 2, 2, 1), ("kept", "", 3, 3, 1)]
    new = [("n", "", 1, 1, 1), ("o", "", 2, 2, 1), ("kept", "", 3, 3, 1)]
    lines = ["p q r", "p q r", "z"]
    got = impacts(spark, (1, old, new, lines, ["p q r s t", "p q r", "z"], [(1, 2)], [(1, 2)]))
    assert {k[1]: v[0] for k, v in got.items()} == {"n": "rename", "o": "rename"}
    assert _claims([["p", "q", "r", "s", "t"]], [["p", "q", "r"]], 0.6) == [0]
    assert _claims([["p"]], [["p"], ["p"]], 0.6) == [1]
    assert _claims([["p"], ["p"]], [["p"], ["p"]], 0.6) == [1, 0]
    assert _claims([[]], [[]], 0.6) == [0] and _claims([["p"]], [["q"]], 0.6) == [-1]


def test_commit_impact(spark):
    df = spark.createDataFrame([("a", "x.py", "M", 6, 2), ("a", "y.py", "A", 4, 3), ("a", "z.py", "R", 0, 0), ("a", "w.py", "D", 0, 0)], "sha string, path string, status string, mutation_cost bigint, godclass_cost bigint")
    got = impact.commit_impact(df, F.col("status").isin("A", "M", "R")).first()
    assert (got.files_changed, got.impact_mutation, got.impact_godclass, got.impact_composite) == (3, 10, 5, 45)


def fold(events):
    """The identity rule, one event after the other."""
    alias, canonical = {}, {}
    for _, _, path, old in sorted(events):
        if old in alias:
            alias[path] = alias[old]
            canonical[alias[old]] = path
        elif path not in alias:
            alias[path] = len(canonical) + 1
            canonical[alias[path]] = path
    return alias, canonical


EVENTS = "seq bigint, ordinal bigint, path string, rename_from string"


def check_identity(spark, events):
    ids, alias = identity.file_identity(spark.createDataFrame(events, EVENTS))
    got = {r.path: r.file_id for r in alias.collect()}, {r.id: r.canonical_path for r in ids.collect()}
    key = lambda e: (e[0], e[1], e[2], e[3] or "")
    assert got == fold([(a, b, c, d if d is not None else "\0none") for a, b, c, d in sorted(events, key=key)])


def test_identity(spark):
    check_identity(spark, [(1, 0, "a", None), (2, 0, "b", "a"), (3, 0, "a", None)])
    check_identity(spark, [(1, 0, "b", "gone"), (2, 0, "c", "b"), (2, 1, "b", None), (3, 0, "d", "c"), (4, 0, "b", "d"), (5, 0, "x", None), (6, 0, "x", "b")])


def test_identity_at_random(spark):
    rng = random.Random(5)
    for _ in range(3):
        names = "abcdef"
        events = [(s, o, rng.choice(names), rng.choice([None, None, *names])) for s in range(25) for o in range(rng.randint(1, 2))]
        check_identity(spark, [(s, o, p, None if r == p else r) for s, o, p, r in events])


def test_charts(spark):
    series = spark.createDataFrame([("m", float(v)) for v in (1, 1, 100, 0)] + [("n", 0.0), ("o", 3.0), ("o", 4.0)], "metric string, value double")
    assert {r.metric: r.scale for r in charts.axis_scale(series).collect()} == {"m": "log", "n": "linear", "o": "linear"}
    points = spark.createDataFrame([(i, i % 10 == 0) for i in range(100)], "idx bigint, bug boolean")
    kept = sorted(r.idx for r in charts.downsample(points, 40).collect())
    blues = [i for i in range(100) if i % 10]
    assert kept == sorted([i for i in range(100) if i % 10 == 0] + blues[::3])
    assert charts.downsample(points, 5).count() == 100 and charts.downsample(points, 100).count() == 100
    medians = charts.upper_median(spark.createDataFrame([("r", float(v)) for v in (4, 1, 3, 2)], "g string, v double"), "v", ["g"])
    assert medians.first().median == 3.0


def test_last_before(spark):
    """A key that half of all rows have, among others, null orders and gaps: as a window over the whole key gives it."""
    from pyspark.sql import Window

    from lodestrata.operators.order import last_before

    rng = random.Random(2)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", "c"]), rng.choice([rng.randint(0, 50), i]) if i % 97 else None, i, i if rng.random() < 0.3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, seq bigint, id int, v int")
    whole = Window.partitionBy("k").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r.id, r.p) for r in df.withColumn("p", F.last("v", True).over(whole)).collect()}
    found = last_before(df, "k", "seq", ["id"], "v", "p", width=100)
    assert {(r.id, r.p) for r in last_before(df, "k", "seq", ["id"], "v", "p").collect()} == want
    assert {(r.id, r.p) for r in found.collect()} == want and found.columns == ["k", "seq", "id", "v", "p"]
    assert last_before(df.limit(0), "k", "seq", ["id"], "v", "p").collect() == []


def test_hot_key_is_split(spark):
    """One file has half of 200,000 rows: no task orders more than a few times what the median one does."""
    from pyspark.sql import Window

    from lodestrata.operators.order import last_before, parted

    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"), F.spark_partition_id().alias("v"))
    found = last_before(rows, "k", "seq", [], "seq", "before", width=5_000)
    sizes = sorted(r["count"] for r in found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    assert found.where("k = 0 and seq > 0 and before <> seq - 2").count() == 0 and found.where("before is null").count() == 100_001
    sizes = [r["count"] for r in parted(rows, "seq").groupBy("_part").count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_range_of(spark):
    from lodestrata.operators.order import range_of

    for ranges in (2, 3, 10, 65):
        cuts = list(range(10, 10 * ranges, 10))
        df = spark.range(0, 10 * ranges + 11).select("id", F.array(*[F.lit(c) for c in cuts]).alias("cuts"))
        assert all(r.p == sum(c < r.id for c in cuts) for r in df.select("id", range_of(F.col("id"), F.col("cuts"), ranges).alias("p")).collect())


def test_chart_cells_are_bounded(spark):
    """More bugs than any chart has cells: all are counted, few rows come out."""
    rows = spark.range(60_000).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("sha"), F.col("id").alias("seq"), (F.col("id") % 3 > 0).alias("is_fix"), F.lit(False).alias("is_revert"),
        F.lit("e").alias("email"), F.lit("a").alias("author"), F.lit("s").alias("subject"), F.col("id").alias("ts"), F.lit(None).cast("timestamp").alias("ingested_at"), F.lit(False).alias("is_merge"),
        *[(F.col("id") * F.col("id") % 1009).alias(m) for m in charts.METRICS],
    )
    cells = charts.chart_cells(charts.commit_series(rows), 50, 20).collect()
    assert len(cells) <= len(charts.METRICS) * 50 * 20 * 2 and sum(c.n for c in cells) == 60_000 * len(charts.METRICS)
    assert {c.total for c in cells} == {60_000} and max(c.column for c in cells) == 49 and max(c.row for c in cells) == 19
    assert charts.chart_cells(charts.commit_series(rows.limit(0)), 50, 20).collect() == []
