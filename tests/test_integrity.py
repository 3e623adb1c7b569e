import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import orphans, skew
from lodestrata.operators.components import connected_components
from lodestrata.operators.order import numbered

CHANGES = "sha string, file_id bigint, add_lines int, del_lines int"


def at(day):
    return dt.datetime(2020, 1, day, 12)


def test_salted_totals(spark):
    rows = [(f"c{i % 40}", 1 if i % 3 else i, i, None) for i in range(300)] + [("c1", None, 5, 5)] * 20 + [(None, 1, None, None)]
    extra = spark.createDataFrame(rows, CHANGES).withColumns({"_salt": F.lit("x"), "n_rows": F.lit(-1), "_key": F.lit(2), "measure": F.lit("m")})
    got = {r.file_id: r for r in skew.file_totals(extra, "file_changes").collect()}
    want = {}
    for sha, f, a, d in rows:
        n, shas, amount, largest = want.setdefault(f, [0, set(), 0, 0])
        want[f] = [n + 1, shas | ({sha} - {None}), amount + (a or 0) + (d or 0), max(largest, (a or 0) + (d or 0))]
    assert {f: [r.n_rows, r.n_commits, r.amount, r.largest] for f, r in got.items()} == {f: [n, len(s), a, m] for f, (n, s, a, m) in want.items()}
    assert got[1].n_salts > 1 and got[None].n_salts >= 1 and min(r.n_salts for r in got.values()) == 1


def test_heavy_keys(spark):
    rows = [("s%d" % i, 7) for i in range(4)] + [("t%d" % i, i + 100) for i in range(90)] + [("u", None)] * 6
    df = spark.createDataFrame(rows, "sha string, file_id bigint")
    assert [(r.file_id, r.n_rows, r.total_rows) for r in skew.heavy_keys(df, "file_id", ["sha"]).collect()] == [(7, 4, 100)]
    assert skew.heavy_keys(df.unionByName(spark.createDataFrame([("v", 999)], df.schema)), "file_id", ["sha"]).collect() == []
    assert skew.heavy_keys(df.limit(0), "file_id", ["sha"]).collect() == []
    ties = spark.createDataFrame([("a", i % 2) for i in range(10)], "sha string, file_id bigint")
    assert sorted(r.file_id for r in skew.heavy_keys(ties, "file_id", ["sha"]).collect()) == [0, 1]


def world(spark):
    commits = spark.createDataFrame(
        [("AA ", at(2), None), ("aa", at(5), None), ("bb", at(1), at(10)), ("cc", None, None), (None, at(1), None)], "sha string, ingested_at timestamp_ntz, removed_at timestamp_ntz"
    )
    links = spark.createDataFrame(
        [(" Aa", "bb", at(2)), ("aa", "bb", at(1)), ("bb", "zz", at(10)), ("cc", None, at(20)), ("aa", "bb", None), ("", "bb", at(9)), ("é" * 200, "a\0", at(3))] * 2,
        "fix_sha string, inducing_sha string, ingested_at timestamp_ntz",
    )
    changes = spark.createDataFrame([(1, at(3)), (2, at(3)), (None, at(3)), (3, at(1))], "file_id bigint, ingested_at timestamp_ntz")
    ids = spark.createDataFrame([(1, at(1), None), (3, at(1), at(1))], "id bigint, ingested_at timestamp_ntz, removed_at timestamp_ntz")
    return links, changes, commits, ids


def test_orphans(spark):
    links, changes, commits, ids = world(spark)
    extra = {"key": F.lit(1), "tag": F.lit("t"), "period": F.lit("p"), "kind": F.lit(0)}
    refs = orphans.history_references(links.withColumns(extra), changes.withColumns(extra))
    targets = orphans.history_targets(commits.withColumns(extra), ids.withColumns(extra))
    want = {
        ("bug_links", "fix_sha", "aa"), ("bug_links", "fix_sha", "bb"), ("bug_links", "fix_sha", "cc"), ("bug_links", "fix_sha", ""), ("bug_links", "fix_sha", "é" * 200),
        ("bug_links", "inducing_sha", "zz"), ("bug_links", "inducing_sha", "a\0"), ("file_changes", "file_id", "2"), ("file_changes", "file_id", "3"),
    }
    for ranges in (1, 5):
        got = orphans.orphan_keys(refs, targets, ranges).collect()
        assert {(r.table_name, r.column_name, r.ref_key) for r in got} == want and len(got) == len(want) and {r.period for r in got} == {"2020-01"}
    report = {r.column_name: (r.n_refs, r.n_orphans, r.n_orphan_keys) for r in orphans.orphan_report(refs, targets).collect()}
    assert report == {"fix_sha": (12, 10, 5), "inducing_sha": (10, 4, 2), "file_id": (3, 2, 2)}


def test_orphans_of_empty_tables(spark):
    links, changes, commits, ids = world(spark)
    refs = orphans.history_references(links, changes)
    none = orphans.history_targets(commits.limit(0), ids.limit(0))
    assert orphans.orphan_keys(refs, none).count() == 11
    assert orphans.orphan_keys(refs.limit(0), orphans.history_targets(commits, ids)).count() == 0


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("x", "x"), ("c", "a"), (None, "a"), ("e", "d")] + [(f"p{i}", f"p{i + 1}") for i in range(10, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert (got["c"], got["e"], got["x"], got["p40"]) == ("a", "d", "x", "p10") and len(set(got.values())) == 4
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(200)] + [(None, "n")], "x bigint, y string")
    got = [r.y for r in numbered(df, "x", ["y"]).orderBy("place").collect()]
    assert got == ["n", *[str(i) for i in sorted(range(200), key=lambda i: (i * 7 % 50, str(i)))]]
