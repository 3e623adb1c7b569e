from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import messages, paths, units
from lodestrata.functions.paths import glob_regex


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_paths(spark):
    inputs = ["vendor/x.js", "src/FooTest.java", "test/Foo.java", "foo.d/Makefile", "lib/a.min.js", "", None]
    assert values(spark, paths.extension("x"), inputs) == [".js", ".java", ".java", ".d/makefile", ".js", "", ""]
    assert values(spark, paths.is_ignored("x"), inputs) == [True, False, False, False, True, False, False]
    assert values(spark, paths.is_test("x"), inputs) == [False, True, False, False, False, False, False]
    assert values(spark, paths.is_source("x"), inputs) == [False, True, True, False, False, False, False]
    assert values(spark, paths.language("x"), ["a.KT", "a.mm", "a.txt", None]) == ["kotlin", "objectivec", None, None]


def test_globs():
    import re

    for glob, text, hit in [("**/*.c", "a/b\n.c", True), ("a[!b]c", "axc", True), ("a[!b]c", "abc", False), ("a?c", "a/c", True), ("*.x", "b.xy", False)]:
        assert bool(re.match(glob_regex(glob).replace("\\z", "\\Z"), text)) == hit


def test_messages(spark):
    inputs = ["Fix #12", "prefix only", "KAFKA-123: tidy, see #45", "UTF-8 cleanup", 'Revert "add x"', "regressing slowly", "", "race   condition"]
    flags = messages.classify(F.col("x"))
    assert values(spark, flags["has_keyword"], inputs) == [True, False, False, False, False, False, False, True]
    assert values(spark, flags["is_revert"], inputs) == [False] * 4 + [True] + [False] * 3
    assert values(spark, flags["issue_refs"], inputs) == [["12"], [], ["", "45"], [""], [], [], [], []]
    assert values(spark, flags["is_fix"], inputs) == [True, False, False, False, True, False, False, True]


def test_message_is_stripped(spark):
    df = spark.createDataFrame([(" a ", "\n b\t\n"), (None, None)], "subject string, body string")
    assert [r[0] for r in df.select(messages.message()).collect()] == ["a \n\n b", ""]


def test_hunks(spark):
    got = {n: values(spark, c, ["@@ -5 +5,2 @@", "@@ -1,0 +2 @@ f", "@@ bad", None]) for n, c in units.hunk_ranges(F.col("x")).items()}
    assert got == {"old_start": [5, 1, None, None], "old_count": [1, 0, None, None], "new_start": [5, 2, None, None], "new_count": [2, 1, None, None]}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 30), st.lists(st.integers(1, 6), max_size=5)), min_size=1, max_size=6))
def test_overlap_counts_lines(spark, cases):
    rows = []
    for i, (start, length, gaps) in enumerate(cases):
        ranges, at = [], 0
        for g in gaps:
            ranges.append((at + g, g))
            at += 2 * g
        lines = {x for s, n in ranges for x in range(s, s + n)}
        rows.append((i, start, start + length, ranges, len(lines & set(range(start, start + length + 1)))))
    df = spark.createDataFrame(rows, "i int, s int, e int, r array<struct<start:int,count:int>>, want int")
    assert all(r.got == r.want for r in df.withColumn("got", units.range_overlap(F.col("s"), F.col("e"), F.col("r"))).collect())


def test_tokens_and_cost(spark):
    assert values(spark, units.token_set(F.col("x")), ["a b a _c 1d", "", None]) == [["a", "b", "_c", "d"], [], []]
    assert values(spark, units.jaccard(units.token_set(F.col("x")), F.array(F.lit("a"), F.lit("b"))), ["a", "c", ""]) == [0.5, 0.0, 0.0]
    assert values(spark, units.jaccard(units.token_set(F.col("x")), F.array().cast("array<string>")), [""]) == [1.0]
    assert values(spark, units.container(F.col("x")), ["A::B::m", "helper", None]) == ["A::B", "", ""]
    df = spark.createDataFrame([(0, 4, 10), (7, 3, 3), (2_000_000_000, 2_000, 2_000)], "w int, c int, d int")
    assert [r[0] for r in df.select(units.unit_cost(F.col("w"), F.col("c"), F.col("d"))).collect()] == [40, 63, 8_000_000_000_000_000]
