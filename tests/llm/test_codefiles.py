from pyspark.sql import functions as F

from lodestrata.llm import codefiles as c

ROWS = "path string, lang string, add_lines int, del_lines int, mut_fns int, new_fns int, is_test boolean"
HAND = ["src/{}/vendor_sync/{}.rs", "src/main/java/x/target/{}{}.java", "lib/{}/{}_generated_ids_check.py", "src/minify/{}{}Minifier.js", "tests/{}/test_{}.py", "docs/{}-{}.md", "src/tables/{}_{}_lut_builder.rb"]
MADE = ["x/vendor/{}kit/{}.js", "api/{}/{}.pb.go", "web/dist/{}{}.bundle.js", "src/data/{}_{}_blob.c", "a/third_party/{}-1.2.3/{}.c", "public/js/{}{}.0af3c9.js", "pkg/mocks/mock_{}_{}.go", "x/{}/{}.g.cs"]
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]


def frame(spark, paths, made=False):
    rows = [(p, None if i % 3 else "x", 900 + i if made else 10 + i % 7, 3, 0 if made else 2, 1 if not made else 0, None) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, ROWS)


def fill(patterns):
    return [p.format(a, b) for p in patterns for a in WORDS for b in WORDS]


def changes_of(spark):
    return frame(spark, fill(MADE), True).unionByName(frame(spark, fill(HAND)))


def test_notices(spark):
    df = spark.createDataFrame([(p, 1) for p in fill(MADE)] + [(p, 0) for p in fill(HAND)], "file string, want int")
    wrong = df.withColumn("kind", c.notice_kind(F.col("file"))).where("(kind is not null) <> (want = 1)").collect()
    assert wrong == []


def test_notices_are_hidden():
    assert c.grams("a/third_party/kit-1.2.3/x.c", True) == ["d:a", "f:x", "e:c", "f:x>e:c"]
    assert c.grams("api/order.pb.go", True) == ["d:api", "f:order", "d:api>f:order", "e:go"]
    assert c.grams("x_pb2.py", True) == ["f:x", "e:py"]
    assert "d:third" in c.grams("a/third_party/kit-1.2.3/x.c", False)
    assert c.grams("", True) == c.grams("/", False) == []


def test_forest_decides_held_out(spark):
    """Each file is scored without its own label, from features that see no notice."""
    _, scored = c.score_files(changes_of(spark))
    at = c.best_threshold(scored)
    found = F.col("score") >= at
    r = scored.agg(F.count_if(found & (F.col("label") == 1)).alias("both"), F.count_if(found).alias("found"), F.sum("label").alias("true")).first()
    assert r.both / r.true > 0.9 and r.both / r.found > 0.9


def test_no_notice_is_read_to_score(spark, monkeypatch):
    """A file is found by its traits: one that no notice covers, among files that look like it."""
    twin = "pkg/mocks/plain_alpha.go"  # made like pkg/mocks/mock_*.go, without the notice
    assert not any(p.search(twin) for p in c._NOTICE)
    rows = changes_of(spark).unionByName(frame(spark, [twin], True))
    assert twin in {r.path for r in c.unwritten_files(rows).collect()}


def test_bounded_sample_keeps_the_balance(spark):
    _, scored = c.score_files(changes_of(spark), rows=60)
    right = scored.agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert scored.count() == len(fill(MADE)) + len(fill(HAND)) and right > 0.8


def test_threshold(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.7), (0.0, 0.4), (0.0, 0.0)], "label double, score double")
    assert c.best_threshold(df) == 0.7
    assert c.best_threshold(df.limit(0)) == 1.0
    assert c.best_threshold(df.where("label = 0")) == 1.0


def test_forms_and_bad_rows(spark):
    forms = [" ./api/alpha/beta.pb.go", "api\\alpha\\beta.pb.go\t", "api/alpha/beta.pb.go", "api/alpha/beta.pb.go"]
    odd = ["", "  ", None, "src/" + "long/" * 5000 + "x.py", "日本語/ü.py", "x", "/", "."]
    rows = changes_of(spark).unionByName(frame(spark, forms, True)).unionByName(frame(spark, odd))
    names = ("file", "kind", "n", "label", "gram", "fold", "rate", "score")
    got = {r.path for r in c.unwritten_files(rows.withColumns({n: F.lit("f") for n in names})).collect()}
    assert set(forms) <= got and not got & set(odd)


def test_one_label_and_empty(spark):
    assert c.unwritten_files(frame(spark, ["src/a.py", "src/b.py"])).collect() == []
    assert c.unwritten_files(frame(spark, ["a/vendor/b.c"])).collect() == []
    assert c.unwritten_files(frame(spark, ["a"]).limit(0)).collect() == []


def test_nulls_everywhere(spark):
    rows = spark.createDataFrame([("a/vendor/b.c", *[None] * 6), ("src/a.c", *[None] * 6), (None, *[None] * 6)], ROWS)
    _, scored = c.score_files(rows)
    assert {(r.file, r.label, r.score) for r in scored.collect()} == {("a/vendor/b.c", 1.0, 0.0), ("src/a.c", 0.0, 0.0)}
