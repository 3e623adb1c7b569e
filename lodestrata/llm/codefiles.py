"""Generated, minified, vendored and data files among source paths."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestrata.session import cut

# Notices, by which tools and package managers say in a path what a file is. On the path with
# forward slashes; a notice is a whole directory name or a marked place in the file name, never part of a word.
NOTICES = {
    "generated": [
        r"(?i)(^|/)(generated|generated[-_]sources?|generated[-_]src|__generated__|autogen|auto[-_]?generated|gen)/",
        r"(?i)(^|/)obj/(debug|release|x64|x86)/",
        r"(?i)(^|/)target/(generated|classes)",
        r"(?i)[._-](generated|autogen|autogenerated|gen|g|designer|pb|pb2|pb2_grpc|pb\.gw|grpc|graphql|tab|yy)\.\w+$",
        r"(?i)_pb2(_grpc)?\.pyi?$",
        r"(?i)(^|/)(zz_generated|lex\.|moc_|qrc_|rcc_|ui_\w+\.h$|y\.tab\.)",
        r"(?i)_wrap\.c(xx|pp|c)?$",
        r"(Base)?(Listener|Visitor|Parser|Lexer)\.(interp|tokens)$|Base(Listener|Visitor)\.\w+$",
        r"(?i)(^|/)mocks/mock_\w+\.\w+$",
        r"(?i)\bassemblyinfo\.(cs|vb)$",
        r"(?i)_(string|enumer|easyjson|ffjson)\.go$",
    ],
    "minified": [
        r"(?i)[._-](min|packed|bundle|chunk|compressed|minified|prod)(\.\w+)?\.(js|mjs|cjs|css|ts|map)$",
        r"(?i)[._-](min|packed|compressed|minified)\.\w+$",
        r"(?i)[.~_-](?=[a-f]*\d)[0-9a-f]{6,}(\.\w+)?\.(js|mjs|cjs|css|map)$",
        r"(?i)(^|/)dist/(.*/)?[^/]+\.(js|mjs|cjs|css|map)$",
        r"(?i)(^|/)(public/build|vendor~[^/]*$)",
        r"(?i)(^|/)[^/]+\.(min|bundle|chunk)\.[^/]+$",
    ],
    "vendored": [
        r"(?i)(^|/)(_?vendors?|third[-_]?part(y|ies)|3rd[-_]?party|externals?|extern|deps|dependencies|ext[-_]?libs?|node_modules|"
        r"bower_components|jspm_packages|webjars|site-packages|dist-packages|\.?venv|virtualenv|pods|checkouts|gems|imported|godeps|_workspace)/",
        r"(?i)(^|/)pkg/mod/",
        r"(?i)(^|/)[a-z][\w.]*[-@]v?\d+\.\d+(\.\d+)?([-./]|$)",
    ],
    "data": [
        r"(?i)_(blob|dump|hexdump|wordlist|b64|base64|image_bin|bin|lut_?\d+|font_?\d+x\d+|rc)\.\w+$",
        r"(?i)\.(data|inc|png|jpe?g|gif|ttf|woff|bin)\.(\w+\.)?\w+$",
        r"(Polygons|SpriteData|Sprites|Wordlist|Bindata|LookupTable|Base64)(\.\w+)?\.\w+$",
        r"(?i)(^|/)bindata(_\w+)?\.\w+$",
    ],
}
#: About so many labelled files of either kind and fold train a forest; all files are counted and scored.
TRAINING_ROWS = 20_000
FOLDS = 3
TREES, DEPTH, SEED = 20, 8, 17
#: A word with a larger share of a fold's files is joined by broadcast; as a path has some twenty grams, there are few.
COMMON = 1e-3

#: The parts of a path in which words are counted apart.
PARTS = {"d": "directory", "f": "name", "e": "extension"}
FEATURES = [
    *[f"{part}_{kind}" for part in PARTS.values() for kind in ("most", "mean", "least")], "pair_most", "pair_mean", "pair_least", "odds",
    "compression", "token_entropy", "mean_token", "max_token", "tokens",
    "log_added", "log_largest", "log_removed", "functions", "functions_per_line", "log_changes", "is_test",
]
_STATS = FEATURES[-7:]


def normal_path(path: str | Column) -> Column:
    """One form of a path: forward slashes, no blanks around it, no './' before it."""
    p = F.btrim(F.translate(path, "\\", "/"), F.lit(" \t\r\n"))
    return F.regexp_replace(p, r"^(\./+)+", "")


def notice_kind(path: Column) -> Column:
    """The first kind of NOTICES that the path carries, or null."""
    kind = F.lit(None).cast("string")
    for name, patterns in reversed(NOTICES.items()):
        kind = F.when(path.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(kind)
    return kind


_NOTICE = [re.compile(p) for patterns in NOTICES.values() for p in patterns]
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")


def _entropy(items) -> float:
    n = Counter(items)
    total = sum(n.values())
    return -sum(c / total * math.log2(c / total) for c in n.values()) if total else 0.0


def grams(path: str, hidden: bool) -> list[str]:
    """The words of a path, marked with its part, and their neighbours in pairs; with `hidden` nothing that a notice covers.

    The extension is always kept, whether or not a notice reaches into it, so that its absence tells nothing.
    """
    slash, dot = path.rfind("/"), path.rfind(".")
    spans = [m.span() for r in _NOTICE for m in r.finditer(path)] if hidden else []
    found, before = {}, None
    for m in _WORD.finditer(path):
        part = "d" if m.start() < slash else "e" if slash < dot < m.start() else "f"
        word = None if part != "e" and any(a < m.end() and m.start() < b for a, b in spans) else f"{part}:{m.group().lower()}"
        if word:
            found[word] = None
            if before:
                found[f"{before}>{word}"] = None
        before = word
    return list(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(path: pd.Series, hidden: pd.Series) -> pd.Series:
    return pd.Series([grams(p, h) for p, h in zip(path, hidden, strict=True)])


def word_features(rates: dict[str, float], base: float) -> list[float]:
    """FEATURES but _STATS, from the share of notices among other files with each gram; grams that no other file has are not in `rates`."""
    single = sorted(g for g in rates if ">" not in g)
    sets = [[rates[g] for g in single if g[0] == part] for part in PARTS] + [[v for g, v in rates.items() if ">" in g]]
    out = [x for values in sets for x in ((max(values), sum(values) / len(values), min(values)) if values else (base,) * 3)]
    words = [g[2:] for g in single]
    raw = "/".join(words).encode()
    lengths = [len(w) for w in words] or [0]
    odds = sum(math.log(v / (1 - v)) for v in rates.values())
    return [*out, odds, len(zlib.compress(raw, 6)) / max(1, len(raw)), _entropy(words), sum(lengths) / len(lengths), max(lengths), len(words)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _word_features(gram: pd.Series, rate: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([word_features(dict(zip(g, r, strict=True)), b) for g, r, b in zip(gram, rate, base, strict=True)])


def stored_paths(changes: DataFrame) -> DataFrame:
    """One row per path as stored, with sums over its changes; null and blank paths are left out."""
    lines = F.coalesce("add_lines", F.lit(0)).cast("bigint")
    gone = F.coalesce("del_lines", F.lit(0)).cast("bigint")
    fns = F.coalesce("mut_fns", F.lit(0)).cast("bigint") + F.coalesce("new_fns", F.lit(0))
    return (
        changes.where(F.col("path").isNotNull() & (F.btrim("path", F.lit(" \t\r\n")) != "")).groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(lines).alias("added"), F.max(lines).alias("largest"), F.sum(gone).alias("removed"), F.sum(fns).alias("fns"),
            F.max(F.coalesce("is_test", F.lit(False)).cast("int")).alias("is_test"), F.max(F.lower(F.btrim("lang", F.lit(" ")))).alias("lang"),
        )
        .withColumn("file", normal_path("path"))
    )


def labelled_files(stored: DataFrame) -> DataFrame:
    """(file, id, fold, label, gram, shown, _STATS) per file, whatever the number of stored forms of its path.

    label is 1 with a notice, else 0; gram has the words of the path and its language, shown those that no notice covers,
    and id the 128 bits of a digest of the path, in its place where grams are joined.
    """
    files = (
        stored.groupBy("file")
        .agg(*[F.sum(c).alias(c) for c in ("n", "added", "removed", "fns")], *[F.max(c).alias(c) for c in ("largest", "is_test", "lang")])
        .withColumn("label", notice_kind(F.col("file")).isNotNull())
    )
    spoken = F.when(F.col("lang") != "", F.array(F.concat(F.lit("l:"), "lang"))).otherwise(F.array().cast("array<string>"))
    return files.select(
        "file", F.unhex(F.md5("file")).alias("id"), F.pmod(F.xxhash64("file"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("label").cast("double").alias("label"),
        F.concat(_grams("file", F.lit(False)), spoken).alias("gram"), F.when(F.col("label"), F.concat(_grams("file", F.lit(True)), spoken)).alias("shown"),
        F.log1p(F.col("added") / F.col("n")).alias("log_added"), F.log1p(F.col("largest").cast("double")).alias("log_largest"),
        F.log1p(F.col("removed") / F.col("n")).alias("log_removed"), (F.col("fns") / F.col("n")).alias("functions"),
        (F.col("fns") / (F.col("added") + F.col("removed") + 1)).alias("functions_per_line"), F.log1p(F.col("n").cast("double")).alias("log_changes"),
        F.col("is_test").cast("double").alias("is_test"),
    )


def file_features(files: DataFrame, sizes: dict[tuple[int, float], int], rows: int = TRAINING_ROWS) -> DataFrame:
    """(file, fold, label, fitting, base, FEATURES): each file as it is scored, and the drawn ones as they are learned from (`fitting`).

    A gram's rate is the share of files with a notice among those of one other fold, for which it is counted
    only where no notice covers it; so a word that is always part of a notice has no rate, in no row. A file to
    score takes the rates of the next fold and is scored by the forest of the fold after; a file to learn from takes
    those of the fold before it. Nothing that decides on a file has seen its label, and no path is searched for
    notices to score it. `sizes` has the number of files by fold and label.
    """
    totals = {k: max(1, sum(sizes.get((k, v), 0) for v in (0.0, 1.0))) for k in range(FOLDS)}
    bases = {k: (sizes.get((k, 1.0), 0) + 0.5) / (totals[k] + 1) for k in range(FOLDS)}
    by_fold = lambda values, fold: F.element_at(F.array(*[F.lit(values[k]) for k in range(FOLDS)]), fold + 1)
    seen = (
        files.select("fold", "label", F.explode(F.coalesce("shown", "gram")).alias("gram")).groupBy(F.col("fold").alias("of"), "gram")
        .agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("all"))
    )
    rates = cut(seen.select("of", "gram", ((F.col("yes") + by_fold(bases, F.col("of")) * 2) / (F.col("all") + 2)).alias("rate"), (F.col("all") > by_fold(totals, F.col("of")) * COMMON).alias("common")))
    share = {key: min(1.0, rows / n) for key, n in sizes.items() if n}
    drawn = F.lit(False)
    for (fold, label), part in share.items():
        drawn = drawn | ((F.col("fold") == fold) & (F.col("label") == label) & (F.pmod(F.xxhash64(F.lit(SEED), "file"), F.lit(1 << 20)) < int(part * (1 << 20))))
    use = lambda df, fitting, step, gram: df.select("id", F.lit(fitting).alias("fitting"), F.pmod(F.col("fold") + step, F.lit(FOLDS)).alias("of"), F.explode(gram).alias("gram"))
    tokens = use(files, False, 1, F.col("gram")).unionByName(use(files.where(drawn), True, 2, F.coalesce("shown", "gram")))
    common = tokens.join(F.broadcast(rates.where("common").select("of", "gram", "rate")), ["of", "gram"], "left")
    rare = rates.where("not common").select("of", "gram", F.col("rate").alias("rare"))
    rated = common.where("rate is not null").select("id", "fitting", "gram", "rate").unionByName(
        common.where("rate is null").join(rare, ["of", "gram"]).select("id", "fitting", "gram", F.col("rare").alias("rate"))
    )
    lists = rated.groupBy("id", "fitting").agg(F.collect_list(F.struct("gram", "rate")).alias("rated"))
    known = files.select("id", "file", "fold", "label", *_STATS, F.lit(False).alias("fitting")).unionByName(files.where(drawn).select("id", "file", "fold", "label", *_STATS, F.lit(True).alias("fitting")))
    listed = lambda c, kind: F.coalesce(F.col("rated")[c], F.array().cast(kind))
    base = by_fold(bases, F.pmod(F.col("fold") + F.when(F.col("fitting"), 2).otherwise(1), F.lit(FOLDS)))
    wide = known.join(lists, ["id", "fitting"], "left").withColumn("w", _word_features(listed("gram", "array<string>"), listed("rate", "array<double>"), base))
    words = [F.col("w")[i].alias(c) for i, c in enumerate(FEATURES[: -len(_STATS)])]
    return wide.select("file", "fold", "label", "fitting", *words, *_STATS)


def train_forest(sample: DataFrame, sizes: dict[float, int]) -> RandomForestClassificationModel | None:
    """A forest that tells files with a notice from those without; None if there are not both. Labels weigh by `sizes`, their numbers in all files."""
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    weight = F.when(F.col("label") == 1.0, sizes[1.0] / n[1.0]).otherwise(sizes[0.0] / n[0.0])
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", weight)))


def score_files(changes: DataFrame, rows: int = TRAINING_ROWS) -> tuple[DataFrame, DataFrame]:
    """The stored paths, and (file, label, score) of each file: the votes, for a file not written by hand, of a forest that never saw its label."""
    stored = cut(stored_paths(changes))
    files = cut(labelled_files(stored))
    sizes = {(r.fold, r.label): r.n for r in files.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    features = cut(file_features(files, sizes, rows))
    scored = None
    for k in range(FOLDS):
        learned = (k + 2) % FOLDS
        model = train_forest(features.where(F.col("fitting") & (F.col("fold") == learned)), {v: sizes.get((learned, v), 0) for v in (0.0, 1.0)})
        mine = features.where(~F.col("fitting") & (F.col("fold") == k))
        if model is None:
            part = mine.select("file", "label", F.lit(0.0).alias("score"))
        else:
            votes = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(mine))
            part = votes.select("file", "label", vector_to_array("probability")[1].alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    return stored, cut(scored)


def best_threshold(scored: DataFrame) -> float:
    """The score, in hundredths, above which files agree best with the notices (largest F1; of equals the highest); 1 if none does."""
    steps = scored.groupBy(F.floor(F.col("score") * 100).cast("int").alias("step")).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("all")).collect()
    total = sum(r.yes for r in steps)
    best, at, yes, found = 0.0, 1.0, 0.0, 0
    for r in sorted(steps, key=lambda r: -r.step):
        yes, found = yes + r.yes, found + r["all"]
        f1 = 2 * yes / (total + found)
        if r.step > 0 and f1 > best:
            best, at = f1, r.step / 100
    return at


def unwritten_files(changes: DataFrame, rows: int = TRAINING_ROWS, threshold: float | None = None) -> DataFrame:
    """(path, score) of the stored paths of files that nobody wrote by hand, as the forest's score alone decides.

    Notices in paths are labels to learn from and nothing else: a file without one is found if its other traits
    are those of files that have one, and a file with one is left if they are not. Scores are held out
    (`file_features`), and so is `threshold`, where none is given (`best_threshold`). Null and blank paths are left
    out, repeated rows only weigh more in the averages, each stored form of a path gives one row. An empty table, or
    one with only one label in a fold, has no forest to score by and gives no rows (of that fold).
    """
    stored, scored = score_files(changes, rows)
    at = best_threshold(scored) if threshold is None else threshold
    return stored.select("path", "file").join(scored.where(F.col("score") >= at).select("file", "score"), "file").drop("file")
