"""Many histories in one pass: statistics by repository and over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.operators import features, predictors
from lodestrata.operators.charts import upper_median
from lodestrata.operators.rankstats import group_precisions, value_ranks
from lodestrata.session import cut


def repository(path: str = "path") -> Column:
    """The first directory of a path stands for its repository; '' for a file at the root."""
    clean = F.regexp_replace(F.btrim(F.translate(path, "\\", "/"), F.lit(" \t\r\n")), r"^(\./+)+", "")
    return F.when(F.instr(clean, "/") > 0, F.split_part(clean, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def cross_repo_summary(matrix: DataFrame) -> DataFrame:
    """(metric, predictor, control, n_repos, n_positive, median, least, most) of a matrix by repo.

    Undefined values are left out; the median is the upper one.
    """
    keys = ["metric", "predictor", "control"]
    known = cut(matrix.where("value is not null and metric in ('spearman', 'partial', 'auc')").withColumn("value", F.round("value", 6)))
    stats = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_repos"), F.count_if(F.col("value") > 0).alias("n_positive"), F.min("value").alias("least"), F.max("value").alias("most"))
    return stats.join(upper_median(known, "value", keys), keys)


def repo_ranking(matrix: DataFrame) -> DataFrame:
    """(repo, n_files, prevalence, partial_mut): repositories by the partial correlation of impact given churn, undefined ones last."""
    value = lambda m, p, c: F.max(F.when((F.col("metric") == m) & (F.col("predictor") == p) & (F.col("control") == c), F.col("value")))
    wide = matrix.groupBy("repo").agg(value("n_files", "", "").cast("bigint").alias("n_files"), value("prevalence", "", "").alias("prevalence"), value("partial", "impact", "churn").alias("partial_mut"))
    return wide.orderBy(F.desc_nulls_last("partial_mut"), "repo")


def split_timestamps(commits: DataFrame, by: list[str], fraction: float = 0.75) -> DataFrame:
    """(by, split_ts) of groups with at least 20 positive times; the rule is that of one history's split."""
    long = commits.where("ts > 0").select(*by, F.lit("ts").alias("measure"), F.col("ts").cast("double").alias("value"))
    total = long.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).where("total >= 20")
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * fraction))
    smaller = (F.col("rank2") - F.col("n") - 1) / 2
    found = value_ranks(long, by).join(total, by).where((smaller <= place) & (smaller + F.col("n") > place))
    return found.select(*by, F.col("value").cast("bigint").alias("split_ts"))


def many_columns(history: dict[str, DataFrame], fraction: float = 0.75) -> DataFrame:
    """Predictors and outcome of the files of every repository, each split at its own time, with its repo.

    A file belongs to the repository of its listed path, a commit to those of its files. Repositories with fewer
    than 20 commits have no split: all their changes count for predictors and all fixes as outcome.
    """
    ids = history["file_ids"].select(F.col("id").alias("file_id"), repository("canonical_path").alias("repo"))
    changes = history["file_changes"].where("file_id is not null").join(ids, "file_id")
    times = split_timestamps(changes.where("sha is not null").select("repo", "sha", "ts").distinct(), ["repo"], fraction)
    split = ids.join(times, "repo", "left").select("file_id", "split_ts")
    rows = changes.drop("repo").join(split, "file_id")
    unit_rows = history["unit_changes"].where("file_id is not null").join(split, "file_id")
    feats = features.file_features(rows, history["commits"], history["unit_changes"], history["file_ids"], "split_ts")
    state = features.snapshot(rows, unit_rows, history["commits"], "split_ts")
    universe = features.universe(feats).join(ids, "file_id").join(split, "file_id")
    whole = F.col("split_ts").isNull()
    universe = universe.withColumn("fix_after", F.when(whole, F.col("fix_all")).otherwise(F.col("fix_after")))
    return predictors.predictor_columns(universe, state)


def many_histories(history: dict[str, DataFrame], fraction: float = 0.75) -> DataFrame:
    """The predictor matrix of every repository at once; see `many_columns`."""
    return predictors.predictor_matrix(many_columns(history, fraction), ["repo"])


def precision_by_repository(columns: DataFrame) -> DataFrame:
    """(repo, k, by_impact, by_churn, lift): precision of the files of the largest impact and churn, and the former over the share of files with fixes."""
    columns = cut(columns.select("repo", "file_id", "impact", "churn", "label"))
    value = lambda score: F.max(F.when(F.col("score") == score, F.col("value")))
    both = group_precisions(columns, ["impact", "churn"], "label", "file_id", ["repo"]).groupBy("repo", "k").agg(value("impact").alias("by_impact"), value("churn").alias("by_churn"))
    base = columns.groupBy("repo").agg(F.avg(F.col("label").cast("double")).alias("base"))
    return both.join(base, "repo").select("repo", "k", "by_impact", "by_churn", F.try_divide("by_impact", "base").alias("lift"))
