"""Points for charts of a history, commit by commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.operators.features import latest_commits
from lodestrata.operators.order import numbered
from lodestrata.operators.rankstats import value_ranks

METRICS = ["impact_mutation", "impact_composite", "impact_godclass", "files_changed", "mut_fns", "new_fns", "renames"]
#: Points of a chart.
MOST_POINTS = 20_000
#: How many times the upper median the largest value must exceed for a logarithmic scale.
LOG_FROM = 50


def commit_series(commits: DataFrame) -> DataFrame:
    """(idx, sha, bug, metric, value): each commit's place in history, whether it is a fix or revert, and its metrics."""
    placed = numbered(latest_commits(commits), "seq", ["sha"], "idx")
    bug = F.coalesce(F.col("is_fix"), F.lit(False)) | F.coalesce(F.col("is_revert"), F.lit(False))
    wide = placed.select("idx", "sha", bug.alias("bug"), *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in METRICS])
    return wide.unpivot(["idx", "sha", "bug"], METRICS, "metric", "value")


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): the element at n // 2 of the sorted values, found over counts of distinct values."""
    long = df.select(*by, F.lit("v").alias("measure"), F.col(value).cast("double").alias("value")).where("value is not null")
    ranks = value_ranks(long, by)
    smaller = (F.col("rank2") - F.col("n") - 1) / 2
    total = long.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    here = ranks.join(total, by) if by else ranks.withColumn("total", total.scalar())
    return here.where((smaller <= F.floor(F.col("total") / 2)) & (smaller + F.col("n") > F.floor(F.col("total") / 2))).select(*by, F.col("value").alias("median"))


def axis_scale(series: DataFrame) -> DataFrame:
    """(metric, scale): 'log' if the largest value exceeds LOG_FROM times the upper median of the positive ones, else 'linear'."""
    positive = series.where("value > 0")
    most = series.groupBy("metric").agg(F.max("value").alias("most"))
    joined = most.join(upper_median(positive, "value", ["metric"]), "metric", "left")
    wide = F.col("most") / F.greatest(F.col("median"), F.lit(1.0)) > LOG_FROM
    return joined.select("metric", F.when(F.coalesce(wide, F.lit(False)), "log").otherwise("linear").alias("scale"))


def _stride(blues: Column, reds: Column, cap: int) -> Column:
    budget = F.lit(cap) - reds
    return F.when((budget <= 0) | (blues <= budget), F.lit(1)).otherwise(F.ceil(blues / F.greatest(budget, F.lit(1))))


def downsample(points: DataFrame, cap: int = MOST_POINTS) -> DataFrame:
    """Points of a chart thinned to about `cap`: all bugs, and every stride-th of the others in order.

    `points` has idx and bug. Nothing is thinned if it fits, or if the bugs alone reach the cap.
    """
    blues = numbered(points.where("not bug"), "idx", [], "_blue")
    counts = points.agg(F.count_if(~F.col("bug")).alias("blues"), F.count_if("bug").alias("reds"))
    step = counts.select(_stride(F.col("blues"), F.col("reds"), cap).alias("s")).scalar()
    return points.where("bug").unionByName(blues.withColumn("_s", step).where("_blue % _s = 0").drop("_blue", "_s"))


def chart_cells(series: DataFrame, columns: int = 240, rows: int = 48) -> DataFrame:
    """(metric, scale, most, total, bug, column, row, n): how many points of each metric fall in each cell of its chart.

    A chart has as many cells whatever the length of history, so what is drawn is bounded and no point is left out:
    columns are equal stretches of history, rows equal stretches of the value, or of its logarithm, up to the largest.
    """
    total = series.agg((F.max("idx") + 1).alias("t")).scalar()
    scales = axis_scale(series).join(series.groupBy("metric").agg(F.max("value").alias("most")), "metric")
    level = F.when(F.col("scale") == "log", F.log1p(F.col("value").cast("double")) / F.log1p(F.col("most").cast("double"))).otherwise(F.col("value") / F.col("most"))
    cell = lambda share, cells: F.greatest(F.lit(0), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1))).cast("int")
    placed = series.join(F.broadcast(scales), "metric").withColumn("total", total).select(
        "metric", "scale", "most", "total", "bug", cell(F.col("idx") / F.col("total"), columns).alias("column"), cell(F.when(F.col("most") > 0, level), rows).alias("row")
    )
    return placed.groupBy("metric", "scale", "most", "total", "bug", "column", "row").agg(F.count(F.lit(1)).alias("n"))
