"""Rank statistics over any DataFrame, for all groups of `by` at once.

Undefined results are null. Ranks are doubled, so that those of ties are whole numbers too and all sums are exact:
no result depends on the order of rows or partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.operators.order import cuts_at, range_of, ranges_of
from lodestrata.session import cut

#: A matrix of controls below this determinant is taken for collinear.
SINGULAR = 1e-12


def value_ranks(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, measure, value, n, rank2): doubled average ranks, ascending from 1, of the values of each measure.

    `long` has by, measure and value; null values have no rank. Equal values are counted first. The distinct ones
    are cut at approximate quantiles; a rank is the number of values in the parts before, plus the number before
    it in its own part. Where the cuts lie changes nothing but the balance.
    """
    keys = [*by, "measure"]
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges_of(long.sparkSession)
    hint = (lambda df: df) if by else F.broadcast  # without groups there is a row for each measure, and range of it
    cuts = counts.groupBy(*keys).agg(cuts_at("value", ranges).alias("cuts"))
    parted = counts.join(hint(cuts), keys).withColumn("part", range_of(F.col("value"), F.col("cuts"), ranges)).drop("cuts")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*keys, "part").agg(F.sum("n").alias("t")).select(*keys, "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rank2 = 2 * (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("offset")) + F.col("n") + 1
    return parted.join(hint(offsets), [*keys, "part"]).select(*keys, "value", "n", rank2.cast("bigint").alias("rank2"))


def rank_columns(df: DataFrame, key: str, measures: Sequence[str], by: Sequence[str] = (), only: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(by, key, keep, a column per measure): doubled average ranks instead of the values. `key` names each row of a group.

    `only` is an array of the names of those measures that are asked for in a row; others have no rank there. The
    columns `keep` are handed through.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    asked = values if only is None else F.filter(values, lambda v: F.array_contains(only, v["measure"]))
    long = df.select(*by, key, *keep, F.explode(asked).alias("v")).select(*by, key, *keep, "v.measure", "v.value")
    ranked = long.join(value_ranks(long, by), [*by, "measure", "value"])
    return ranked.groupBy(*by, key).agg(*[F.max(c).alias(c) for c in keep], *[F.max(F.when(F.col("measure") == m, F.col("rank2"))).alias(m) for m in measures])


#: Products are summed in two halves of so many bits, in whole numbers of 64 bits.
_HALF = 1 << 32


def correlations(ranks: DataFrame, measures: Sequence[str], by: Sequence[str] = (), pairs: Sequence[tuple[int, int]] | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """(by, n, r_<i>_<j> for each pair i <= j of measures, more): Pearson correlations of columns of doubled ranks.

    Null for fewer than two rows or a column without variance. Rows must have the measures of a pair, or all of a
    group none. `pairs` restricts the pairs to compute, `more` are further aggregates. All sums are exact: a product is
    below 2 ** 63 for up to 1.5 billion rows in a group (beyond, the multiplication fails rather than wraps).
    """
    pairs = list(pairs or [(i, j) for i in range(len(measures)) for j in range(i, len(measures))])
    pairs = sorted({*pairs, *[(i, i) for pair in pairs for i in pair]})
    used = sorted({i for pair in pairs for i in pair})
    # as SQL text, in few expressions: a column object for each step of each pair takes longer to build than to compute
    product = lambda i, j: f"(CAST(`{measures[i]}` AS BIGINT) * CAST(`{measures[j]}` AS BIGINT))"
    halves = [x for i, j in pairs for x in (f"sum(shiftright({product(i, j)}, 32)) AS h_{i}_{j}", f"sum({product(i, j)} & {_HALF - 1}L) AS l_{i}_{j}")]
    totals = [f"sum(CAST(`{measures[i]}` AS BIGINT)) AS t_{i}" for i in used]
    sums = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.expr(x) for x in totals + halves], *more)
    kept = sums.columns[len(by) + 1 + len(totals) + len(halves) :]
    whole = lambda i, j: f"CAST(CAST(h_{i}_{j} AS DECIMAL(20, 0)) * {_HALF}BD + CAST(l_{i}_{j} AS DECIMAL(38, 0)) AS DECIMAL(38, 0))"
    spread = lambda i, j: f"CAST(CAST(n AS DECIMAL(20, 0)) * {whole(i, j)} - CAST(t_{i} AS DECIMAL(38, 0)) * CAST(t_{j} AS DECIMAL(38, 0)) AS DOUBLE) AS c_{i}_{j}"
    names = [f"`{c}`" for c in (*by, "n", *kept)]
    moments = sums.selectExpr(*names, *[spread(i, j) for i, j in pairs])
    r = lambda i, j: f"CASE WHEN sqrt(c_{i}_{i} * c_{j}_{j}) > 0 THEN greatest(-1D, least(1D, c_{i}_{j} / sqrt(c_{i}_{i} * c_{j}_{j}))) END AS r_{i}_{j}"
    return moments.selectExpr(*names, *[r(i, j) for i, j in pairs])


def partial_of(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """First-order partial correlation; null where a correlation with the control is perfect."""
    rest = F.greatest(F.lit(0.0), (1 - rxz * rxz) * (1 - ryz * ryz))
    return F.when(rest > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (rxy - rxz * ryz) / F.sqrt(rest))))


def _residual_correlation(matrix: np.ndarray) -> float | None:
    """Correlation of the first two variables after the linear effect of all others is taken out of both."""
    if np.isnan(matrix).any():
        return None
    controls = matrix[2:, 2:]
    if abs(np.linalg.det(controls)) < SINGULAR:
        return None
    rest = matrix[:2, :2] - matrix[:2, 2:] @ np.linalg.solve(controls, matrix[2:, :2])
    scale = rest[0, 0] * rest[1, 1]
    return float(np.clip(rest[0, 1] / np.sqrt(scale), -1, 1)) if rest[0, 0] > SINGULAR and rest[1, 1] > SINGULAR else None


def partial_multi(matrix: Sequence[Column], size: int, n: Column) -> Column:
    """Partial correlation of variables 0 and 1 given all others, from the upper triangle of their correlations.

    Null for fewer than controls + 3 rows, collinear controls, or an undefined correlation. The matrix has a
    fixed small size and is solved in the task that holds its group's row.
    """

    @F.pandas_udf("double")
    def solve(cells: pd.Series) -> pd.Series:
        where = [(i, j) for i in range(size) for j in range(i, size)]

        def one(row) -> float | None:
            m = np.full((size, size), np.nan)
            for (i, j), v in zip(where, row, strict=True):
                m[i, j] = m[j, i] = np.nan if v is None else v
            return _residual_correlation(m)

        return pd.Series([one(row) for row in cells], dtype="float64")

    value = solve(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in matrix]))
    return F.when((n >= size + 1) & ~F.isnan(value), value)


def _r(i: int, j: int) -> Column:
    return F.col(f"r_{min(i, j)}_{max(i, j)}")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): Pearson correlation; null for fewer than two rows or without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    root = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return both.groupBy(*by).agg(F.when(root > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(a, b) / root))).alias("value"))


def _ranked_correlations(df: DataFrame, columns: Sequence[str], key: str, by: Sequence[str]) -> DataFrame:
    complete = cut(df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*by, key, *columns))
    return correlations(rank_columns(complete, key, columns, by), columns, by)


def spearman(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): Spearman correlation over the rows where both are known."""
    return _ranked_correlations(df, [x, y], key, by).select(*by, F.col("r_0_1").alias("value"))


def partial_spearman(df: DataFrame, x: str, y: str, control: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): Spearman correlation of x and y given one control."""
    r = _ranked_correlations(df, [x, y, control], key, by)
    return r.select(*by, partial_of(_r(0, 1), _r(0, 2), _r(1, 2)).alias("value"))


def partial_spearman_multi(df: DataFrame, x: str, y: str, controls: Sequence[str], key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): Spearman correlation of x and y given all controls at once."""
    columns = [x, y, *controls]
    r = _ranked_correlations(df, columns, key, by)
    cells = [_r(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return r.select(*by, partial_multi(cells, len(columns), F.col("n")).alias("value"))


def auc_of(rank2_of_positives: Column, positives: Column, n: Column) -> Column:
    """Mann-Whitney AUC from the sum of the doubled ranks of positives; null without positives or negatives."""
    p, q = positives.cast("double"), (n - positives).cast("double")
    return F.when((p > 0) & (q > 0), (rank2_of_positives.cast("double") / 2 - p * (p + 1) / 2) / (p * q))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value): the chance that a random positive scores above a random negative, ties counting half."""
    known = cut(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, score, label))
    rows = known.select(*by, F.lit("score").alias("measure"), F.col(score).cast("double").alias("value"), F.col(label).cast("int").alias("label"))
    counted = rows.groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("p"))
    ranks = value_ranks(rows, by)
    out = counted.join(ranks, [*by, "measure", "value"]).groupBy(*by).agg(F.sum(F.col("rank2") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    return out.select(*by, auc_of(F.col("s"), F.col("p"), F.col("m")).alias("value"))


def precision_at_k(df: DataFrame, score: str, label: str, order: str, k: int) -> DataFrame:
    """(value): share of positives among the k best; ties go to the smaller `order`. Null for k <= 0 or no rows."""
    best = df.orderBy(F.desc(score), F.asc(order)).limit(max(k, 0))
    return best.agg(F.avg(F.col(label).cast("double")).alias("value"))


def precisions(df: DataFrame, scores: Sequence[str], label: str, order: str, ks: Sequence[int]) -> DataFrame:
    """(k, score, value) for all of a few scores and ks: as `precision_at_k`, from one list of the best per score.

    Each list has at most the largest k of rows, which is all that is ordered in one task.
    """
    best = None
    for score in scores:
        top = df.orderBy(F.desc(score), F.asc(order)).limit(max(0, *ks)).select(F.lit(score).alias("score"), F.col(score).alias("by"), F.col(order).alias("tie"), F.col(label).cast("double").alias("label"))
        best = top if best is None else best.unionByName(top)
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("score").orderBy(F.desc("by"), "tie")))
    asked = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("place") <= k)
    return placed.select("score", "label", F.explode(asked).alias("k")).groupBy("k", "score").agg(F.avg("label").alias("value"))


def group_precisions(df: DataFrame, scores: Sequence[str], label: str, order: str, by: Sequence[str], ks: Sequence[int] = (10, 25, 50)) -> DataFrame:
    """(by, k, score, value): precision of each group's best rows at those of `ks` that the group fills, else at a tenth of its rows, but at least 1.

    Ties go to the smaller `order`; rows without a score come last. Only the first max(ks) places of a group are asked
    for, so each task sends no more than that of a group, however many rows one has.
    """
    long = df.select(*by, order, F.col(label).cast("double").alias("label"), F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("by")) for s in scores])).alias("s"))
    place = F.row_number().over(Window.partitionBy(*by, "s.score").orderBy(F.desc_nulls_last("s.by"), order))
    best = long.select(*by, "s.score", "label", place.alias("place")).where(F.col("place") <= max(ks))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    filled = F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k <= F.col("n"))
    chosen = F.when(F.size(filled) > 0, filled).otherwise(F.array(F.greatest(F.lit(1), F.floor(F.col("n") / 10)).cast("int")))
    asked = best.join(sizes.select(*by, chosen.alias("ks")), list(by)).select(*by, "score", "label", F.explode(F.filter("ks", lambda k: F.col("place") <= k)).alias("k"))
    return asked.groupBy(*by, "k", "score").agg(F.avg("label").alias("value"))


def slice_of_four(index: Column, n: Column) -> Column:
    """The quarter (0..3) of a 0-based place among n, where quarter q is places q*n//4 to (q+1)*n//4 - 1."""
    return F.floor((index * 4 + 3) / n).cast("int")
