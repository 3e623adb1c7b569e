"""Places and predecessors in an order, without ordering all rows, or all of a busy key, in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A range of this many successive places in history is ordered in one task.
WIDTH = 1 << 16


def ranges_of(spark: SparkSession) -> int:
    """In how many ranges an order is cut: as many as there are shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cuts_at(value: str, ranges: int) -> Column:
    """Aggregate: the ranges - 1 approximate quantiles of `value` that part it in ranges of about equal size."""
    return F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(500, 8 * ranges))


def range_of(value: Column, cuts: Column, ranges: int) -> Column:
    """How many of the ranges - 1 ascending cuts lie below a value: found in steps first, then within a step."""
    step = math.isqrt(ranges)
    far = F.size(F.filter(F.sequence(F.lit(step), F.lit(ranges - 1), F.lit(step)), lambda i: F.get(cuts, i - 1) < value))
    return far * step + F.size(F.filter(F.slice(cuts, far * step + 1, step), lambda c: c < value))


def parted(df: DataFrame, first: str) -> DataFrame:
    """Adds `_part`: the range of the whole number `first` that a row lies in, -1 for null.

    The ranges are cut at approximate quantiles, about as many as there are shuffle partitions.
    """
    ranges = ranges_of(df.sparkSession)
    cuts = df.agg(cuts_at(first, ranges).alias("cuts")).scalar()
    part = F.when(F.col(first).isNull(), -1).otherwise(F.coalesce(range_of(F.col(first), F.col("_cuts"), ranges), F.lit(-1)))
    return df.withColumn("_cuts", cuts).withColumn("_part", part).drop("_cuts")


def numbered(df: DataFrame, first: str, then: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds `name`: the 0-based place of each row by the whole number `first`, then by the columns `then`.

    The rows are numbered within their ranges, and the sizes of the ranges before are added. `first` and `then`
    together should be unique; null comes first.
    """
    rows = parted(df, first)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(first, *then)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def last_before(df: DataFrame, key: str, first: str, then: Sequence[str], value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds `name`: the last non-null `value` before each row of its key, by the whole number `first`, then by the columns `then`.

    A key that many rows have is ordered range by range of `first`: within a range by a window, and the last value
    of each range is handed to the next ones. So no task holds all rows of a key, but at most those of `width`
    successive places in history. `first` and `then` together should be unique in a key, and no key null.
    """
    part = F.coalesce(F.floor(F.col(first) / width), F.lit(-1))
    rows = df.withColumn("_part", F.when(F.col(first) < 0, -1).otherwise(part)).repartition(key, "_part")
    inside = Window.partitionBy(key, "_part").orderBy(first, *then).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(value).isNotNull()
    ends = rows.groupBy(key, "_part").agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(first, *then))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(key, "_part", F.last("_end", True).over(earlier).alias("_handed")).where("_handed is not null")
    here = rows.withColumn(name, F.last(value, True).over(inside))
    return here.join(handed, [key, "_part"], "left").withColumn(name, F.coalesce(name, "_handed")).select(*df.columns, name)
