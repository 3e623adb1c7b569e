"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SALT = "_salt"
KEY = "_key"


@dataclass(frozen=True)
class Measure:
    """A result that can be put together from parts: how to compute a part, and how to merge the parts."""

    part: Column
    merge: str = "sum"


#: The least share of the rows that a key can be found by, as a summary keeps at most 1 / share keys.
LEAST_SHARE = 1e-4


def heavy_candidates(rows: DataFrame, key: str, share: float) -> list:
    """Every key that may hold at least `share` of the rows, and perhaps some that do not.

    One pass with a frequent-items summary. It keeps at most 1/share keys, whatever the size of the data, and is
    proven to contain each key above the share; null is left out. This bounds what reaches the driver. A share
    below LEAST_SHARE is refused, as the summary cannot keep so many keys.
    """
    if not LEAST_SHARE <= share < 1:
        raise ValueError(f"share must lie between {LEAST_SHARE} and 1")
    found = rows.select(F.col(key).alias(KEY)).where(F.col(KEY).isNotNull()).freqItems([KEY], share).first()
    return [k for k in (found[0] or []) if k is not None] if found else []


def salted_aggregate(
    rows: DataFrame,
    key: str,
    measures: Mapping[str, Measure],
    spread: Sequence[str],
    heavy_share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Results per key in two stages, so that no task gets all rows of a heavy key.

    Keys that may hold `heavy_share` of the rows get a salt of `salts` values; partial results are computed per
    key and salt and then merged by key. The salt is drawn from a hash of the `spread` columns instead of a
    random generator: it scatters rows as well, but a task that is run again after a lost executor draws the
    same salts, so its output still fits that of its neighbours. Rows alike in all `spread` columns share a
    salt, which makes counts of distinct `spread` values additive over the salts.

    Null keys form a group of their own (salted too, as they may be many). An empty table gives no rows. Columns
    of `rows` other than key, spread and those in measures are ignored, whatever their names. Returns `key`,
    the measures, and `n_salts`, the number of partial groups that a key was merged from.
    """
    heavy = heavy_candidates(rows, key, heavy_share)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    is_heavy = F.col(key).isNull()
    if heavy:
        is_heavy = is_heavy | F.col(key).isin(heavy)
    salted = rows.withColumn(SALT, F.when(is_heavy, salt).otherwise(F.lit(0)))
    parts = salted.groupBy(key, SALT).agg(*[m.part.alias(name) for name, m in measures.items()])
    merges = {"sum": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(key).agg(
        *[merges[m.merge](name).alias(name) for name, m in measures.items()], F.count(F.lit(1)).alias("n_salts")
    )


FILE_TABLES = {
    "file_changes": {
        "spread": ["sha"],
        "measures": lambda: {
            "n_rows": Measure(F.count(F.lit(1))),
            "n_commits": Measure(F.count_distinct("sha")),
            "amount": Measure(F.sum(F.coalesce("add_lines", F.lit(0)).cast("bigint") + F.coalesce("del_lines", F.lit(0)))),
            "largest": Measure(F.max(F.coalesce("add_lines", F.lit(0)).cast("bigint") + F.coalesce("del_lines", F.lit(0))), "max"),
        },
    },
    "unit_changes": {
        "spread": ["sha"],
        "measures": lambda: {
            "n_rows": Measure(F.count(F.lit(1))),
            "n_commits": Measure(F.count_distinct("sha")),
            "amount": Measure(F.sum(F.coalesce("cost", F.lit(0)))),
            "largest": Measure(F.max(F.coalesce("cost", F.lit(0))), "max"),
        },
    },
}


def file_totals(rows: DataFrame, table_name: str, heavy_share: float = 0.01, salts: int = 32) -> DataFrame:
    """Totals of every file of `file_changes` (lines changed) or `unit_changes` (cost), by `salted_aggregate`.

    Columns: table_name, file_id, n_rows, n_commits (distinct shas), amount, largest, n_salts. Null measures count
    as 0 and repeated rows count each time; null file ids form one group.
    """
    spec = FILE_TABLES[table_name]
    out = salted_aggregate(rows, "file_id", spec["measures"](), spec["spread"], heavy_share, salts)
    return out.select(F.lit(table_name).alias("table_name"), *out.columns)


def heavy_keys(rows: DataFrame, key: str, spread: Sequence[str], percent: int = 4, salts: int = 32) -> DataFrame:
    """Keys, not null, holding at least `percent` % of all rows, with n_rows and total_rows.

    Counts come from `salted_aggregate`; rows with a null key and repeated rows count in the total. An empty table
    has no heavy key.
    """
    share = percent / 100
    counts = salted_aggregate(rows, key, {"n_rows": Measure(F.count(F.lit(1)))}, spread, share / 2, salts)
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return (
        counts.withColumn("total_rows", total.scalar())
        .where(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= F.col("total_rows") * percent))
        .select(key, "n_rows", "total_rows")
    )
