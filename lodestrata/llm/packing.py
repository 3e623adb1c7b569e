"""Filling fixed-capacity packs with items of varying length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Length buckets per capacity.
BUCKETS = 256
#: Bits of a position inside a bucket, in the combined search key of `assign`.
_SHIFT = 40


def optimal_buckets(sizes: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets over a histogram, with the least padding possible.

    Every item is padded to its bucket's upper bound, so the bounds are sizes that occur. Dynamic programming
    over the prefixes of the histogram; as the cost satisfies the quadrangle inequality, the best last cut does
    not move back as the prefix grows, which lets a whole level of midpoints be solved at once. The histogram has
    at most as many sizes as the capacity, whatever the number of items.
    """
    size, number = np.asarray(sizes, "int64"), np.asarray(counts, "float64")
    m = len(size)
    if m == 0:
        return []
    items, weight = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * size)])

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return size[j - 1] * (items[j] - items[i]) - (weight[j] - weight[i])

    best = cost(np.zeros(m, "int64"), np.arange(1, m + 1))
    best = np.concatenate([[0.0], best])
    cuts = [np.zeros(m + 1, "int64")]
    for _ in range(1, min(buckets, m)):
        value, cut = np.full(m + 1, np.inf), np.zeros(m + 1, "int64")
        value[0] = 0.0
        spans = np.array([[1, m, 0, m - 1]])  # prefixes from, to; cuts from, to
        while len(spans):
            lo, hi, a, b = spans.T
            mid = (lo + hi) // 2
            top = np.minimum(b, mid - 1)
            width = top - a + 1
            starts = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(starts, width) + np.repeat(a, width)
            trial = best[i] + cost(i, np.repeat(mid, width))
            least = np.minimum.reduceat(trial, starts)
            hits = np.flatnonzero(trial == np.repeat(least, width))
            where = np.searchsorted(hits, starts)
            value[mid], cut[mid] = least, i[hits[where]]
            left = np.stack([lo, mid - 1, a, cut[mid]], 1)[lo < mid]
            right = np.stack([mid + 1, hi, cut[mid], b], 1)[mid < hi]
            spans = np.concatenate([left, right])
        cuts.append(cut)
        best = value
    bounds, j = [], m
    for cut in reversed(cuts):
        bounds.append(int(size[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    return bounds[::-1]


@dataclass(frozen=True)
class Plan:
    """How the items of each bucket fill packs: runs of equal packs, each taking `each` items of some buckets."""

    bounds: np.ndarray
    keys: np.ndarray  # bucket << _SHIFT | first position, ascending
    each: np.ndarray
    first_pack: np.ndarray
    packs: int


def plan_packs(capacity: int, bounds: Sequence[int], counts: Sequence[int]) -> Plan:
    """Token-budget batches for the items of each bucket, counted by bucket.

    A batch takes as many items of the longest bucket left as the budget allows, by their padded length, and the
    room that remains goes to batches of the next shorter buckets that fit. As equal batches come in long runs,
    the plan's size depends on the number of buckets and not on that of the items.
    """
    left, taken = [int(c) for c in counts], [0] * len(bounds)
    runs: list[tuple[int, int, int]] = []
    packs = 0
    for top in range(len(bounds) - 1, -1, -1):
        while left[top]:
            room, batch = capacity, []
            for k in range(top, -1, -1):
                n = min(left[k], room // bounds[k])
                if n:
                    batch.append((k, n))
                    room -= n * bounds[k]
            times = min(left[k] // n for k, n in batch)
            for k, n in batch:
                runs.append((k << _SHIFT | taken[k], n, packs))
                taken[k] += times * n
                left[k] -= times * n
            packs += times
    table = np.array(sorted(runs), dtype="int64").reshape(-1, 3)
    return Plan(np.asarray(bounds, "int64"), table[:, 0], table[:, 1], table[:, 2], packs)


def split_items(sizes: DataFrame, capacities: Sequence[tuple[str, int]], key: str) -> DataFrame:
    """(pack_name, capacity, key, n_full, rest, n_tokens): an item cut into full packs and what is left over."""
    options = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities])
    return (
        sizes.withColumn("_p", F.explode(options))
        .select("_p.pack_name", "_p.capacity", key, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
        .withColumn("n_full", F.expr("n_tokens div capacity"))
        .withColumn("rest", F.expr("n_tokens % capacity"))
    )


def histograms(items: DataFrame) -> dict[str, pd.DataFrame]:
    """Sizes and their numbers per pack name: at most `capacity` rows each, however many items there are."""
    rows = items.where("rest > 0").groupBy("pack_name", "rest").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return {name: part.sort_values("rest") for name, part in rows.groupby("pack_name")}


def bucket_counts(bounds: Sequence[int], histogram: pd.DataFrame) -> np.ndarray:
    place = np.searchsorted(np.asarray(bounds), histogram["rest"].to_numpy())
    return np.bincount(place, weights=histogram["n"].to_numpy(), minlength=len(bounds)).astype("int64")


def make_plans(items: DataFrame, capacities: Sequence[tuple[str, int]], buckets: int = BUCKETS) -> dict[str, Plan]:
    found = histograms(items)
    plans = {}
    for name, capacity in capacities:
        histogram = found.get(name, pd.DataFrame({"rest": [], "n": []}, dtype="int64"))
        bounds = optimal_buckets(histogram["rest"].tolist(), histogram["n"].tolist(), buckets)
        plans[name] = plan_packs(capacity, bounds, bucket_counts(bounds, histogram) if bounds else [])
    return plans


def _bucket(plans: dict[str, Plan]) -> Column:
    @F.pandas_udf("int")
    def bucket(name: pd.Series, rest: pd.Series) -> pd.Series:
        out = np.zeros(len(name), "int32")
        for n in name.unique():
            here = (name == n).to_numpy()
            out[here] = np.searchsorted(plans[n].bounds, rest.to_numpy()[here])
        return pd.Series(out)

    return bucket("pack_name", "rest")


def _pack(plans: dict[str, Plan]) -> Column:
    @F.pandas_udf("bigint")
    def pack(name: pd.Series, bucket: pd.Series, position: pd.Series) -> pd.Series:
        out = np.zeros(len(name), "int64")
        for n in name.unique():
            here, plan = (name == n).to_numpy(), plans[n]
            place = bucket.to_numpy()[here].astype("int64") << _SHIFT | position.to_numpy()[here].astype("int64")
            run = np.searchsorted(plan.keys, place, "right") - 1
            out[here] = plan.first_pack[run] + (place - plan.keys[run]) // plan.each[run]
        return pd.Series(out)

    return pack("pack_name", "bucket", "position")


def positions(items: DataFrame, group: Sequence[str], key: str, salts: int) -> DataFrame:
    """A dense 0-based `position` within each group, without any group being in one task.

    Items are numbered within (group, salt), and the sizes of the salts before theirs are added.
    """
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    parts = [*group, "salt"]
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
        .select(*parts, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(key)) - 1
    return salted.withColumn("inside", inside).join(offsets, parts).withColumn("position", F.col("inside") + F.col("offset")).drop("inside", "offset", "salt")


def pack_items(
    sizes: DataFrame,
    capacities: Sequence[tuple[str, int]],
    key: str = "doc_id",
    buckets: int = BUCKETS,
    salts: int | None = None,
) -> DataFrame:
    """Put items of `n_tokens` into packs of each (pack_name, capacity).

    Returns pack_name, capacity, pack_id, `key`, part, first_token, n_tokens. An item is one part of one pack, unless
    it alone exceeds the capacity: then it is cut into full packs (pack_id '<key>#<part>') and a rest, which is
    packed like an item. All other packs are numbered. Items of no tokens take no room; they are spread over the
    numbered packs ('0' if there is none). Null sizes count as 0, and keys should be unique: repeated ones are
    packed as items of their own. An empty table gives no packs.

    `sizes` is read several times, so it should be stored or checkpointed.
    """
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    items = split_items(sizes, capacities, key)
    plans = make_plans(items, capacities, buckets)
    salts = salts or int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = positions(items.where("rest > 0").withColumn("bucket", _bucket(plans)), ["pack_name", "bucket"], key, salts)
    shared = numbered.select(
        "pack_name", "capacity", _pack(plans).cast("string").alias("pack_id"), key, F.col("n_full").cast("bigint").alias("part"),
        (F.col("n_full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("n_tokens"),
    )
    full = items.where("n_full > 0").withColumn("part", F.explode(F.expr("sequence(0L, n_full - 1)"))).select(
        "pack_name", "capacity", F.concat(F.col(key).cast("string"), F.lit("#"), "part").alias("pack_id"), key, "part",
        (F.col("part") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"),
    )
    number = F.create_map(*[x for n, p in plans.items() for x in (F.lit(n), F.lit(max(1, p.packs)).cast("bigint"))])
    empty = items.where("n_tokens = 0").select(
        "pack_name", "capacity", F.pmod(F.xxhash64(key), number[F.col("pack_name")]).cast("string").alias("pack_id"), key,
        F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"),
    )
    return shared.unionByName(full).unionByName(empty)


def fill(packed: DataFrame) -> DataFrame:
    """Per pack name: n_packs, n_tokens, the share of all room that is filled, and the fullest pack."""
    packs = packed.groupBy("pack_name", "capacity", "pack_id").agg(F.sum("n_tokens").alias("used"))
    return packs.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_packs"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"),
    )


def bucket_batches(sizes: DataFrame, capacities: Sequence[tuple[str, int]], key: str = "doc_id", buckets: int = BUCKETS) -> Iterator[tuple]:
    """For comparison: (pack_name, packs, tokens) if each batch may hold items of one bucket only."""
    items = split_items(sizes, capacities, key)
    full = {r[0]: r[1] for r in items.groupBy("pack_name").agg(F.sum("n_full")).collect()}
    for (name, capacity), histogram in ((c, histograms(items).get(c[0])) for c in capacities):
        if histogram is None:
            continue
        bounds = optimal_buckets(histogram["rest"].tolist(), histogram["n"].tolist(), buckets)
        counts = bucket_counts(bounds, histogram)
        alone = sum(-(-int(n) // (capacity // b)) for b, n in zip(bounds, counts, strict=True))
        yield name, alone + full[name], int((histogram["rest"] * histogram["n"]).sum()) + full[name] * capacity
