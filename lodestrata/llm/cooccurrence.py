"""Items that appear together: counts of pairs as a blocked Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Items of one basket that a unit of work holds per side; wider baskets are cut into item blocks of this size.
BLOCK_ITEMS = 2048
#: Products that are summed at once in a task.
CHUNK_PAIRS = 2_000_000


def basket_key(column: str) -> list[Column]:
    """128 bits that stand for a basket's name, however long it is."""
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(7), F.col(column)).alias("k2")]


def _products(item: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum the products of each entry p with the entries first[p] .. first[p] + count[p] - 1."""
    names, code = np.unique(item, return_inverse=True)
    ends = np.cumsum(count)
    at = 0
    while at < len(item):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_PAIRS, "right")))
        n = count[at:to]
        total = int(n.sum())
        if total:
            left = np.repeat(np.arange(at, to), n)
            right = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
            low, high = np.minimum(code[left], code[right]), np.maximum(code[left], code[right])
            pair, times = np.unique(low.astype("int64") * len(names) + high, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(times.astype("int64"))],
                names=["item_a", "item_b", "n"],
            )
        at = to


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of a partition, whose units of work come one after the other and are never wide."""
    rest: pa.Table | None = None

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: table.column(c).to_numpy()
        item, side = get("item"), get("side")
        new = np.ones(len(item), bool)
        new[1:] = False
        for c in ("k1", "k2", "block_a", "block_b"):
            v = get(c)
            new[1:] |= v[1:] != v[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(item)))
        unit = np.repeat(np.arange(len(start)), size)
        end = (start + size)[unit]
        here = np.arange(len(item))
        diagonal = get("block_a") == get("block_b")
        lefts = np.add.reduceat((side == 0).astype("int64"), start)[unit]
        middle = start[unit] + lefts
        first = np.where(diagonal, here + 1, middle)
        count = np.where(diagonal, end - here - 1, np.where(side == 0, end - middle, 0))
        yield from _products(item, first, count)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        last = np.ones(table.num_rows, bool)
        for c in ("k1", "k2", "block_a", "block_b"):
            v = table.column(c).to_numpy()
            last &= v == v[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
        if cut:
            yield from block(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from block(rest)


def incidence(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """The binary matrix as entries (k1, k2, item): each item once per basket; null baskets and items left out."""
    return (
        rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
        .select(*basket_key(basket), F.col(item).cast("bigint").alias("item"))
        .distinct()
    )


def gram_matrix(entries: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Number of baskets with both items for every pair that occurs: (item_a < item_b, n).

    The record blocks are the sorted Arrow batches of whole baskets; each gives one partial product, summed by
    pair in the task and then over all blocks. A basket of more than `block_items` items is cut into item blocks
    and each pair of blocks is a unit of its own, so that neither a wide basket nor a frequent item puts more
    than 2 * block_items entries of a basket into one place.
    """
    wide = entries.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > block_items)
    parts = F.coalesce(F.ceil(F.col("width") / block_items), F.lit(1)).cast("int")
    placed = (
        entries.join(wide, ["k1", "k2"], "left")
        .withColumn("parts", parts)
        .withColumn("own", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("item"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "k1", "k2", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
            F.when(F.col("own") <= F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "item",
        )
    )
    unit = ["k1", "k2", "block_a", "block_b"]
    return (
        placed.repartition(*unit)
        .sortWithinPartitions(*unit, "side", "item")
        .mapInArrow(_gram, "item_a bigint, item_b bigint, n bigint")
        .groupBy("item_a", "item_b")
        .agg(F.sum("n").alias("n"))
    )


def cooccurrence(
    rows: DataFrame,
    basket: str,
    item: str,
    min_count: int = 5,
    min_share: float = 0.5,
    min_lift: float = 3.0,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Pairs of items that share baskets more often than chance would give.

    Returns item_a < item_b, n_ab, n_a, n_b, n_baskets and lift = n_ab * N / (n_a * n_b) for the pairs with
    n_ab >= min_count, n_ab >= min_share * min(n_a, n_b) and lift >= min_lift. N counts all distinct baskets,
    those without any item included; null baskets and null items count nowhere, repeated rows once. Items are
    whole numbers. An item in fewer than min_count baskets, or in more than N / min_lift, is in no such pair
    (n_ab is at most the smaller count), so it is left out beforehand: this loses nothing. An empty table gives
    no pairs.
    """
    entries = incidence(rows, basket, item)
    total = rows.agg(F.count_distinct(basket).alias("n_baskets")).scalar()
    counts = (
        entries.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
        .where(F.col("n_item") >= min_count)
        .withColumn("n_baskets", total)
        .where(F.col("n_item") * min_lift <= F.col("n_baskets"))
    )
    kept = entries.join(counts.select("item"), "item", "left_semi")
    pairs = gram_matrix(kept, block_items).where(F.col("n") >= min_count)
    a = counts.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n_baskets")
    b = counts.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    return (
        pairs.join(a, "item_a").join(b, "item_b")
        .where((F.col("n") >= F.least("n_a", "n_b") * min_share) & (F.col("n") * F.col("n_baskets") >= F.col("n_a") * F.col("n_b") * min_lift))
        .select(
            "item_a", "item_b", F.col("n").alias("n_ab"), "n_a", "n_b", "n_baskets",
            (F.col("n").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
        )
    )
