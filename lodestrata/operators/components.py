"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the smallest node of its surroundings."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b); component is the smallest node reached.

    Alternates large-star and small-star, which keep connectivity and need a number of rounds logarithmic in the
    graph's size; each round is checkpointed, and the end is known from the edges' number and hash sum. Loops
    (a = b) make single nodes known; null ends are left out; repeated edges do not matter. No component is ever
    gathered in one task. An empty table gives no rows.
    """
    known = cut(edges.where("a is not null and b is not null").select("a", "b").distinct())
    nodes = known.select(F.col("a").alias("node")).unionByName(known.select(F.col("b").alias("node"))).distinct()
    state = known.where("a <> b")
    seen = None
    for n in range(rounds):
        state = cut(_small_star(_large_star(state)).where("a <> b"))
        if n < 2:  # hardly any graph is done before
            continue
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return nodes.join(state.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
