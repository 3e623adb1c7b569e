"""Commits that induce later fixes: links, ranking statistics and quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.operators import features, rankstats as rs
from lodestrata.operators.order import last_before, parted
from lodestrata.session import cut

CONTROLS = ["churn", "files", "cc", "n_units", "entropy"]


def last_writer_links(changes: DataFrame, max_files: int = 60) -> DataFrame:
    """(fix_sha, inducing_sha, file_id): for each fix and file, the commits that last wrote the file before it.

    A table of changes has no lines to trace, so the last writer of a file stands for that of its lines: all its
    commits at the greatest earlier seq. Fixes of more than `max_files` files, and files a fix removes nothing
    from, have no links. The earlier seq is found range by range (`last_before`); there is no join of a file with itself.
    """
    known = changes.where("sha is not null and file_id is not null and seq is not null")
    by_seq = known.groupBy("file_id", "seq").agg(F.max(F.struct(F.coalesce("is_fix", F.lit(False)).alias("fix"))).alias("any"))
    previous = last_before(by_seq, "file_id", "seq", [], "seq", "before").where("any.fix and before is not null").drop("any")
    sizes = known.where("is_fix").groupBy("sha").agg(F.count_distinct("file_id").alias("k")).where(F.col("k") <= max_files).select("sha")
    fixes = known.where("is_fix and del_lines > 0").select("sha", "file_id", "seq").distinct().join(sizes, "sha", "left_semi")
    writers = known.select("file_id", F.col("seq").alias("before"), F.col("sha").alias("inducing_sha")).distinct()
    return (
        fixes.join(previous, ["file_id", "seq"]).join(writers, ["file_id", "before"])
        .where("sha <> inducing_sha").select(F.col("sha").alias("fix_sha"), "inducing_sha", "file_id").distinct()
    )


def commit_features(commits: DataFrame, changes: DataFrame, units: DataFrame, links: DataFrame) -> DataFrame:
    """Non-merge commits with their size, spread, complexity and whether a link names them as inducing (label)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    induced = links.where("inducing_sha is not null").select(F.col("inducing_sha").alias("sha")).distinct().withColumn("label", F.lit(1))
    return (
        features.latest_commits(commits).where(~F.coalesce("is_merge", F.lit(False)))
        .join(features.commit_churn(changes), "sha", "left").join(features.commit_complexity(units), "sha", "left")
        .join(features.commit_entropy(changes).select("sha", "entropy"), "sha", "left").join(induced, "sha", "left")
        .select(
            "sha", F.coalesce("seq", F.lit(0)).alias("seq"), zero("impact_mutation").alias("mutation"), zero("impact_composite").alias("composite"), zero("churn").alias("churn"),
            zero("files_changed").cast("bigint").alias("files"), zero("cc").alias("cc"), zero("n_units").alias("n_units"), F.round(F.coalesce("entropy", F.lit(0.0)), 9).alias("entropy"), zero("label").alias("label"),
        )
    )


def szz_counts(commits: DataFrame, links: DataFrame) -> DataFrame:
    """(n_inducing, n_matched, n_linked_fixes): distinct inducing shas, those among the commits, distinct fixes."""
    shas = features.latest_commits(commits).select("sha")
    inducing = links.where("inducing_sha is not null").select(F.col("inducing_sha").alias("sha")).distinct()
    return links.agg(F.count_distinct("inducing_sha").alias("n_inducing"), F.count_distinct("fix_sha").alias("n_linked_fixes")).withColumn(
        "n_matched", inducing.join(shas, "sha", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    )


def szz_statistics(feats: DataFrame) -> DataFrame:
    """(metric, predictor, control, value): AUCs, partials given churn, and partials given many controls."""
    feats = cut(feats)
    columns = ["mutation", "composite", "label", *CONTROLS]
    ranks = rs.rank_columns(feats.withColumn("positive", F.col("label")), "sha", columns, keep=["positive"])
    at = {c: i for i, c in enumerate(columns)}
    more = [F.sum("positive").alias("p"), *[F.sum(F.col(c) * F.col("positive")).alias(f"of_{c}") for c in ("mutation", "composite", "churn")]]
    r = rs.correlations(ranks, columns, more=more)
    cell = lambda x, y: F.col(f"r_{min(at[x], at[y])}_{max(at[x], at[y])}")

    def many(controls: list[str]) -> Column:
        names = ["composite", "label", *controls]
        cells = [cell(names[i], names[j]) for i in range(len(names)) for j in range(i, len(names))]
        return rs.partial_multi(cells, len(names), F.col("n"))

    def given_churn(x: str) -> Column:
        return rs.partial_of(cell(x, "label"), cell(x, "churn"), cell("label", "churn"))

    entry = lambda m, p, c, v: F.struct(F.lit(m).alias("metric"), F.lit(p).alias("predictor"), F.lit(c).alias("control"), v.alias("value"))
    return r.select(F.explode(F.array(
        *[entry("auc", c, "", rs.auc_of(F.col(f"of_{c}"), F.col("p"), F.col("n"))) for c in ("mutation", "composite", "churn")],
        entry("partial", "mutation", "churn", given_churn("mutation")), entry("partial", "composite", "churn", given_churn("composite")),
        entry("partial", "composite", "multi_core", many(CONTROLS[:4])), entry("partial", "composite", "multi_all", many(CONTROLS)),
    )).alias("e")).select("e.*")


def induce_rate_by_quarter(feats: DataFrame) -> DataFrame:
    """(quarter 1..4, n, rate): share of inducing commits by quarter of mutation, in stable ascending order.

    A commit's place is the number of smaller mutations, plus its own place by (seq, sha) among equal ones.
    """
    feats = cut(feats)
    long = feats.select(F.lit("mutation").alias("measure"), F.col("mutation").cast("double").alias("value"), "seq", "sha", "label")
    ranks = rs.value_ranks(long).select("measure", "value", ((F.col("rank2") - F.col("n") - 1) / 2).cast("bigint").alias("smaller"))
    # equal values are numbered in two steps, as one value (such as 0) may hold many of the commits
    placed = parted(long, "seq").withColumnRenamed("_part", "part")
    before = Window.partitionBy("value").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("value", "part").agg(F.count(F.lit(1)).alias("t")).select("value", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("value", "part").orderBy("seq", "sha")) - 1
    placed = placed.withColumn("own", own).join(offsets, ["value", "part"]).join(ranks, ["measure", "value"])
    total = feats.agg(F.count(F.lit(1)).alias("n")).scalar()
    quarter = rs.slice_of_four(F.col("smaller") + F.col("offset") + F.col("own"), total)
    return placed.withColumn("quarter", quarter + 1).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("rate"))
