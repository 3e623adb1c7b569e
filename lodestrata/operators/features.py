"""Features of files and commits from the stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.operators.order import parted
from lodestrata.session import cut


def lines(add: str = "add_lines", gone: str = "del_lines") -> Column:
    """Lines added and removed; nulls are 0."""
    return F.coalesce(F.col(add), F.lit(0)).cast("bigint") + F.coalesce(F.col(gone), F.lit(0)).cast("bigint")


def latest_commits(commits: DataFrame) -> DataFrame:
    """One row per sha, the one that arrived last; of those at once, the one with the largest seq. Null shas left out."""
    arrived = [F.desc_nulls_last("ingested_at")] if "ingested_at" in commits.columns else []
    order = Window.partitionBy("sha").orderBy(*arrived, F.desc_nulls_last("seq"), F.xxhash64("author", "email", "subject"))
    return commits.where(F.col("sha").isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def before_split(split: int | str | None) -> Column:
    """Whether a row counts for predictors: at or before the split, or always without one. A null time does not.

    The split is a time, or the name of a column with each row's own, where null is none.
    """
    if isinstance(split, str):
        return F.col(split).isNull() | F.coalesce(F.col("ts") <= F.col(split), F.lit(False))
    return F.lit(True) if split is None else F.coalesce(F.col("ts") <= F.lit(split), F.lit(False))


def after_split(split: int | str | None) -> Column:
    """Whether a row lies after the split; never without one."""
    if split is None:
        return F.lit(False)
    return F.coalesce(F.col("ts") > (F.col(split) if isinstance(split, str) else F.lit(split)), F.lit(False))


def split_timestamp(commits: DataFrame, fraction: float = 0.75) -> DataFrame:
    """(split_ts): the positive time at place min(n - 1, floor(n * fraction)) of all commits; null for fewer than 20.

    Times are counted per value first, in one pass over the commits, so the order is found over distinct times and not
    over rows, and range by range (`order.parted`). Commits are taken as stored after `latest_commits`.
    """
    rows = parted(cut(commits.where("ts > 0").groupBy("ts").agg(F.count(F.lit(1)).alias("n"))), "ts").withColumnRenamed("_part", "part")
    offset = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n").alias("t")).select("part", offset.alias("offset"), F.sum("t").over(Window.partitionBy()).alias("total"))
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("ts"))
    placed = rows.join(F.broadcast(parts), "part").select("ts", (up_to + F.col("offset")).alias("up_to"), "total")
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * fraction))
    return placed.where((F.col("total") >= 20) & (F.col("up_to") > place)).agg(F.min("ts").alias("split_ts"))


def commit_churn(changes: DataFrame) -> DataFrame:
    """(sha, churn): lines changed by each commit."""
    return changes.where("sha is not null").groupBy("sha").agg(F.sum(lines()).alias("churn"))


def commit_complexity(units: DataFrame) -> DataFrame:
    """(sha, cc, n_units): complexity and number of the units that each commit changed."""
    return units.where("sha is not null").groupBy("sha").agg(F.sum(F.coalesce("cc", F.lit(0)).cast("bigint")).alias("cc"), F.count(F.lit(1)).alias("n_units"))


def _shares(changes: DataFrame) -> DataFrame:
    """(sha, file_id, part): lines of each file in each commit, where there are any."""
    parts = changes.where("sha is not null and file_id is not null").where(lines() > 0)
    return parts.groupBy("sha", "file_id").agg(F.sum(lines()).alias("part"))


def commit_entropy(changes: DataFrame) -> DataFrame:
    """(sha, entropy, n_files): bits of how a commit's lines spread over its files; 0 for a single file.

    From sums alone, without a second pass over a commit's files: H = log2(T) - sum(c * log2(c)) / T.
    """
    c = F.col("part").cast("double")
    sums = _shares(changes).groupBy("sha").agg(F.sum("part").cast("double").alias("t"), F.sum(c * F.log2(c)).alias("s"), F.count(F.lit(1)).alias("n_files"))
    h = F.when(F.col("n_files") > 1, F.log2("t") - F.col("s") / F.col("t")).otherwise(F.lit(0.0))
    return sums.select("sha", h.alias("entropy"), "n_files")


def change_entropy(changes: DataFrame, split_ts: int | str | None = None) -> DataFrame:
    """(file_id, entropy): the sum of the entropies of the commits before the split in which a file has lines."""
    before = changes.where(before_split(split_ts))
    spread = commit_entropy(before).where("n_files > 1").select("sha", "entropy")
    return _shares(before).select("sha", "file_id").join(spread, "sha").groupBy("file_id").agg(F.sum("entropy").alias("entropy"))


def max_complexity(units: DataFrame) -> DataFrame:
    """(file_id, max_cc): the largest complexity of any version of any unit, over all time."""
    return units.where("file_id is not null").groupBy("file_id").agg(F.coalesce(F.max("cc"), F.lit(0)).cast("bigint").alias("max_cc"))


def file_features(
    changes: DataFrame, commits: DataFrame, units: DataFrame, file_ids: DataFrame, split_ts: int | str | None = None, strict_split: bool = False
) -> DataFrame:
    """One row per file with its path and all predictors and outcomes.

    Predictors count changes before the split, fix_after those fixes after it; fix_all counts all. As rows are
    stored, repeated ones count again, but commits and authors (non-empty e-mail addresses) are distinct. is_test
    sticks once set, lang is the last non-empty one in history order, and max_cc looks at all time; with
    `strict_split` these three look only at what is before the split. Rows without a file id are left out; a file
    without a listed path has '?'.
    """
    before, after = before_split(split_ts), after_split(split_ts)
    seen = before if strict_split else F.lit(True)
    emails = latest_commits(commits).select("sha", F.nullif("email", F.lit("")).alias("email"))
    named = seen & F.col("lang").isNotNull() & (F.col("lang") != "")
    order = F.concat(F.lpad(F.coalesce("seq", F.lit(0)).cast("string"), 20, "0"), F.lit("|"), F.col("lang"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    early = lambda c: F.coalesce(F.sum(F.when(before, c)), F.lit(0)).cast("bigint")
    fix = F.coalesce(F.col("is_fix"), F.lit(False))
    # one row per file and commit first: a busy file then costs one row a commit, and its commits need no distinct
    pairs = changes.where("file_id is not null").groupBy("file_id", "sha").agg(
        F.max(F.when(named, F.struct(order.alias("order"), F.col("lang").alias("lang")))).alias("last"),
        F.max(F.when(seen, F.coalesce("is_test", F.lit(False)))).alias("is_test"), F.max(before).alias("before"),
        early(number("mutation_cost")).alias("mut"), early(number("godclass_cost")).alias("god"), early(lines()).alias("churn"),
        F.count_if(fix).alias("fix_all"), F.count_if(fix & after).alias("fix_after"),
    )
    sums = pairs.join(emails, "sha", "left").groupBy("file_id").agg(
        F.max("last")["lang"].alias("lang"), F.coalesce(F.max("is_test"), F.lit(False)).alias("is_test"), F.sum("mut").alias("impact_mut"),
        F.sum(F.col("mut") + F.col("god")).alias("impact_comp"), F.sum("churn").alias("churn"), F.count_if(F.col("before") & F.col("sha").isNotNull()).alias("n_commits"),
        F.count_distinct(F.when(F.col("before"), F.col("email"))).alias("n_authors"), F.sum("fix_all").alias("fix_all"), F.sum("fix_after").alias("fix_after"),
    )
    cc_rows = units
    if strict_split and split_ts is not None:
        cc_rows = units.join(latest_commits(commits).where(before).select("sha"), "sha", "left_semi")
    return (
        sums.join(change_entropy(changes, split_ts), "file_id", "left")
        .join(max_complexity(cc_rows), "file_id", "left")
        .join(file_ids.select(F.col("id").alias("file_id"), F.col("canonical_path").alias("path")), "file_id", "left")
        .select(
            "file_id", F.coalesce("path", F.lit("?")).alias("path"), F.coalesce("lang", F.lit("")).alias("lang"), "is_test", "impact_mut", "impact_comp", "churn",
            "n_commits", "n_authors", F.coalesce("max_cc", F.lit(0)).cast("bigint").alias("max_cc"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
            (F.coalesce("max_cc", F.lit(0)).cast("bigint") * F.col("n_commits")).alias("hotspot"), "fix_all", "fix_after",
        )
    )


def universe(features: DataFrame, exclude_tests: bool = True) -> DataFrame:
    """The source files: those with a language, without tests unless wanted."""
    known = features.where("lang <> ''")
    return known.where("not is_test") if exclude_tests else known


#: What a list of files shows of each.
LISTED = ["path", "lang", "impact_mut", "impact_comp", "churn", "n_commits", "n_authors", "max_cc", "hotspot", "fix_all", "fix_after", "is_test"]


def by_impact(universe: DataFrame) -> DataFrame:
    """Files by falling impact; ties in order of their ids."""
    return universe.orderBy(F.desc("impact_mut"), "file_id")


def snapshot(changes: DataFrame, units: DataFrame, commits: DataFrame, split_ts: int | str | None = None) -> DataFrame:
    """(file_id, size, wmc): the state of files at the split as far as the relations tell it.

    size is the number of lines left, all added less all removed, null where that is not positive; wmc is the sum
    of the complexities of each unit's last version, null for files without units.
    """
    when = latest_commits(commits).select("sha", "seq", "ts")
    live = changes.where("file_id is not null").where(before_split(split_ts)).groupBy("file_id").agg(
        F.sum(F.coalesce("add_lines", F.lit(0)).cast("bigint") - F.coalesce("del_lines", F.lit(0)).cast("bigint")).alias("left")
    )
    versions = units.where("file_id is not null").join(when, "sha").where(before_split(split_ts))
    order = F.struct("seq", "cc")
    last = versions.groupBy("file_id", "unit").agg(F.max(order).alias("v"))
    wmc = last.groupBy("file_id").agg(F.sum(F.coalesce("v.cc", F.lit(0)).cast("double")).alias("wmc"))
    return live.select("file_id", F.when(F.col("left") > 0, F.col("left")).cast("double").alias("size")).join(wmc, "file_id", "left")


def concentration(units: DataFrame, commits: DataFrame) -> DataFrame:
    """(max_cc, max_wmc, n_commits); 0 where there is nothing."""
    most = units.agg(F.coalesce(F.max("cc"), F.lit(0)).alias("max_cc"), F.coalesce(F.max("wmc_other"), F.lit(0)).alias("max_wmc"))
    return most.withColumn("n_commits", commits.agg(F.count_distinct("sha").alias("n")).scalar())


def coupling(changes: DataFrame, file_ids: DataFrame, max_files: int = 30, min_support: int = 3, top: int = 25) -> DataFrame:
    """The `top` file pairs by support, confidence and paths: (support, confidence, file_a, file_b).

    Support counts commits of at most `max_files` distinct files that change both. Confidence divides it by the
    smaller number of rows of the two files, where sweeping commits and repeated rows count.
    """
    rows = changes.where("sha is not null and file_id is not null")
    touched = rows.select("sha", "file_id").distinct()
    narrow = touched.groupBy("sha").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(2, max_files)).select("sha")
    sides = touched.join(narrow, "sha", "left_semi")
    a, b = sides.select("sha", F.col("file_id").alias("a")), sides.select("sha", F.col("file_id").alias("b"))
    pairs = a.join(b, "sha").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    counts = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    paths = file_ids.select(F.col("id").alias("file_id"), "canonical_path")
    facts = counts.join(paths, "file_id", "left").select("file_id", "n", F.coalesce("canonical_path", F.lit("?")).alias("path"))
    side = lambda s: facts.select(F.col("file_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("path").alias(f"file_{s}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("support", (F.col("support") / F.least("n_a", "n_b")).alias("confidence"), "file_a", "file_b")
        .orderBy(F.desc("support"), F.desc("confidence"), F.desc("file_a"), F.desc("file_b")).limit(top)
    )
