"""Change impact: cost of every changed function from two versions of its file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions import units as u
from lodestrata.operators.order import last_before

#: Share of common tokens from which a new unit is a renamed old one.
RENAME_JACCARD = 0.6


def _claims(new: list, old: list, threshold: float) -> list[int]:
    """For each new token set in order the best unclaimed old one (the later of equals), or -1."""
    taken: set[int] = set()
    out = []
    for tokens in new:
        best, score = -1, threshold
        mine = set(tokens)
        for i, other in enumerate(old):
            if i in taken:
                continue
            theirs = set(other)
            union = len(mine | theirs)
            j = len(mine & theirs) / union if union else 1.0
            if j >= score:
                best, score = i, j
        if best >= 0:
            taken.add(best)
        out.append(best)
    return out


def rename_claims(new_tokens: Column, old_tokens: Column, threshold: float = RENAME_JACCARD) -> Column:
    """array<int>: which of the old token sets each new one takes over, 0-based, or -1. Order matters: claims are greedy."""

    @F.pandas_udf("array<int>")
    def claim(new: pd.Series, old: pd.Series) -> pd.Series:
        return pd.Series([_claims(list(a), list(b), threshold) for a, b in zip(new, old, strict=True)])

    return claim(new_tokens, old_tokens)


def _sum_cc(units: Column, container: Column) -> Column:
    same = F.filter(units, lambda x: x["container"] == container)
    return F.aggregate(same, F.lit(0).cast("bigint"), lambda n, x: n + x["cc"])


def _last_named(units: Column, name: Column) -> Column:
    """The last of the units with a name, or null."""
    return F.try_element_at(F.filter(units, lambda x: x["name"] == name), F.lit(-1))


def unit_impacts(versions: DataFrame, keys: list[str], wmc_context: str = "before", threshold: float = RENAME_JACCARD) -> DataFrame:
    """(keys, unit, container, cc, dlines, wmc_other, cost, kind) of each function that a change touched.

    `versions` has one row per changed file: keys; before and after, arrays of struct(name, container, start_line,
    end_line, cc); before_lines and after_lines, the sources as arrays of lines; added and removed, arrays of
    struct(start, count) with the disjoint ranges of one diff. A unit is touched by added lines only. It is a
    mutation of the last old unit of its name; else a rename of the best old unit that vanished, lost lines here
    and shares enough tokens; else new ('godclass'). The surrounding complexity is that of its container before the
    change without the old unit, or after it without the unit itself. Null arrays count as empty. A file is
    scored within its own row, so nothing is shuffled.
    """
    if wmc_context not in ("before", "after"):
        raise ValueError("wmc_context must be 'before' or 'after'")
    arrays = {c: F.coalesce(F.col(c), F.array().cast(versions.schema[c].dataType)) for c in ("before", "after", "before_lines", "after_lines", "added", "removed")}
    rows = versions.select(*keys, *[c.alias(n) for n, c in arrays.items()])
    before, after = F.col("before"), F.col("after")
    names_before, names_after = F.transform(before, lambda x: x["name"]), F.transform(after, lambda x: x["name"])
    touched = F.filter(
        F.transform(after, lambda x: F.struct(x.alias("u"), u.range_overlap(x["start_line"], x["end_line"], F.col("added")).alias("more"))), lambda t: t["more"] > 0
    )
    rows = rows.withColumn("touched", touched)
    fresh = F.filter("touched", lambda t: ~F.array_contains(names_before, t["u"]["name"]))
    gone = F.filter(before, lambda x: ~F.array_contains(names_after, x["name"]) & (u.range_overlap(x["start_line"], x["end_line"], F.col("removed")) > 0))
    rows = rows.withColumn("fresh", fresh).withColumn("gone", gone)
    claims = rename_claims(
        F.transform("fresh", lambda t: u.unit_tokens(F.col("after_lines"), t["u"]["start_line"], t["u"]["end_line"])),
        F.transform("gone", lambda x: u.unit_tokens(F.col("before_lines"), x["start_line"], x["end_line"])),
        threshold,
    )
    rows = rows.withColumn("claims", claims)
    named = F.transform(
        F.filter("touched", lambda t: F.array_contains(names_before, t["u"]["name"])),
        lambda t: F.struct(t["u"].alias("u"), t["more"].alias("more"), _last_named(before, t["u"]["name"]).alias("old"), F.lit("mutation").alias("kind")),
    )
    others = F.zip_with(
        "fresh", "claims",
        lambda t, i: F.struct(t["u"].alias("u"), t["more"].alias("more"), F.try_element_at(F.col("gone"), F.nullif(i + 1, F.lit(0))).alias("old"), F.when(i >= 0, "rename").otherwise("godclass").alias("kind")),
    )
    flat = rows.withColumn("x", F.explode(F.concat(named, others)))
    unit, old = F.col("x.u"), F.col("x.old")
    lost = F.when(old.isNotNull(), u.range_overlap(old["start_line"], old["end_line"], F.col("removed"))).otherwise(0)
    dlines = F.greatest(F.lit(1), F.col("x.more") + lost)
    if wmc_context == "before":
        around = _sum_cc(before, unit["container"]) - F.coalesce(old["cc"], F.lit(0))
    else:
        around = _sum_cc(after, unit["container"]) - unit["cc"]
    scored = flat.select(
        *keys, unit["name"].alias("unit"), unit["container"].alias("container"), unit["cc"].alias("cc"), dlines.cast("int").alias("dlines"),
        F.greatest(around, F.lit(0)).cast("int").alias("wmc_other"), F.col("x.kind").alias("kind"),
    )
    return scored.withColumn("cost", u.unit_cost(F.col("wmc_other"), F.col("cc"), F.col("dlines")))


def file_impact(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mutation_cost, godclass_cost, mut_fns, new_fns, renames); renames count as mutations too."""
    new = F.col("kind") == "godclass"
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return units.groupBy(*keys).agg(
        zero(F.sum(F.when(~new, F.col("cost")))).alias("mutation_cost"), zero(F.sum(F.when(new, F.col("cost")))).alias("godclass_cost"),
        F.count_if(~new).alias("mut_fns"), F.count_if(new).alias("new_fns"), F.count_if(F.col("kind") == "rename").alias("renames"),
    )


def commit_impact(changes: DataFrame, scored: Column) -> DataFrame:
    """(sha, files_changed, impact_mutation, impact_godclass, impact_composite) of changes; `scored` marks source files added, modified or renamed."""
    zero = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint")
    sums = changes.where("sha is not null").groupBy("sha").agg(F.count_if(scored).alias("files_changed"), zero("mutation_cost").alias("impact_mutation"), zero("godclass_cost").alias("impact_godclass"))
    return sums.withColumn("impact_composite", (F.col("impact_mutation") + F.col("impact_godclass")) * F.col("files_changed"))


def container_wmc(units: DataFrame, version: list[str]) -> DataFrame:
    """(version, container, wmc): complexity of each container in each version of a file."""
    return units.groupBy(*version, F.coalesce("container", F.lit("")).alias("container")).agg(F.sum(F.coalesce("cc", F.lit(0)).cast("bigint")).alias("wmc"))


def wmc_after(units: DataFrame, version: list[str]) -> DataFrame:
    """The units with `wmc_after`, the complexity of the others in their container."""
    own = units.withColumn("container", F.coalesce("container", F.lit("")))
    rest = F.greatest(F.col("wmc") - F.coalesce("cc", F.lit(0)), F.lit(0))
    return own.join(container_wmc(units, version), [*version, "container"]).withColumn("wmc_after", rest).drop("wmc")


def previous_version(units: DataFrame, order: DataFrame) -> DataFrame:
    """(sha, file_id, prev_sha): for each version of a file's units the one before it in history order.

    `order` has sha and seq; of versions of equal seq the larger sha is the later.
    """
    versions = units.where("file_id is not null and sha is not null").select("sha", "file_id").distinct().join(order, "sha")
    return last_before(versions, "file_id", "seq", ["sha"], "sha", "prev_sha").select("sha", "file_id", "prev_sha")


def name_match(units: DataFrame, previous: DataFrame) -> DataFrame:
    """(sha, file_id, unit, cc, prior_cc): each unit beside that of its name in the previous version, null if new.

    Of units of one name in a version the one of the largest complexity stands for all.
    """
    known = units.where("file_id is not null and sha is not null and unit is not null").groupBy("sha", "file_id", "unit").agg(F.max("cc").alias("cc"))
    prior = known.select(F.col("sha").alias("prev_sha"), "file_id", "unit", F.col("cc").alias("prior_cc"))
    return known.join(previous, ["sha", "file_id"]).join(prior, ["prev_sha", "file_id", "unit"], "left").select("sha", "file_id", "unit", "cc", "prior_cc")
