"""All file-level statistics of one or many histories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.operators import rankstats as rs
from lodestrata.session import cut

CORE = ["impact", "impact_comp", "churn", "commits", "hotspot"]
EXTRA = ["size", "wmc", "entropy", "ndev", "prior_fixes"]
#: Columns that may be unknown for a file; statistics that need one rank only the files where it is known.
PARTLY = {"size": ["size"], "wmc": ["wmc"], "both": ["size", "wmc"], "all": []}
#: The columns that each of these sets of files ranks.
RANKED = {
    "size": ["impact", "fixes", "size"], "wmc": ["impact", "fixes", "wmc"],
    "both": ["impact", "fixes", "churn", "hotspot", "size", "wmc", "entropy", "ndev"],
    "all": ["impact", "fixes", "impact_comp", "churn", "commits", "hotspot", "entropy", "ndev", "prior_fixes"],
}
COLUMNS = ["impact", "fixes", "impact_comp", "churn", "commits", "hotspot", "entropy", "ndev", "prior_fixes", "size", "wmc"]


def predictor_columns(universe: DataFrame, state: DataFrame, split: bool = True) -> DataFrame:
    """file_id with the predictors, the outcome `fixes` (after the split, or all without one) and its `label`."""
    outcome = F.col("fix_after") if split else F.col("fix_all")
    known = [c for c in ("repo",) if c in universe.columns]
    return universe.join(state, "file_id", "left").select(
        *known, "file_id", F.col("impact_mut").alias("impact"), "impact_comp", "churn", F.col("n_commits").alias("commits"), "hotspot", "size", "wmc",
        F.round("entropy", 9).alias("entropy"), F.col("n_authors").alias("ndev"), (F.col("fix_all") - F.col("fix_after")).alias("prior_fixes"),
        outcome.alias("fixes"), (outcome > 0).cast("int").alias("label"),
    )


def _subset(predictor: str) -> str:
    return predictor if predictor in ("size", "wmc") else "all"


def predictor_matrix(columns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, predictor, control, value) for spearman, auc, partial, and the counts n_files, n_buggy, prevalence.

    The four rank sets (all files, and those with a known size, complexity, or both) go through one ranking of
    the columns they need and one aggregation of the products, side by side. Statistics of three or fewer rows with an extra predictor, or
    of too few for many controls, are null.
    """
    by, columns = by or [], cut(columns)
    keys = [*by, "subset"]
    sets = F.array(*[F.when(F.lit(True) if not need else F.expr(" and ".join(f"{c} is not null" for c in need)), F.lit(name)) for name, need in PARTLY.items()])
    rows = columns.withColumn("subset", F.explode(sets)).where("subset is not null")
    asked = F.create_map(*[x for name, ranked in RANKED.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in ranked]))])[F.col("subset")]
    ranks = rs.rank_columns(rows, "file_id", COLUMNS, keys, asked, ["label"])
    scored = ["impact", "impact_comp", "churn", "hotspot", *EXTRA]
    at = {c: i for i, c in enumerate(COLUMNS)}
    place = lambda x, y: (min(at[x], at[y]), max(at[x], at[y]))
    cell = lambda x, y: F.col("r_{}_{}".format(*place(x, y)))
    used = {place(x, y) for x in RANKED["both"] for y in RANKED["both"]}
    used |= {place(x, y) for x in COLUMNS for y in ("impact", "fixes")} | {place("impact_comp", "churn")}
    more = [F.sum("label").alias("p"), *[F.sum(F.col(c) * F.col("label")).alias(f"of_{c}") for c in scored]]
    r = rs.correlations(ranks, COLUMNS, keys, sorted(used), more)
    entry = lambda s, m, p, c, v: F.struct(F.lit(s).alias("of"), F.lit(m).alias("metric"), F.lit(p).alias("predictor"), F.lit(c).alias("control"), v.cast("double").alias("value"))
    guard = lambda p, v, least=2: F.when(F.col("n") > least, v) if p in EXTRA else v

    def partial(x: str, z: str) -> Column:
        return guard(z, rs.partial_of(cell(x, "fixes"), cell(x, z), cell("fixes", z)))

    def many(controls: list[str]) -> Column:
        names = ["impact", "fixes", *controls]
        cells = [cell(names[i], names[j]) for i in range(len(names)) for j in range(i, len(names))]
        return F.when(F.col("n") > len(controls) + 3, rs.partial_multi(cells, len(names), F.col("n")))

    core = ["churn", "hotspot", "size", "wmc"]
    from_r = [entry(_subset(c), "spearman", c, "", guard(c, cell(c, "fixes"))) for c in [*CORE, *EXTRA]]
    from_r += [entry(_subset(z), "partial", "impact", z, partial("impact", z)) for z in ["churn", "hotspot", *EXTRA]]
    from_r += [entry("all", "partial", "impact_comp", "churn", partial("impact_comp", "churn"))]
    from_r += [entry("both", "partial", "impact", "multi_core", many(core)), entry("both", "partial", "impact", "multi_all", many([*core, "entropy", "ndev"]))]
    from_l = [entry(_subset(c), "auc", c, "", guard(c, rs.auc_of(F.col(f"of_{c}"), F.col("p"), F.col("n")), 0)) for c in scored]
    from_l += [entry("all", "n_files", "", "", F.col("n")), entry("all", "n_buggy", "", "", F.col("p")), entry("all", "prevalence", "", "", F.col("p") / F.col("n"))]
    out = r.select(*keys, F.explode(F.array(*from_r, *from_l)).alias("e"))
    return out.where("subset = e.of").select(*by, "e.metric", "e.predictor", "e.control", "e.value")
