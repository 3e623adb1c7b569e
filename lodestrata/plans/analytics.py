"""Queries on file and commit features, rank statistics, links and coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import features, predictors, rankstats as rs, szz
from lodestrata.plans.scalars import LATEST
from lodestrata.session import cut
from lodestrata.tables import table

FRACTION = 0.75


def split_of(spark: SparkSession, folder: str, fraction: float = FRACTION) -> int | None:
    """The split of a history, one number."""
    return features.split_timestamp(features.latest_commits(table(spark, folder, "commits")), fraction).first().split_ts


def _history(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in ("commits", "file_changes", "unit_changes", "bug_links", "file_ids")}


def _features(spark: SparkSession, folder: str, split: int | None) -> DataFrame:
    h = _history(spark, folder)
    return features.file_features(h["file_changes"], h["commits"], h["unit_changes"], h["file_ids"], split)


def _columns(spark: SparkSession, folder: str) -> DataFrame:
    h, split = _history(spark, folder), split_of(spark, folder)
    universe = features.universe(_features(spark, folder, split))
    return predictors.predictor_columns(universe, features.snapshot(h["file_changes"], h["unit_changes"], h["commits"], split), split is not None)


def split_timestamp(spark, folder):
    return features.split_timestamp(features.latest_commits(table(spark, folder, "commits")), FRACTION)


def file_features(spark, folder):
    return _features(spark, folder, split_of(spark, folder)).withColumn("entropy", F.round("entropy", 6))


def snapshot_features(spark, folder):
    h = _history(spark, folder)
    return features.snapshot(h["file_changes"], h["unit_changes"], h["commits"], split_of(spark, folder))


def max_cc(spark, folder):
    return features.max_complexity(table(spark, folder, "unit_changes"))


def commit_churn(spark, folder):
    return features.commit_churn(table(spark, folder, "file_changes"))


def commit_complexity(spark, folder):
    return features.commit_complexity(table(spark, folder, "unit_changes"))


def commit_entropy(spark, folder):
    return features.commit_entropy(table(spark, folder, "file_changes")).select("sha", F.round("entropy", 6).alias("entropy"), "n_files")


def change_entropy(spark, folder):
    out = features.change_entropy(table(spark, folder, "file_changes"), split_of(spark, folder))
    return out.select("file_id", F.round("entropy", 6).alias("entropy"))


def hotspot(spark, folder):
    return _features(spark, folder, split_of(spark, folder)).select("file_id", "hotspot")


def prevalence(spark, folder):
    return features.universe(_features(spark, folder, split_of(spark, folder))).agg(F.count(F.lit(1)).alias("n_files"), F.round(F.avg((F.col("fix_after") > 0).cast("double")), 6).alias("prevalence"))


def files_by_impact(spark, folder):
    """The rows of files.csv."""
    return features.by_impact(features.universe(_features(spark, folder, split_of(spark, folder)))).select("file_id", *features.LISTED)


def top_files(spark, folder):
    """The report's list of the 20 files of the largest impact."""
    return files_by_impact(spark, folder).limit(20)


def concentration(spark, folder):
    return features.concentration(table(spark, folder, "unit_changes"), table(spark, folder, "commits"))


def coupling(spark, folder):
    out = features.coupling(table(spark, folder, "file_changes"), table(spark, folder, "file_ids"))
    return out.withColumn("confidence", F.round("confidence", 6))


def coupling_narrow(spark, folder):
    out = features.coupling(table(spark, folder, "file_changes"), table(spark, folder, "file_ids"), max_files=5)
    return out.withColumn("confidence", F.round("confidence", 6))


def szz_links(spark, folder):
    return szz.last_writer_links(table(spark, folder, "file_changes"))


def szz_counts(spark, folder):
    return szz.szz_counts(table(spark, folder, "commits"), table(spark, folder, "bug_links"))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    return szz.commit_features(h["commits"], h["file_changes"], h["unit_changes"], h["bug_links"])


def szz_stats(spark, folder):
    return szz.szz_statistics(_commits(spark, folder)).withColumn("value", F.round("value", 6))


def szz_quartiles(spark, folder):
    return szz.induce_rate_by_quarter(_commits(spark, folder)).withColumn("rate", F.round("rate", 6))


def avg_rank(spark, folder):
    """Average ranks of files by the lines changed in them, and of those counts themselves."""
    churn = table(spark, folder, "file_changes").where("file_id is not null").groupBy("file_id").agg(F.sum(features.lines()).alias("churn"), F.count(F.lit(1)).alias("n_rows"))
    ranks = rs.rank_columns(churn, "file_id", ["churn", "n_rows"])
    return ranks.select("file_id", (F.col("churn") / 2).alias("rank_churn"), (F.col("n_rows") / 2).alias("rank_rows"))


def _per_commit(spark: SparkSession, folder: str) -> DataFrame:
    return _commits(spark, folder)


def pearson(spark, folder):
    return rs.pearson(_per_commit(spark, folder), "churn", "mutation").withColumn("value", F.round("value", 6))


def spearman(spark, folder):
    return rs.spearman(_per_commit(spark, folder), "churn", "mutation", "sha").withColumn("value", F.round("value", 6))


def partial_spearman(spark, folder):
    return rs.partial_spearman(_per_commit(spark, folder), "mutation", "label", "churn", "sha").withColumn("value", F.round("value", 6))


def partial_multi(spark, folder):
    return rs.partial_spearman_multi(_per_commit(spark, folder), "composite", "label", ["churn", "files", "cc"], "sha").withColumn("value", F.round("value", 6))


def auc(spark, folder):
    return rs.auc(_per_commit(spark, folder), "composite", "label").withColumn("value", F.round("value", 6))


def precision_at_k(spark, folder):
    """Precision and lift of the 10, 25 and 50 files of the largest impact, beside that of the largest churn."""
    columns = cut(_columns(spark, folder).select("file_id", "impact", "churn", "label"))
    base = columns.agg(F.avg(F.col("label").cast("double")).alias("base")).scalar()
    found = rs.precisions(columns, ["impact", "churn"], "label", "file_id", (10, 25, 50))
    value = lambda score: F.max(F.when(F.col("score") == score, F.col("value")))
    both = found.groupBy("k").agg(value("impact").alias("a"), value("churn").alias("b"))
    return both.select("k", F.round("a", 6).alias("by_impact"), F.round("b", 6).alias("by_churn"), F.round(F.try_divide("a", base), 6).alias("lift"))


def predictor_matrix(spark, folder):
    return predictors.predictor_matrix(_columns(spark, folder)).withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        split_timestamp, file_features, snapshot_features, max_cc, commit_churn, commit_complexity, commit_entropy, change_entropy, hotspot,
        prevalence, files_by_impact, top_files, concentration, coupling, coupling_narrow, szz_links, szz_counts, szz_stats, szz_quartiles, avg_rank, pearson, spearman,
        partial_spearman, partial_multi, auc, precision_at_k, predictor_matrix,
    )
}

_LINES = "coalesce(add_lines, 0) + coalesce(del_lines, 0)"
_SPLIT = f"""lc AS (SELECT sha, email, ts, seq, is_merge, impact_mutation, impact_composite, files_changed FROM {LATEST}),
sp AS (SELECT CASE WHEN count(*) >= 20 THEN list_sort(list(ts))[CAST(least(count(*) - 1, floor(count(*) * 0.75)) AS BIGINT) + 1] END AS split_ts FROM lc WHERE ts > 0)"""
_ENTROPY = f"""parts AS (SELECT sha, file_id, sum({_LINES}) AS c FROM file_changes{{where}} GROUP BY 1, 2 HAVING sum({_LINES}) > 0),
ent AS (SELECT sha, count(*) AS n_files, CASE WHEN count(*) > 1 THEN -sum((c / t) * log2(c / t)) ELSE 0 END AS entropy
        FROM (SELECT *, sum(c) OVER (PARTITION BY sha) AS t FROM parts) GROUP BY sha)"""
_BEFORE = _ENTROPY.format(where=", sp WHERE sha IS NOT NULL AND file_id IS NOT NULL AND ts <= split_ts")
_ALWAYS = _ENTROPY.format(where=" WHERE sha IS NOT NULL AND file_id IS NOT NULL")
_FEATURES = f"""{_SPLIT}, {_BEFORE},
fent AS (SELECT file_id, sum(entropy) AS entropy FROM parts JOIN ent USING (sha) WHERE n_files > 1 GROUP BY 1),
mx AS (SELECT file_id, coalesce(max(cc), 0) AS max_cc FROM unit_changes WHERE file_id IS NOT NULL GROUP BY 1),
f AS (SELECT file_id,
  coalesce(arg_max(lang, lpad(CAST(coalesce(c.seq, 0) AS VARCHAR), 20, '0') || '|' || lang) FILTER (WHERE lang <> ''), '') AS lang,
  coalesce(bool_or(is_test), false) AS is_test,
  CAST(coalesce(sum(mutation_cost) FILTER (WHERE c.ts <= split_ts), 0) AS BIGINT) AS impact_mut,
  CAST(coalesce(sum(coalesce(mutation_cost, 0) + coalesce(godclass_cost, 0)) FILTER (WHERE c.ts <= split_ts), 0) AS BIGINT) AS impact_comp,
  CAST(coalesce(sum({_LINES}) FILTER (WHERE c.ts <= split_ts), 0) AS BIGINT) AS churn,
  count(DISTINCT c.sha) FILTER (WHERE c.ts <= split_ts) AS n_commits,
  count(DISTINCT email) FILTER (WHERE c.ts <= split_ts AND email <> '') AS n_authors,
  count(*) FILTER (WHERE is_fix) AS fix_all, count(*) FILTER (WHERE is_fix AND c.ts > split_ts) AS fix_after
  FROM file_changes c LEFT JOIN lc ON c.sha = lc.sha, sp WHERE file_id IS NOT NULL GROUP BY file_id),
feat AS (SELECT f.file_id, coalesce(canonical_path, '?') AS path, lang, is_test, impact_mut, impact_comp, churn, n_commits, n_authors,
  CAST(coalesce(max_cc, 0) AS BIGINT) AS max_cc, coalesce(entropy, 0) AS entropy, CAST(coalesce(max_cc, 0) * n_commits AS BIGINT) AS hotspot, fix_all, fix_after
  FROM f LEFT JOIN fent USING (file_id) LEFT JOIN mx USING (file_id) LEFT JOIN file_ids ON id = f.file_id)"""
_SNAPSHOT = """live AS (SELECT file_id, sum(coalesce(add_lines, 0)) - sum(coalesce(del_lines, 0)) AS size FROM file_changes, sp WHERE file_id IS NOT NULL AND ts <= split_ts GROUP BY 1),
ver AS (SELECT file_id, unit, lc.seq, cc FROM unit_changes u JOIN lc ON u.sha = lc.sha, sp WHERE file_id IS NOT NULL AND lc.ts <= split_ts),
lastv AS (SELECT file_id, unit, cc FROM ver QUALIFY row_number() OVER (PARTITION BY file_id, unit ORDER BY seq DESC, cc DESC) = 1),
snap AS (SELECT live.file_id, CAST(CASE WHEN size > 0 THEN size END AS DOUBLE) AS size, wmc FROM live LEFT JOIN (SELECT file_id, CAST(sum(cc) AS DOUBLE) AS wmc FROM lastv GROUP BY 1) USING (file_id))"""
_COMMITS = f"""{_SPLIT}, {_ALWAYS},
cf AS (SELECT lc.sha, coalesce(lc.seq, 0) AS seq, coalesce(impact_mutation, 0) AS mutation, coalesce(impact_composite, 0) AS composite, coalesce(churn, 0) AS churn,
  coalesce(files_changed, 0) AS files, coalesce(cc, 0) AS cc, coalesce(n_units, 0) AS n_units, round(coalesce(entropy, 0), 9) AS entropy,
  CASE WHEN lc.sha IN (SELECT inducing_sha FROM bug_links WHERE inducing_sha IS NOT NULL) THEN 1 ELSE 0 END AS label
  FROM lc LEFT JOIN (SELECT sha, sum({_LINES}) AS churn FROM file_changes GROUP BY 1) USING (sha)
  LEFT JOIN (SELECT sha, sum(coalesce(cc, 0)) AS cc, count(*) AS n_units FROM unit_changes GROUP BY 1) USING (sha) LEFT JOIN ent USING (sha)
  WHERE NOT coalesce(is_merge, false))"""


def rank_sql(column: str, partition: str = "") -> str:
    p = f"PARTITION BY {partition} " if partition else ""
    q = f"PARTITION BY {partition + ', ' if partition else ''}{column}"
    return f"rank() OVER ({p}ORDER BY {column}) + (count(*) OVER ({q}) - 1) / 2.0"


def correlation_sql(columns: list[str], source: str) -> str:
    """CTEs: rk has ranks of the columns of source, c0 all their correlations as (i, j, r)."""
    ranks = ", ".join(f"{rank_sql(c)} AS {c}" for c in columns)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, CASE WHEN isnan(v) THEN NULL ELSE v END AS r FROM (SELECT corr({a}, {b}) AS v FROM rk)" for a in columns for b in columns
    )
    return f"rk AS (SELECT {ranks} FROM {source}), c0 AS ({pairs})"


def schur_sql(controls: list[str], by: str) -> str:
    """CTEs m1, m2, ... from m0 (by, i, j, r): what a matrix of correlations leaves when one control more is taken out of it each time."""
    return ", ".join(
        f"m{n + 1} AS (SELECT a.{by}, a.i, a.j, a.r - x.r * y.r / nullif(z.r, 0) AS r FROM m{n} a JOIN m{n} x ON x.{by} = a.{by} AND x.i = a.i AND x.j = '{k}' "
        f"JOIN m{n} y ON y.{by} = a.{by} AND y.i = a.j AND y.j = '{k}' JOIN m{n} z ON z.{by} = a.{by} AND z.i = '{k}' AND z.j = '{k}' WHERE a.i <> '{k}' AND a.j <> '{k}')"
        for n, k in enumerate(controls)
    )


def eliminate_sql(controls: list[str]) -> str:
    """CTEs c1, c2, ...: correlations given one control more each time."""
    steps = []
    for n, k in enumerate(controls):
        steps.append(
            f"c{n + 1} AS (SELECT a.i, a.j, (a.r - x.r * y.r) / sqrt((1 - x.r * x.r) * (1 - y.r * y.r)) AS r FROM c{n} a "
            f"JOIN c{n} x ON x.i = a.i AND x.j = '{k}' JOIN c{n} y ON y.i = a.j AND y.j = '{k}' WHERE a.i <> '{k}' AND a.j <> '{k}')"
        )
    return ", ".join(steps)


def _auc_sql(score: str, label: str, source: str) -> str:
    return f"""(SELECT CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN (sum(rk_) FILTER (WHERE {label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0) / (sum({label}) * (count(*) - sum({label}))) END
  FROM (SELECT {label}, {rank_sql(score)} AS rk_ FROM {source}))"""


def _pick(step: int, i: str, j: str) -> str:
    return f"(SELECT r FROM c{step} WHERE i = '{i}' AND j = '{j}')"


def _coupling_sql(most: int) -> str:
    return f"""WITH e AS (SELECT DISTINCT sha, file_id FROM file_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL),
k AS (SELECT sha FROM e GROUP BY 1 HAVING count(*) <= {most}), n AS (SELECT file_id, count(*) AS n FROM file_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL GROUP BY 1),
p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS support FROM e a JOIN e b ON a.sha = b.sha AND a.file_id < b.file_id JOIN k ON k.sha = a.sha GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT support, round(support / CAST(least(x.n, y.n) AS DOUBLE), 6) AS confidence, coalesce(pa.canonical_path, '?') AS file_a, coalesce(pb.canonical_path, '?') AS file_b
FROM p JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b LEFT JOIN file_ids pa ON pa.id = a LEFT JOIN file_ids pb ON pb.id = b
ORDER BY support DESC, support / CAST(least(x.n, y.n) AS DOUBLE) DESC, file_a DESC, file_b DESC LIMIT 25"""


_COLS = f"""WITH {_FEATURES}, {_SNAPSHOT},
pc AS (SELECT feat.file_id, impact_mut AS impact, impact_comp, churn, n_commits AS commits, hotspot, size, wmc, round(entropy, 9) AS entropy, n_authors AS ndev,
  fix_all - fix_after AS prior_fixes, fix_after AS fixes, CASE WHEN fix_after > 0 THEN 1 ELSE 0 END AS label
  FROM feat LEFT JOIN snap USING (file_id) WHERE lang <> '' AND NOT is_test)"""


def _matrix_sql() -> str:
    """The same statistics one by one, each over the files that it needs."""

    def single(columns: list[str], body: str) -> str:
        need = [c for c in columns if c in ("size", "wmc")]
        where = " AND ".join(f"{c} IS NOT NULL" for c in need) or "true"
        return f"(WITH s AS (SELECT * FROM pc WHERE {where}), {body})"

    rows = []
    for c in [*predictors.CORE, *predictors.EXTRA]:
        rows.append(("spearman", c, "", single([c], correlation_sql([c, "fixes"], "s") + f" SELECT {_pick(0, c, 'fixes')}")))
    for x, z in [("impact", z) for z in ("churn", "hotspot", *predictors.EXTRA)] + [("impact_comp", "churn")]:
        rows.append(("partial", x, z, single([z], correlation_sql([x, "fixes", z], "s") + f", {eliminate_sql([z])} SELECT {_pick(1, x, 'fixes')}")))
    for name, controls in (("multi_core", ["churn", "hotspot", "size", "wmc"]), ("multi_all", ["churn", "hotspot", "size", "wmc", "entropy", "ndev"])):
        rows.append(("partial", "impact", name, single(controls, correlation_sql(["impact", "fixes", *controls], "s") + f", {eliminate_sql(controls)} SELECT {_pick(len(controls), 'impact', 'fixes')}")))
    for c in ["impact", "impact_comp", "churn", "hotspot", *predictors.EXTRA]:
        need = f"(SELECT * FROM pc WHERE {c} IS NOT NULL)"
        rows.append(("auc", c, "", _auc_sql(c, "label", need)))
    rows += [("n_files", "", "", "(SELECT count(*) FROM pc)"), ("n_buggy", "", "", "(SELECT sum(label) FROM pc)"), ("prevalence", "", "", "(SELECT avg(label) FROM pc)")]
    return _COLS + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{p}' AS predictor, '{c}' AS control, round(CAST({sql} AS DOUBLE), 6) AS value" for m, p, c, sql in rows)


def _szz_sql() -> str:
    many = [("multi_core", szz.CONTROLS[:4]), ("multi_all", szz.CONTROLS)]
    parts = [("auc", c, "", _auc_sql(c, "label", "cf")) for c in ("mutation", "composite", "churn")]
    for x in ("mutation", "composite"):
        parts.append(("partial", x, "churn", f"(WITH {correlation_sql([x, 'label', 'churn'], 'cf')}, {eliminate_sql(['churn'])} SELECT {_pick(1, x, 'label')})"))
    for name, controls in many:
        parts.append(("partial", "composite", name, f"(WITH {correlation_sql(['composite', 'label', *controls], 'cf')}, {eliminate_sql(controls)} SELECT {_pick(len(controls), 'composite', 'label')})"))
    return f"WITH {_COMMITS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{p}' AS predictor, '{c}' AS control, round(CAST({s} AS DOUBLE), 6) AS value" for m, p, c, s in parts)


_LISTED = "file_id, " + ", ".join(features.LISTED)


def _top(k: int, score: str) -> str:
    return f"(SELECT avg(label) FROM (SELECT label FROM pc ORDER BY {score} DESC, file_id LIMIT {k}))"


ORACLE = {
    "split_timestamp": f"WITH {_SPLIT} SELECT split_ts FROM sp",
    "file_features": f"WITH {_FEATURES} SELECT * REPLACE (round(entropy, 6) AS entropy) FROM feat",
    "snapshot_features": f"WITH {_SPLIT}, {_SNAPSHOT} SELECT * FROM snap",
    "max_cc": "SELECT file_id, CAST(coalesce(max(cc), 0) AS BIGINT) AS max_cc FROM unit_changes WHERE file_id IS NOT NULL GROUP BY 1",
    "commit_churn": f"SELECT sha, CAST(sum({_LINES}) AS BIGINT) AS churn FROM file_changes WHERE sha IS NOT NULL GROUP BY 1",
    "commit_complexity": "SELECT sha, CAST(sum(coalesce(cc, 0)) AS BIGINT) AS cc, count(*) AS n_units FROM unit_changes WHERE sha IS NOT NULL GROUP BY 1",
    "commit_entropy": f"WITH {_ALWAYS} SELECT sha, round(entropy, 6) AS entropy, n_files FROM ent",
    "change_entropy": f"WITH {_FEATURES} SELECT file_id, round(entropy, 6) AS entropy FROM fent",
    "hotspot": f"WITH {_FEATURES} SELECT file_id, hotspot FROM feat",
    "prevalence": f"WITH {_FEATURES} SELECT count(*) AS n_files, round(avg(CASE WHEN fix_after > 0 THEN 1.0 ELSE 0.0 END), 6) AS prevalence FROM feat WHERE lang <> '' AND NOT is_test",
    "files_by_impact": f"WITH {_FEATURES} SELECT {_LISTED} FROM feat WHERE lang <> '' AND NOT is_test ORDER BY impact_mut DESC, file_id",
    "top_files": f"WITH {_FEATURES} SELECT {_LISTED} FROM feat WHERE lang <> '' AND NOT is_test ORDER BY impact_mut DESC, file_id LIMIT 20",
    "concentration": "SELECT coalesce(max(cc), 0) AS max_cc, coalesce(max(wmc_other), 0) AS max_wmc, (SELECT count(DISTINCT sha) FROM commits) AS n_commits FROM unit_changes",
    "coupling": _coupling_sql(30),
    "coupling_narrow": _coupling_sql(5),
    "szz_links": """WITH k AS (SELECT * FROM file_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL AND seq IS NOT NULL),
ok AS (SELECT sha FROM k WHERE is_fix GROUP BY 1 HAVING count(DISTINCT file_id) <= 60),
fx AS (SELECT DISTINCT sha, file_id, seq FROM k WHERE is_fix AND del_lines > 0 AND sha IN (SELECT sha FROM ok)),
pv AS (SELECT fx.sha, fx.file_id, max(k.seq) AS seq FROM fx JOIN k ON k.file_id = fx.file_id AND k.seq < fx.seq GROUP BY fx.sha, fx.file_id, fx.seq)
SELECT DISTINCT pv.sha AS fix_sha, k.sha AS inducing_sha, pv.file_id FROM pv JOIN k ON k.file_id = pv.file_id AND k.seq = pv.seq WHERE pv.sha <> k.sha""",
    "szz_counts": "SELECT count(DISTINCT inducing_sha) AS n_inducing, count(DISTINCT fix_sha) AS n_linked_fixes, (SELECT count(DISTINCT inducing_sha) FROM bug_links WHERE inducing_sha IN (SELECT sha FROM commits)) AS n_matched FROM bug_links",
    "szz_stats": _szz_sql(),
    "szz_quartiles": f"""WITH {_COMMITS}, o AS (SELECT label, row_number() OVER (ORDER BY mutation, seq, sha) - 1 AS i, count(*) OVER () AS n FROM cf)
SELECT CAST((4 * i + 3) // n + 1 AS INTEGER) AS quarter, count(*) AS n, round(avg(label), 6) AS rate FROM o GROUP BY 1""",
    "avg_rank": f"""SELECT file_id, {rank_sql('churn')} AS rank_churn, {rank_sql('n_rows')} AS rank_rows
FROM (SELECT file_id, sum({_LINES}) AS churn, count(*) AS n_rows FROM file_changes WHERE file_id IS NOT NULL GROUP BY 1)""",
    "pearson": f"WITH {_COMMITS} SELECT round(corr(churn, mutation), 6) AS value FROM cf",
    "spearman": f"WITH {_COMMITS}, {correlation_sql(['churn', 'mutation'], 'cf')} SELECT round({_pick(0, 'churn', 'mutation')}, 6) AS value",
    "partial_spearman": f"WITH {_COMMITS}, {correlation_sql(['mutation', 'label', 'churn'], 'cf')}, {eliminate_sql(['churn'])} SELECT round({_pick(1, 'mutation', 'label')}, 6) AS value",
    "partial_multi": f"WITH {_COMMITS}, {correlation_sql(['composite', 'label', 'churn', 'files', 'cc'], 'cf')}, {eliminate_sql(['churn', 'files', 'cc'])} SELECT round({_pick(3, 'composite', 'label')}, 6) AS value",
    "auc": f"WITH {_COMMITS} SELECT round({_auc_sql('composite', 'label', 'cf')}, 6) AS value",
    "precision_at_k": _COLS + " " + " UNION ALL ".join(
        f"SELECT {k} AS k, round({_top(k, 'impact')}, 6) AS by_impact, round({_top(k, 'churn')}, 6) AS by_churn, round({_top(k, 'impact')} / (SELECT avg(label) FROM pc), 6) AS lift" for k in (10, 25, 50)
    ),
    "predictor_matrix": _matrix_sql(),
}
