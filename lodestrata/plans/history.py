"""Queries on change impact, file identity, chart points and many repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import paths, units as u
from lodestrata.operators import charts, features, identity, impact, predictors, summary
from lodestrata.plans.analytics import rank_sql, schur_sql
from lodestrata.plans.scalars import _SOURCE, LATEST
from lodestrata.tables import table

VERSION = ["sha", "file_id"]


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unit_changes").where("sha is not null and file_id is not null and unit is not null")


def _order(spark: SparkSession, folder: str) -> DataFrame:
    return features.latest_commits(table(spark, folder, "commits")).select("sha", "seq")


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder)
    return impact.name_match(units, impact.previous_version(units, _order(spark, folder)))


def container_wmc(spark, folder):
    return impact.container_wmc(_units(spark, folder), VERSION)


def wmc_after(spark, folder):
    return impact.wmc_after(_units(spark, folder), VERSION).select("sha", "file_id", "unit", "cc", "wmc_after")


def wmc_before(spark, folder):
    """Complexity around each unit in the version before the change, without the unit's own old one."""
    units = _units(spark, folder).withColumn("container", F.coalesce("container", F.lit("")))
    previous = impact.previous_version(units, _order(spark, folder))
    before = impact.container_wmc(units, VERSION).withColumnRenamed("sha", "prev_sha")
    matched = impact.name_match(units, previous).drop("cc")
    one = units.groupBy("sha", "file_id", "unit").agg(F.max("container").alias("container"))
    rest = F.greatest(F.coalesce("wmc", F.lit(0)) - F.coalesce("prior_cc", F.lit(0)), F.lit(0)).cast("bigint")
    return (
        one.join(previous, VERSION).join(matched, ["sha", "file_id", "unit"]).join(before, ["prev_sha", "file_id", "container"], "left")
        .select("sha", "file_id", "unit", rest.alias("wmc_before"))
    )


def name_match(spark, folder):
    return _matched(spark, folder)


def change_kind(spark, folder):
    kind = F.when(F.col("prior_cc").isNull(), "godclass").otherwise("mutation")
    return _matched(spark, folder).select("sha", "file_id", "unit", kind.alias("kind_by_name"))


def touched_units(spark, folder):
    """Units whose span, laid out from their stored measures, meets an added range."""
    rows = _units(spark, folder).where("cc is not null and dlines is not null and wmc_other is not null")
    ranges = F.array(F.struct((F.col("wmc_other") % 11).cast("int").alias("start"), F.col("dlines").alias("count")))
    return rows.withColumn("more", u.range_overlap(F.col("cc"), F.col("cc") * 2, ranges)).where("more > 0").select("sha", "file_id", "unit", "cc", "more")


def unit_versions(units: DataFrame, previous: DataFrame) -> DataFrame:
    """Stored units as file versions for `unit_impacts`: three lines for each unit, its words on the first.

    A version holds the units of one file in one commit, as many as a source file has functions.
    """
    words = F.concat_ws(" ", F.split(F.regexp_replace("unit", "(?<=[a-z])(?=[A-Z])", " "), r"[_:\s]+"))
    listed = units.groupBy("sha", "file_id").agg(
        F.array_sort(F.collect_set(F.struct("unit", F.coalesce("container", F.lit("")).alias("container"), F.coalesce("cc", F.lit(1)).alias("cc"), words.alias("words")))).alias("list")
    )
    version = listed.select(
        "sha", "file_id",
        F.transform("list", lambda x, i: F.struct(x["unit"].alias("name"), x["container"].alias("container"), (i * 3 + 1).cast("int").alias("start_line"), (i * 3 + 3).cast("int").alias("end_line"), x["cc"].alias("cc"))).alias("units"),
        F.flatten(F.transform("list", lambda x: F.array(x["words"], F.lit("..."), F.lit("")))).alias("lines"),
    )
    old = version.select(F.col("sha").alias("prev_sha"), "file_id", F.col("units").alias("before"), F.col("lines").alias("before_lines"))
    first = lambda c, n: F.transform(c, lambda x: F.struct(x["start_line"].alias("start"), F.lit(n).alias("count")))
    rows = version.withColumnsRenamed({"units": "after", "lines": "after_lines"}).join(previous, VERSION).join(old, ["prev_sha", "file_id"], "left")
    return rows.select("sha", "file_id", "before", "after", "before_lines", "after_lines", first(F.col("after"), 2).alias("added"), F.coalesce(first(F.col("before"), 1), F.array().cast("array<struct<start:int,count:int>>")).alias("removed"))


def rename_match(spark, folder):
    units = _units(spark, folder)
    return impact.unit_impacts(unit_versions(units, impact.previous_version(units, _order(spark, folder))), VERSION)


def file_impact(spark, folder):
    return impact.file_impact(_units(spark, folder), VERSION)


def commit_impact(spark, folder):
    scored = paths.is_source("path") & F.col("status").isin("A", "M", "R")
    return impact.commit_impact(table(spark, folder, "file_changes"), F.coalesce(scored, F.lit(False)))


def distinct_versions(spark, folder):
    """Versions to be parsed: distinct contents, of whatever number of units, that no earlier half of the history had."""
    rows = _units(spark, folder).join(_order(spark, folder), "sha").withColumn("oid", F.md5(F.concat_ws("|", "unit", "container", F.col("cc").cast("string"))))
    middle = rows.agg((F.max("seq") / 2).alias("m")).scalar()
    halves = rows.withColumn("m", middle)
    return halves.where("seq > m").select("oid").distinct().join(halves.where("seq <= m").select("oid").distinct(), "oid", "left_anti")


def file_identity(spark, folder):
    return identity.file_identity(identity.rename_sources(table(spark, folder, "file_changes")))[1]


def canonical_paths(spark, folder):
    return identity.file_identity(identity.rename_sources(table(spark, folder, "file_changes")))[0]


def commit_series(spark, folder):
    return charts.commit_series(table(spark, folder, "commits"))


def axis_scale(spark, folder):
    return charts.axis_scale(commit_series(spark, folder))


def downsample(spark, folder):
    """Chart points of one metric, thinned to a thousand."""
    points = commit_series(spark, folder).where("metric = 'impact_mutation'").select("idx", "bug", "value")
    return charts.downsample(points, cap=1_000)


def chart_cells(spark, folder):
    """The charts of all commits as counts per cell."""
    return charts.chart_cells(commit_series(spark, folder))


def _many(spark: SparkSession, folder: str) -> DataFrame:
    return summary.many_histories({n: table(spark, folder, n) for n in ("commits", "file_changes", "unit_changes", "file_ids")})


def repo_splits(spark, folder):
    ids = table(spark, folder, "file_ids").select(F.col("id").alias("file_id"), summary.repository("canonical_path").alias("repo"))
    rows = table(spark, folder, "file_changes").where("file_id is not null and sha is not null").join(ids, "file_id")
    return summary.split_timestamps(rows.select("repo", "sha", "ts").distinct(), ["repo"])


def repo_ranking(spark, folder):
    out = summary.repo_ranking(_many(spark, folder))
    return out.select("repo", "n_files", F.round("prevalence", 6).alias("prevalence"), F.round("partial_mut", 6).alias("partial_mut"))


def cross_repo_summary(spark, folder):
    return summary.cross_repo_summary(_many(spark, folder))


def repo_precision(spark, folder):
    """Precision at k of every repository."""
    h = {n: table(spark, folder, n) for n in ("commits", "file_changes", "unit_changes", "file_ids")}
    out = summary.precision_by_repository(summary.many_columns(h))
    return out.select("repo", "k", *[F.round(c, 6).alias(c) for c in ("by_impact", "by_churn", "lift")])


QUERIES = {
    f.__name__: f
    for f in (
        container_wmc, wmc_after, wmc_before, name_match, change_kind, touched_units, rename_match, file_impact, commit_impact,
        distinct_versions, file_identity, canonical_paths, commit_series, axis_scale, downsample, chart_cells,
        repo_splits, repo_ranking, repo_precision, cross_repo_summary,
    )
}

_U = "u AS (SELECT * REPLACE (coalesce(container, '') AS container) FROM unit_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL AND unit IS NOT NULL)"
_PREV = f"""lc AS (SELECT sha, seq FROM {LATEST}), vs AS (SELECT DISTINCT u.sha, file_id, seq FROM u JOIN lc ON lc.sha = u.sha),
pv AS (SELECT sha, file_id, lag(sha) OVER (PARTITION BY file_id ORDER BY seq, sha) AS prev_sha FROM vs)"""
_MATCH = """k AS (SELECT sha, file_id, unit, max(cc) AS cc FROM u GROUP BY 1, 2, 3),
mt AS (SELECT k.sha, k.file_id, k.unit, k.cc, p.cc AS prior_cc FROM k JOIN pv ON pv.sha = k.sha AND pv.file_id = k.file_id
  LEFT JOIN k p ON p.sha = pv.prev_sha AND p.file_id = k.file_id AND p.unit = k.unit)"""
_SERIES = f"""cs AS (SELECT row_number() OVER (ORDER BY seq, sha) - 1 AS idx, sha, coalesce(is_fix, false) OR coalesce(is_revert, false) AS bug,
{', '.join(f'CAST(coalesce({m}, 0) AS BIGINT) AS {m}' for m in charts.METRICS)} FROM {LATEST})"""
_LONG = " UNION ALL ".join(f"SELECT idx, sha, bug, '{m}' AS metric, {m} AS value FROM cs" for m in charts.METRICS)
_REPO = "CASE WHEN strpos(p, '/') > 0 THEN string_split(p, '/')[1] ELSE '' END"
_REPOS = f"ids AS (SELECT id AS file_id, {_REPO} AS repo FROM (SELECT id, regexp_replace(trim(replace(canonical_path, chr(92), '/'), ' ' || chr(9) || chr(10) || chr(13)), '^(\\./+)+', '') AS p FROM file_ids))"
_RSPLIT = """rt AS (SELECT DISTINCT repo, sha, ts FROM file_changes JOIN ids USING (file_id) WHERE sha IS NOT NULL AND ts > 0),
rs AS (SELECT repo, list_sort(list(ts))[CAST(least(count(*) - 1, floor(count(*) * 0.75)) AS BIGINT) + 1] AS split_ts FROM rt GROUP BY 1 HAVING count(*) >= 20)"""
_L = "coalesce(add_lines, 0) + coalesce(del_lines, 0)"

_BOTH = "coalesce(mutation_cost, 0) + coalesce(godclass_cost, 0)"
# the columns of all files with their repositories, and their ranks in the four sets of files
_MANY = f"""{_REPOS}, {_RSPLIT}, lc AS (SELECT sha, email, seq, ts FROM {LATEST}),
sf AS (SELECT file_id, repo, split_ts FROM ids LEFT JOIN rs USING (repo)),
c AS (SELECT f.*, repo, split_ts, coalesce(split_ts IS NULL OR f.ts <= split_ts, false) AS early FROM file_changes f JOIN sf USING (file_id)),
pa AS (SELECT sha, file_id, sum({_L}) AS l FROM c WHERE sha IS NOT NULL AND early GROUP BY 1, 2 HAVING sum({_L}) > 0),
en AS (SELECT sha, -sum((l / t) * log2(l / t)) AS h FROM (SELECT *, sum(l) OVER (PARTITION BY sha) AS t FROM pa) GROUP BY 1 HAVING count(*) > 1),
fe AS (SELECT file_id, sum(h) AS entropy FROM pa JOIN en USING (sha) GROUP BY 1),
mx AS (SELECT file_id, coalesce(max(cc), 0) AS max_cc FROM unit_changes GROUP BY 1),
fx AS (SELECT repo, c.file_id, bool_or(coalesce(is_test, false)) AS is_test, bool_or(lang <> '') AS named, sum(CASE WHEN early THEN coalesce(mutation_cost, 0) ELSE 0 END) AS impact,
  sum(CASE WHEN early THEN {_BOTH} ELSE 0 END) AS impact_comp, sum(CASE WHEN early THEN {_L} ELSE 0 END) AS churn, count(DISTINCT c.sha) FILTER (WHERE early) AS commits,
  count(DISTINCT email) FILTER (WHERE early AND email <> '') AS ndev, count(*) FILTER (WHERE is_fix) AS fix_all, count(*) FILTER (WHERE is_fix AND (split_ts IS NULL OR c.ts > split_ts)) AS fixes
  FROM c LEFT JOIN lc ON lc.sha = c.sha GROUP BY 1, 2),
lv AS (SELECT file_id, CAST(sum(coalesce(add_lines, 0)) - sum(coalesce(del_lines, 0)) AS DOUBLE) AS size FROM c WHERE early GROUP BY 1),
vr AS (SELECT u.file_id, unit, cc FROM unit_changes u JOIN sf USING (file_id) JOIN lc ON lc.sha = u.sha WHERE split_ts IS NULL OR lc.ts <= split_ts
  QUALIFY row_number() OVER (PARTITION BY u.file_id, unit ORDER BY lc.seq DESC, cc DESC) = 1),
wm AS (SELECT file_id, CAST(sum(cc) AS DOUBLE) AS wmc FROM vr GROUP BY 1),
pc AS (SELECT repo, fx.file_id, impact, impact_comp, churn, commits, coalesce(max_cc, 0) * commits AS hotspot, CASE WHEN size > 0 THEN size END AS size, CASE WHEN lv.file_id IS NOT NULL THEN wmc END AS wmc,
  round(coalesce(entropy, 0), 9) AS entropy, ndev, fix_all - fixes AS prior_fixes, fixes, CASE WHEN fixes > 0 THEN 1 ELSE 0 END AS label
  FROM fx LEFT JOIN fe USING (file_id) LEFT JOIN mx USING (file_id) LEFT JOIN lv USING (file_id) LEFT JOIN wm USING (file_id) WHERE named AND NOT is_test)"""


def _summary_sql() -> str:
    """All statistics of every repository as rows, then what they are over the repositories."""
    sets = " UNION ALL ".join(f"SELECT '{n}' AS subset, * FROM pc WHERE {' AND '.join(f'{c} IS NOT NULL' for c in need) or 'true'}" for n, need in predictors.PARTLY.items())
    ranks = ", ".join(f"{rank_sql(c, 'subset, repo')} AS {c}" for c in predictors.COLUMNS)
    core, many = ["churn", "hotspot", "size", "wmc"], ["churn", "hotspot", "size", "wmc", "entropy", "ndev"]
    names = ["impact", "fixes", *many]
    corr = lambda a, b: f"(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END)"
    of = lambda c: c if c in ("size", "wmc") else "all"
    least = lambda c: " AND n > 2" if c in predictors.EXTRA else ""
    rows = []
    for c in [*predictors.CORE, *predictors.EXTRA]:
        rows.append(f"SELECT 'spearman' AS metric, '{c}' AS predictor, '' AS control, {corr(c, 'fixes')} AS v FROM rk WHERE subset = '{of(c)}'{least(c)} GROUP BY repo")
    for x, z in [("impact", z) for z in ("churn", "hotspot", *predictors.EXTRA)] + [("impact_comp", "churn")]:
        rest = "(1 - xz * xz) * (1 - yz * yz)"
        rows.append(f"""SELECT 'partial', '{x}', '{z}', CASE WHEN {rest} > 1e-15 THEN (xy - xz * yz) / sqrt({rest}) END
FROM (SELECT {corr(x, 'fixes')} AS xy, {corr(x, z)} AS xz, {corr('fixes', z)} AS yz FROM rk WHERE subset = '{of(z)}'{least(z)} GROUP BY repo)""")
    for c in ("impact", "impact_comp", "churn", "hotspot", *predictors.EXTRA):
        rows.append(f"""SELECT 'auc', '{c}', '', CASE WHEN p > 0 AND p < n THEN (s - p * (p + 1) / 2.0) / (p * (n - p)) END
FROM (SELECT sum(label) AS p, count(*) AS n, sum({c}) FILTER (WHERE label = 1) AS s FROM rk WHERE subset = '{of(c)}' GROUP BY repo)""")
    for name, controls in (("multi_core", core), ("multi_all", many)):
        step, pivots = len(controls), " * ".join(f"(SELECT r FROM m{i} WHERE m{i}.repo = g.repo AND i = '{k}' AND j = '{k}')" for i, k in enumerate(controls))
        left = lambda i, j: f"(SELECT r FROM m{step} WHERE m{step}.repo = g.repo AND i = '{i}' AND j = '{j}')"  # noqa: B023, E731
        rows.append(f"""SELECT 'partial', 'impact', '{name}', CASE WHEN abs(det) >= 1e-12 AND a > 1e-12 AND b > 1e-12 THEN greatest(-1, least(1, ab / sqrt(a * b))) END
FROM (SELECT {pivots} AS det, {left('impact', 'impact')} AS a, {left('fixes', 'fixes')} AS b, {left('impact', 'fixes')} AS ab
  FROM (SELECT repo FROM rk WHERE subset = 'both' GROUP BY repo HAVING count(*) > {len(controls) + 3}) g)""")
    m0 = " UNION ALL ".join(f"SELECT repo, '{a}' AS i, '{b}' AS j, {corr(a, b)} AS r FROM rk WHERE subset = 'both' GROUP BY repo" for a in names for b in names)
    return f"""WITH {_MANY}, st AS ({sets}), rk AS (SELECT subset, repo, label, count(*) OVER (PARTITION BY subset, repo) AS n, {ranks} FROM st),
m0 AS ({m0}), {schur_sql(many, 'repo')}, al AS ({' UNION ALL '.join(rows)}), kn AS (SELECT metric, predictor, control, round(v, 6) AS v FROM al WHERE v IS NOT NULL)
SELECT metric, predictor, control, count(*) AS n_repos, count(*) FILTER (WHERE v > 0) AS n_positive, min(v) AS least, max(v) AS most, list_sort(list(v))[count(*) // 2 + 1] AS median FROM kn GROUP BY 1, 2, 3"""


# events and assignments are numbered in their order; a chain is walked from each assignment to its first parent
_CHAINS = """WITH RECURSIVE r AS (SELECT file_id, seq, path, max(status) AS status FROM file_changes WHERE file_id IS NOT NULL AND path <> '' AND seq IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT *, lag(path) OVER (PARTITION BY file_id ORDER BY seq, path) AS old FROM r),
e AS (SELECT seq, path, max(CASE WHEN status = 'R' AND old <> path THEN old END) AS rename_from FROM o GROUP BY 1, 2),
k AS (SELECT path, rename_from, row_number() OVER (ORDER BY seq, path) AS k FROM e),
a AS (SELECT * FROM k WHERE rename_from IS NOT NULL UNION SELECT * FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY path ORDER BY k) = 1)),
l AS (SELECT k, path, (SELECT max(b.k) FROM a b WHERE b.path = a.rename_from AND b.k < a.k) AS from_old, (SELECT max(b.k) FROM a b WHERE b.path = a.path AND b.k < a.k) AS from_own FROM a),
p AS (SELECT k, path, from_old IS NOT NULL AS renamed, coalesce(from_old, from_own, k) AS parent FROM l),
w AS (SELECT k, parent AS root FROM p UNION ALL SELECT w.k, p.parent FROM w JOIN p ON p.k = w.root WHERE p.parent <> w.root),
c AS (SELECT k, min(root) AS root, any_value(path) AS path, any_value(renamed) AS renamed FROM w JOIN p USING (k) GROUP BY 1),
d AS (SELECT k AS root, path AS first_path, row_number() OVER (ORDER BY k) AS id FROM c WHERE k = root)"""

ORACLE = {
    "container_wmc": f"WITH {_U} SELECT sha, file_id, container, CAST(sum(coalesce(cc, 0)) AS BIGINT) AS wmc FROM u GROUP BY 1, 2, 3",
    "wmc_after": f"WITH {_U} SELECT sha, file_id, unit, cc, CAST(greatest(sum(coalesce(cc, 0)) OVER (PARTITION BY sha, file_id, container) - coalesce(cc, 0), 0) AS BIGINT) AS wmc_after FROM u",
    "wmc_before": f"""WITH {_U}, {_PREV}, {_MATCH}, cw AS (SELECT sha, file_id, container, sum(coalesce(cc, 0)) AS wmc FROM u GROUP BY 1, 2, 3),
o AS (SELECT sha, file_id, unit, max(container) AS container FROM u GROUP BY 1, 2, 3)
SELECT o.sha, o.file_id, o.unit, CAST(greatest(coalesce(wmc, 0) - coalesce(prior_cc, 0), 0) AS BIGINT) AS wmc_before
FROM o JOIN pv USING (sha, file_id) JOIN mt USING (sha, file_id, unit) LEFT JOIN cw ON cw.sha = pv.prev_sha AND cw.file_id = o.file_id AND cw.container = o.container""",
    "name_match": f"WITH {_U}, {_PREV}, {_MATCH} SELECT * FROM mt",
    "change_kind": f"WITH {_U}, {_PREV}, {_MATCH} SELECT sha, file_id, unit, CASE WHEN prior_cc IS NULL THEN 'godclass' ELSE 'mutation' END AS kind_by_name FROM mt",
    "touched_units": f"""WITH {_U}, o AS (SELECT sha, file_id, unit, cc, (SELECT count(*) FROM range(cc, cc * 2 + 1) AS r(line) WHERE line >= wmc_other % 11 AND line < wmc_other % 11 + dlines) AS more
FROM u WHERE cc IS NOT NULL AND dlines IS NOT NULL AND wmc_other IS NOT NULL) SELECT sha, file_id, unit, cc, CAST(more AS INTEGER) AS more FROM o WHERE more > 0""",
    "file_impact": f"""WITH {_U} SELECT sha, file_id, CAST(coalesce(sum(cost) FILTER (WHERE kind <> 'godclass'), 0) AS BIGINT) AS mutation_cost, CAST(coalesce(sum(cost) FILTER (WHERE kind = 'godclass'), 0) AS BIGINT) AS godclass_cost,
count(*) FILTER (WHERE kind <> 'godclass') AS mut_fns, count(*) FILTER (WHERE kind = 'godclass') AS new_fns, count(*) FILTER (WHERE kind = 'rename') AS renames FROM u GROUP BY 1, 2""",
    "commit_impact": f"""SELECT *, (impact_mutation + impact_godclass) * files_changed AS impact_composite FROM (
SELECT sha, count(*) FILTER (WHERE path IS NOT NULL AND {_SOURCE} AND status IN ('A', 'M', 'R')) AS files_changed, CAST(sum(coalesce(mutation_cost, 0)) AS BIGINT) AS impact_mutation,
CAST(sum(coalesce(godclass_cost, 0)) AS BIGINT) AS impact_godclass FROM file_changes WHERE sha IS NOT NULL GROUP BY 1)""",
    "distinct_versions": f"""WITH u0 AS (SELECT * FROM unit_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL AND unit IS NOT NULL), lc AS (SELECT sha, seq FROM {LATEST}),
v AS (SELECT md5(concat_ws('|', unit, container, CAST(cc AS VARCHAR))) AS oid, seq, max(seq) OVER () / 2 AS m FROM u0 JOIN lc USING (sha))
SELECT DISTINCT oid FROM v WHERE seq > m AND oid NOT IN (SELECT oid FROM v WHERE seq <= m)""",
    "file_identity": f"{_CHAINS} SELECT c.path, d.id AS file_id FROM (SELECT path, arg_max(root, k) AS root FROM c GROUP BY 1) c JOIN d USING (root)",
    "canonical_paths": f"""{_CHAINS} SELECT id, coalesce(last_path, first_path) AS canonical_path
FROM d LEFT JOIN (SELECT root, arg_max(path, k) AS last_path FROM c WHERE renamed GROUP BY 1) USING (root)""",
    "commit_series": f"WITH {_SERIES} {_LONG}",
    "axis_scale": f"""WITH {_SERIES}, l AS ({_LONG}), p AS (SELECT metric, list_sort(list(value)) AS vs FROM l WHERE value > 0 GROUP BY 1)
SELECT l.metric, CASE WHEN max(value) / CAST(greatest(any_value(vs)[len(any_value(vs)) // 2 + 1], 1) AS DOUBLE) > 50 THEN 'log' ELSE 'linear' END AS scale FROM l LEFT JOIN p USING (metric) GROUP BY 1""",
    "downsample": f"""WITH {_SERIES}, n AS (SELECT count(*) FILTER (WHERE bug) AS reds, count(*) FILTER (WHERE NOT bug) AS blues FROM cs),
s AS (SELECT CASE WHEN reds >= 1000 OR blues <= 1000 - reds THEN 1 ELSE CAST(ceil(blues / CAST(1000 - reds AS DOUBLE)) AS BIGINT) END AS s FROM n)
SELECT idx, bug, impact_mutation AS value FROM cs WHERE bug
UNION ALL SELECT idx, bug, value FROM (SELECT idx, bug, impact_mutation AS value, row_number() OVER (ORDER BY idx) - 1 AS b FROM cs WHERE NOT bug), s WHERE b % s = 0""",
    "repo_splits": f"WITH {_REPOS}, {_RSPLIT} SELECT repo, split_ts FROM rs",
    "repo_ranking": f"""WITH {_REPOS}, {_RSPLIT}, c AS (SELECT f.*, repo, split_ts FROM file_changes f JOIN ids USING (file_id) LEFT JOIN rs USING (repo)),
f AS (SELECT repo, file_id, coalesce(bool_or(is_test), false) AS is_test, bool_or(lang <> '') AS named,
  coalesce(sum(mutation_cost) FILTER (WHERE split_ts IS NULL OR ts <= split_ts), 0) AS impact, coalesce(sum({_L}) FILTER (WHERE split_ts IS NULL OR ts <= split_ts), 0) AS churn,
  count(*) FILTER (WHERE is_fix AND (split_ts IS NULL OR ts > split_ts)) AS fixes FROM c GROUP BY 1, 2),
rk AS (SELECT repo, fixes, {rank_sql('impact', 'repo')} AS a, {rank_sql('churn', 'repo')} AS b, {rank_sql('fixes', 'repo')} AS d FROM f WHERE named AND NOT is_test),
co AS (SELECT repo, count(*) AS n_files, avg(CASE WHEN fixes > 0 THEN 1.0 ELSE 0.0 END) AS prevalence, corr(a, d) AS ad, corr(a, b) AS ab, corr(d, b) AS db FROM rk GROUP BY 1)
SELECT repo, n_files, round(prevalence, 6) AS prevalence, round(CASE WHEN isnan(ad) OR isnan(ab) OR isnan(db) OR (1 - ab * ab) * (1 - db * db) <= 1e-12 THEN NULL
  ELSE (ad - ab * db) / sqrt((1 - ab * ab) * (1 - db * db)) END, 6) AS partial_mut FROM co""",
    "chart_cells": f"""WITH {_SERIES}, l AS ({_LONG}), p AS (SELECT metric, list_sort(list(value)) AS vs FROM l WHERE value > 0 GROUP BY 1),
sc AS (SELECT l.metric, max(value) AS most, max(idx) + 1 AS total, CASE WHEN max(value) / CAST(greatest(any_value(vs)[len(any_value(vs)) // 2 + 1], 1) AS DOUBLE) > 50 THEN 'log' ELSE 'linear' END AS scale
  FROM l LEFT JOIN p USING (metric) GROUP BY 1),
ce AS (SELECT metric, scale, most, total, bug, least(floor(idx / CAST(total AS DOUBLE) * 240), 239) AS x,
  CASE WHEN most > 0 THEN greatest(0, least(floor(CASE WHEN scale = 'log' THEN ln(1 + value) / ln(1 + most) ELSE value / CAST(most AS DOUBLE) END * 48), 47)) ELSE 0 END AS y FROM l JOIN sc USING (metric))
SELECT metric, scale, most, total, bug, CAST(x AS INTEGER) AS "column", CAST(y AS INTEGER) AS "row", count(*) AS n FROM ce GROUP BY ALL""",
    "repo_precision": f"""WITH {_MANY}, u AS (SELECT repo, label, count(*) OVER (PARTITION BY repo) AS n, avg(label) OVER (PARTITION BY repo) AS base,
  row_number() OVER (PARTITION BY repo ORDER BY impact DESC, file_id) AS i, row_number() OVER (PARTITION BY repo ORDER BY churn DESC, file_id) AS j FROM pc),
ks AS (SELECT DISTINCT repo, k FROM (SELECT repo, unnest(CASE WHEN n < 10 THEN [greatest(1, n // 10)] WHEN n < 25 THEN [10] WHEN n < 50 THEN [10, 25] ELSE [10, 25, 50] END) AS k FROM u))
SELECT repo, CAST(k AS INTEGER) AS k, round(avg(label) FILTER (WHERE i <= k), 6) AS by_impact, round(avg(label) FILTER (WHERE j <= k), 6) AS by_churn,
  round(avg(label) FILTER (WHERE i <= k) / nullif(any_value(base), 0), 6) AS lift FROM u JOIN ks USING (repo) GROUP BY repo, k""",
    "cross_repo_summary": _summary_sql(),
}
