"""Reports of a history: tables as files, statistics as JSON, a text report and charts.

Only results of bounded size reach the driver: statistics, top lists, and the filled cells of charts.
"""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import paths
from lodestrata.operators import charts, features, predictors, rankstats as rs, summary, szz
from lodestrata.session import cut
from lodestrata.sources import files, git

#: Cells of a chart, and the pixels of a cell.
COLUMNS, ROWS, CELL = 240, 48, 4


def number(value: float | None, digits: int = 3) -> str:
    return "n/a" if value is None or value != value else f"{value:.{digits}f}"


def human(value: float) -> str:
    """A number in thousands (k), millions (M) or billions (G) with one decimal, or whole."""
    thousands = min(3, int(math.log10(abs(value)) // 3)) if abs(value) >= 1000 else 0
    return f"{value / 1000**thousands:.1f}{'kMG'[thousands - 1]}" if thousands else f"{value:.0f}"


def statistics(matrix: DataFrame) -> dict[str, float | None]:
    """'metric/predictor/control' to value."""
    return {"/".join(x for x in (r.metric, r.predictor, r.control) if x): r.value for r in matrix.collect()}


def chart(metric: str, scale: str, most: float, total: int, cells: list[tuple[int, int, bool, int]]) -> str:
    """A heat map of (column, row, bug, n): history from left to right, values upwards; cells with bugs are red and the fuller the darker."""
    fullest = max((n for *_, n in cells), default=1)
    squares = []
    for column, row, bug, n in sorted(cells, key=lambda c: (c[2], c[0], c[1])):
        shade = 35 + round(60 * math.log1p(n) / math.log1p(fullest))
        squares.append(f'<rect class="{"bug" if bug else "other"}" x="{column * CELL}" y="{(ROWS - 1 - row) * CELL}" width="{CELL}" height="{CELL}" opacity=".{shade}"><title>{n}</title></rect>')
    caption = f"{html.escape(metric)}: {human(total)} commits, up to {human(most)} ({scale})"
    return f'<figure><svg viewBox="0 0 {COLUMNS * CELL} {ROWS * CELL}" xmlns="http://www.w3.org/2000/svg">{"".join(squares)}</svg><figcaption>{caption}</figcaption></figure>'


_STYLE = "figure{margin:1em 0}svg{width:100%;background:#f6f6f6}.bug{fill:#b00020}.other{fill:#34568b}"


def write_charts(commits: DataFrame, path: str, title: str) -> None:
    """One chart per metric of the commits, in one page. At most two squares for each cell of each chart are collected."""
    cells: dict[str, list] = {m: [] for m in charts.METRICS}
    facts = {m: ("linear", 0.0, 0) for m in charts.METRICS}
    for r in charts.chart_cells(cut(charts.commit_series(commits)), COLUMNS, ROWS).collect():
        cells[r.metric].append((r.column, r.row, r.bug, r.n))
        facts[r.metric] = (r.scale, float(r.most), r.total)
    page = [f"<!doctype html><meta charset='utf-8'><style>{_STYLE}</style><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    files.write_text(commits.sparkSession, path, "\n".join(page + [chart(m, *facts[m], cells[m]) for m in charts.METRICS]))


def chosen_ks(n: int) -> list[int]:
    """The list lengths that precision is reported for: those of 10, 25 and 50 that n files fill, else a tenth of the files."""
    return [k for k in (10, 25, 50) if k <= n] or ([max(1, n // 10)] if n else [])


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(str(c) for c in r) + " |" for r in rows], ""]


def state_at_split(spark: SparkSession, folder: str, h: dict[str, DataFrame], split_ts: int | None, repo: str | None) -> DataFrame:
    """(file_id, size, wmc) of the files at the split: from the tree of its last commit before it, or else from what the relations tell.

    The repository is asked if `repo` names one; contents that no commit scored, and so are not stored, are parsed.
    """
    relations = files.history_folder(spark, folder)
    before = h["commits"].where(F.lit(True) if split_ts is None else (F.col("ts") <= split_ts))
    last = before.orderBy(F.desc("seq")).select("sha").limit(1).collect() if repo else []
    if not last:
        return features.snapshot(h["file_changes"], h["unit_changes"], h["commits"], split_ts)
    tree = cut(git.tree_files(spark, repo, last[0].sha).where(paths.is_source("path")).select("oid", paths.extension("path").alias("ext")).distinct())
    blobs = spark.read.schema(git.BLOB).parquet(f"{folder}/blob_cache.parquet").select("oid", "ext", "units")
    parsed = git.parse_blobs(tree.join(blobs.select("oid", "ext"), ["oid", "ext"], "left_anti"), repo).select("oid", "ext", "units")
    return git.snapshot_state(spark, repo, last[0].sha, spark.read.parquet(f"{relations}/file_alias.parquet"), blobs.unionByName(parsed))


def analyze(
    spark: SparkSession, folder: str, out: str, *, split_ts: int | None = None, exclude_tests: bool = True, strict_split: bool = False, repo: str | None = None
) -> dict[str, float | None]:
    """Write files.csv, coupling.csv, stats.json, report.md and commits.html of a stored history; returns its statistics.

    `repo` is the repository that it was read from, if all executors reach it: sizes and complexities of files are then
    those of its tree at the split.
    """
    name = folder.rstrip("/").rpartition("/")[2]
    relations = files.history_folder(spark, folder)
    h = {n: spark.read.parquet(f"{relations}/{n}.parquet") for n in ("commits", "file_changes", "unit_changes", "bug_links", "file_ids")}
    feats = features.file_features(h["file_changes"], h["commits"], h["unit_changes"], h["file_ids"], split_ts, strict_split)
    universe = cut(features.universe(feats, exclude_tests))
    state = state_at_split(spark, folder, h, split_ts, repo)
    columns = cut(predictors.predictor_columns(universe, state, split_ts is not None))
    stats = statistics(predictors.predictor_matrix(columns))
    most = features.concentration(h["unit_changes"], h["commits"]).first()
    stats |= {"commits": float(most.n_commits), "max_cc": float(most.max_cc), "max_wmc": float(most.max_wmc)}
    listed = features.by_impact(universe)
    listed.select(features.LISTED).write.mode("overwrite").option("header", True).csv(f"{out}/files.csv")
    pairs = cut(features.coupling(h["file_changes"], h["file_ids"]))
    pairs.select("support", F.format_number("confidence", 2).alias("confidence"), "file_a", "file_b").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/coupling.csv")

    n = int(stats.get("n_files") or 0)
    ks = chosen_ks(n)
    base = stats.get("prevalence")
    lines = ["# Report", "", f"- files analysed: {n}; with a fix: {int(stats.get('n_buggy') or 0)} (prevalence {number(base)})", f"- outcome: {'fixes after the split' if split_ts is not None else 'all fixes, at the same time as the predictors'}", ""]
    signals = [*predictors.CORE, *predictors.EXTRA]
    lines += ["## Signals and fixes", ""] + _table(["signal", "Spearman", "AUC"], [[s, number(stats.get(f"spearman/{s}")), number(stats.get(f"auc/{s}"))] for s in signals])
    controls = ["churn", "hotspot", *predictors.EXTRA, "multi_core", "multi_all"]
    lines += ["## Impact given other signals", ""] + _table(["control", "partial"], [[c, number(stats.get(f"partial/impact/{c}"))] for c in controls])
    best = []
    found = {(r.k, r.score): r.value for r in rs.precisions(columns, ["impact", "churn"], "label", "file_id", ks).collect()} if ks else {}
    for k in ks:
        p, q = found[k, "impact"], found[k, "churn"]
        best.append([k, number(p), number(q), number(p / base if p is not None and base else None)])
    lines += ["## Precision at k", ""] + _table(["k", "by impact", "by churn", "lift"], best)
    top = listed.limit(20).collect()
    lines += ["## Files of the largest impact", ""] + _table(["impact", "churn", "commits", "max cc", "fixes", "file"], [[r.impact_mut, r.churn, r.n_commits, r.max_cc, r.fix_after if split_ts is not None else r.fix_all, r.path] for r in top])
    found = pairs.orderBy(F.desc("support"), F.desc("confidence"), F.desc("file_a"), F.desc("file_b")).limit(15).collect()
    if found:
        lines += ["## Files that change together", ""] + _table(["support", "confidence", "file", "file"], [[r.support, number(r.confidence, 2), r.file_a, r.file_b] for r in found])
    counts = szz.szz_counts(h["commits"], h["bug_links"]).first()
    if counts.n_inducing:
        commits = cut(szz.commit_features(h["commits"], h["file_changes"], h["unit_changes"], h["bug_links"]))
        linked = statistics(szz.szz_statistics(commits))
        quarters = [number(r.rate) for r in szz.induce_rate_by_quarter(commits).orderBy("quarter").collect()]
        lines += ["## Commits that induce fixes", "", f"- inducing commits: {counts.n_inducing}, of which {counts.n_matched} are in the history; linked fixes: {counts.n_linked_fixes}", ""]
        lines += _table(["statistic", "value"], [[k, number(v)] for k, v in linked.items()]) + _table(["Q1", "Q2", "Q3", "Q4"], [quarters])
        stats |= {f"szz/{k}": v for k, v in linked.items()} | {"szz/n_inducing": counts.n_inducing}
    write_charts(h["commits"], f"{out}/commits.html", name)
    files.write_text(spark, f"{out}/report.md", "\n".join(lines))
    files.write_text(spark, f"{out}/stats.json", json.dumps({"name": name, "split_ts": split_ts, "stats": stats}))
    return stats


STATS_JSON = "name string, split_ts bigint, stats map<string,double>"
# The columns of summary.csv, each with the statistic that it shows.
SUMMARY_COLUMNS = {
    "commits": "commits", "files": "n_files", "prevalence": "prevalence", "partial_mut": "partial/impact/churn", "partial_comp": "partial/impact_comp/churn",
    "partial_hot": "partial/impact/hotspot", "partial_size": "partial/impact/size", "partial_wmc": "partial/impact/wmc", "partial_entropy": "partial/impact/entropy",
    "partial_ndev": "partial/impact/ndev", "partial_pfix": "partial/impact/prior_fixes", "partial_multi_core": "partial/impact/multi_core",
    "partial_multi_all": "partial/impact/multi_all", "sp_mut": "spearman/impact", "sp_churn": "spearman/churn", "auc_mut": "auc/impact", "auc_churn": "auc/churn",
    "auc_hotspot": "auc/hotspot", "szz_auc_mut": "szz/auc/mutation", "szz_auc_comp": "szz/auc/composite", "szz_auc_churn": "szz/auc/churn",
    "szz_partial_comp": "szz/partial/composite/churn", "szz_partial_mut": "szz/partial/mutation/churn", "szz_multi_core": "szz/partial/composite/multi_core",
    "szz_multi_all": "szz/partial/composite/multi_all", "n_inducing": "szz/n_inducing", "max_cc": "max_cc", "max_wmc": "max_wmc",
}
# Those of them that summary.md has in its table.
TABLE_COLUMNS = [
    "commits", "files", "prevalence", "partial_mut", "partial_comp", "partial_hot", "sp_mut", "sp_churn", "auc_mut", "auc_churn", "szz_auc_comp",
    "szz_auc_churn", "szz_partial_comp", "max_cc", "max_wmc",
]
_WHOLE = {"commits", "files", "n_inducing", "max_cc", "max_wmc"}
#: Rows of the table in summary.md; summary.csv has all.
MOST_LISTED = 1_000


def summary_rows(stats: DataFrame) -> DataFrame:
    """(repo, SUMMARY_COLUMNS) of statistics (repo, key, value); inducing commits are 0 where there are no links."""
    values = [F.max(F.when(F.col("key") == key, F.col("value"))).alias(c) for c, key in SUMMARY_COLUMNS.items()]
    wide = stats.groupBy("repo").agg(*values).fillna(0.0, ["n_inducing"])
    return wide.select("repo", *[F.col(c).cast("bigint").alias(c) if c in _WHOLE else F.round(c, 3).alias(c) for c in SUMMARY_COLUMNS])


def summarize(spark: SparkSession, pattern: str, out: str) -> DataFrame:
    """summary.csv and summary.md of many reports: a row per history, by its partial correlation, and medians over all. Returns the rows."""
    reports = spark.read.schema(STATS_JSON).json(pattern, multiLine=True)
    long = cut(reports.select(F.col("name").alias("repo"), F.explode("stats").alias("key", "value")))
    part = lambda i: F.coalesce(F.get(F.split("key", "/"), F.lit(i)), F.lit(""))
    over = summary.cross_repo_summary(long.select("repo", part(0).alias("metric"), part(1).alias("predictor"), part(2).alias("control"), "value").where("metric <> 'szz'"))
    rows = cut(summary_rows(long)).orderBy(F.desc_nulls_last("partial_mut"), "repo")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/summary.csv")
    lines = ["# Summary", "", f"- repositories: {rows.count()}", ""]
    lines += _table(["statistic", "positive", "median", "least", "most"], [["/".join(x for x in (r.metric, r.predictor, r.control) if x), f"{r.n_positive}/{r.n_repos}", number(r.median), number(r.least), number(r.most)] for r in over.orderBy("metric", "predictor", "control").collect()])
    shown = lambda r, c: ("n/a" if r[c] is None else str(r[c])) if c in _WHOLE else number(r[c])
    lines += _table(["repo", *TABLE_COLUMNS], [[r.repo, *[shown(r, c) for c in TABLE_COLUMNS]] for r in rows.limit(MOST_LISTED).collect()])
    files.write_text(spark, f"{out}/summary.md", "\n".join(lines))
    return rows
