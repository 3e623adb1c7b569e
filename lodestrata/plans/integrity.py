"""Queries on skew and on references: p4 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import orphans, skew
from lodestrata.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        skew.heavy_keys(table(spark, folder, name), "file_id", spec["spread"]).select(F.lit(name).alias("table_name"), "file_id")
        for name, spec in skew.FILE_TABLES.items()
    ]
    return parts[0].unionByName(parts[1])


def p4_file_totals(spark: SparkSession, folder: str) -> DataFrame:
    parts = [skew.file_totals(table(spark, folder, name), name).drop("n_salts") for name in skew.FILE_TABLES]
    return parts[0].unionByName(parts[1])


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.history_references(table(spark, folder, "bug_links"), table(spark, folder, "file_changes"))
    return refs, orphans.history_targets(table(spark, folder, "commits"), table(spark, folder, "file_ids"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_keys(*_sides(spark, folder))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(*_sides(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_file_totals": p4_file_totals, "p5_found": p5_found, "p5_report": p5_report}

_ORPHANS = """
WITH refs AS (
  SELECT 'bug_links' AS table_name, 'fix_sha' AS column_name, 'sha' AS kind,
         lower(trim(fix_sha, ' ' || chr(9) || chr(10) || chr(13))) AS ref_key, ingested_at AS at
  FROM bug_links WHERE fix_sha IS NOT NULL
  UNION ALL
  SELECT 'bug_links', 'inducing_sha', 'sha', lower(trim(inducing_sha, ' ' || chr(9) || chr(10) || chr(13))), ingested_at
  FROM bug_links WHERE inducing_sha IS NOT NULL
  UNION ALL
  SELECT 'file_changes', 'file_id', 'id', CAST(file_id AS VARCHAR), ingested_at
  FROM file_changes WHERE file_id IS NOT NULL
), targets AS (
  SELECT 'sha' AS kind, lower(trim(sha, ' ' || chr(9) || chr(10) || chr(13))) AS ref_key,
         min(ingested_at) AS born, max(removed_at) AS gone
  FROM commits GROUP BY 1, 2
  UNION ALL
  SELECT 'id', CAST(id AS VARCHAR), min(ingested_at), max(removed_at) FROM file_ids GROUP BY 1, 2
), judged AS (
  SELECT r.*, strftime(r.at, '%Y-%m') AS period,
         t.born IS NULL OR r.at < t.born OR coalesce(r.at >= t.gone, false) AS missing
  FROM refs r LEFT JOIN targets t ON r.kind = t.kind AND r.ref_key = t.ref_key
  WHERE r.at IS NOT NULL
)
"""

ORACLE = {
    "p4_found": """
SELECT 'file_changes' AS table_name, file_id FROM file_changes WHERE file_id IS NOT NULL GROUP BY file_id
HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM file_changes)
UNION ALL
SELECT 'unit_changes' AS table_name, file_id FROM unit_changes WHERE file_id IS NOT NULL GROUP BY file_id
HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM unit_changes)""",
    "p4_file_totals": """
SELECT 'file_changes' AS table_name, file_id, count(*) AS n_rows, count(DISTINCT sha) AS n_commits,
       CAST(sum(coalesce(add_lines, 0) + coalesce(del_lines, 0)) AS BIGINT) AS amount,
       CAST(max(coalesce(add_lines, 0) + coalesce(del_lines, 0)) AS BIGINT) AS largest
FROM file_changes GROUP BY file_id
UNION ALL
SELECT 'unit_changes', file_id, count(*), count(DISTINCT sha), CAST(sum(coalesce(cost, 0)) AS BIGINT), max(coalesce(cost, 0))
FROM unit_changes GROUP BY file_id""",
    "p5_found": _ORPHANS + "SELECT DISTINCT table_name, column_name, ref_key, period FROM judged WHERE missing",
    "p5_report": _ORPHANS + """
SELECT table_name, column_name, period, count(*) AS n_refs, count(*) FILTER (WHERE missing) AS n_orphans,
       count(DISTINCT ref_key) FILTER (WHERE missing) AS n_orphan_keys
FROM judged GROUP BY 1, 2, 3""",
}
