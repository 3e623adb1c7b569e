"""Queries of the streaming operators over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.streaming import changes
from lodestrata.tables import table


def daily_churn(spark, folder):
    return changes.daily_churn(table(spark, folder, "file_changes"))


def resume_commits(spark, folder):
    """The commits that a run would still have to read if those of the first half were stored."""
    commits = table(spark, folder, "commits").where("sha is not null")
    middle = commits.agg((F.max("seq") / 2).alias("m")).scalar()
    parted = commits.withColumn("m", middle)
    return changes.new_rows(parted.select("sha"), parted.where("seq <= m").select("sha"), ["sha"])


QUERIES = {"daily_churn": daily_churn, "resume_commits": resume_commits}
ORACLE = {
    "daily_churn": """SELECT strftime(ingested_at, '%Y-%m-%d') AS day, count(*) AS n_changes, CAST(sum(coalesce(add_lines, 0) + coalesce(del_lines, 0)) AS BIGINT) AS churn
FROM file_changes WHERE ingested_at IS NOT NULL GROUP BY 1""",
    "resume_commits": """WITH m AS (SELECT max(seq) / 2 AS m FROM commits WHERE sha IS NOT NULL)
SELECT DISTINCT sha FROM commits WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM commits, m WHERE seq <= m AND sha IS NOT NULL)""",
}
