"""Queries on paths, messages and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import messages, paths, units
from lodestrata.operators import features
from lodestrata.tables import table


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_changes").where("path is not null").select("path").distinct()


def path_extension(spark, folder):
    return _paths(spark, folder).select("path", paths.extension("path").alias("extension"))


def language_label(spark, folder):
    return _paths(spark, folder).select("path", paths.language("path").alias("language"))


def ignore_filter(spark, folder):
    return _paths(spark, folder).where(paths.is_ignored("path"))


def test_path_flag(spark, folder):
    return _paths(spark, folder).select("path", paths.is_test("path").alias("is_test_path"))


def source_filter(spark, folder):
    return _paths(spark, folder).where(paths.is_source("path"))


def eligible_changes(spark, folder):
    """Changes that are scored: source files added, modified or renamed, of at most 200,000 lines."""
    rows = table(spark, folder, "file_changes")
    return rows.where(paths.is_source("path") & F.col("status").isin("A", "M", "R") & (features.lines() <= 200_000)).select("sha", "path", "status", features.lines().alias("churn"))


def classify_messages(spark, folder):
    flags = messages.classify(messages.message())
    return table(spark, folder, "commits").select("sha", "seq", *[c.alias(f"msg_{n}") for n, c in flags.items() if n != "issue_refs"])


def issue_refs(spark, folder):
    refs = messages.issue_references(messages.message())
    return table(spark, folder, "commits").select("sha", "seq", F.posexplode(refs).alias("place", "reference")).withColumn("place", F.col("place").cast("bigint"))


def container_of(spark, folder):
    return table(spark, folder, "unit_changes").where("unit is not null").select("unit").distinct().withColumn("holder", units.container(F.col("unit")))


def _header():
    return F.concat(F.lit("@@ -"), F.col("seq"), F.when(F.col("del_lines") != 1, F.concat(F.lit(","), F.col("del_lines"))).otherwise(F.lit("")), F.lit(" +"), F.col("seq"), F.lit(","), F.col("add_lines"), F.lit(" @@ "), F.col("path"))


def hunk_ranges(spark, folder):
    """Hunk headers made of the stored line counts, read back."""
    rows = table(spark, folder, "file_changes").where("seq is not null and add_lines is not null and del_lines is not null and path is not null")
    parts = units.hunk_ranges(F.col("header"))
    return rows.select("sha", "path", _header().alias("header")).select("sha", "path", *[c.alias(n) for n, c in parts.items()])


def range_overlap(spark, folder):
    """Overlap of a unit's span with two disjoint ranges, all laid out from the unit's stored measures."""
    rows = table(spark, folder, "unit_changes").where("cc is not null and dlines is not null and wmc_other is not null")
    span = F.col("cc"), F.col("cc") + F.col("dlines")
    ranges = F.array(
        F.struct(F.lit(1).alias("start"), (F.col("wmc_other") % 7 + 1).cast("int").alias("count")),
        F.struct((F.col("wmc_other") % 7 + 4).cast("int").alias("start"), (F.col("dlines") % 9).cast("int").alias("count")),
    )
    return rows.select("sha", "unit", "cc", "dlines", "wmc_other", units.range_overlap(*span, ranges).alias("overlap"))


def token_set(spark, folder):
    rows = features.latest_commits(table(spark, folder, "commits"))
    return rows.select("sha", F.array_sort(units.token_set(F.col("subject"))).alias("tokens"))


def token_jaccard(spark, folder):
    rows = features.latest_commits(table(spark, folder, "commits"))
    return rows.select("sha", F.round(units.jaccard(units.token_set(F.col("subject")), units.token_set(F.col("body"))), 9).alias("similarity"))


def unit_cost(spark, folder):
    rows = table(spark, folder, "unit_changes")
    return rows.select("sha", "file_id", "unit", units.unit_cost(F.col("wmc_other"), F.col("cc"), F.col("dlines")).alias("computed_cost"), "cost")


QUERIES = {
    f.__name__: f
    for f in (
        path_extension, language_label, ignore_filter, test_path_flag, source_filter, eligible_changes, classify_messages, issue_refs,
        container_of, hunk_ranges, range_overlap, token_set, token_jaccard, unit_cost,
    )
}

_EXT = "CASE WHEN strpos(path, '.') > 0 THEN lower('.' || string_split(path, '.')[-1]) ELSE '' END"
_LANGUAGE = (
    "CASE ext " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in paths.EXTENSION_LANGUAGES.items()) + " END"
)


def _like(glob: str) -> str:
    pattern = glob.replace("**", "*").replace("_", "\\_").replace("*", "%")
    return f"path LIKE '{pattern}' ESCAPE '\\'"


_IGNORED = "(" + " OR ".join(_like(g) for g in [*paths.IGNORE_GLOBS, *[g[3:] for g in paths.IGNORE_GLOBS]]) + ")"
_TEST = "(" + " OR ".join(_like(g) for g in paths.TEST_GLOBS) + ")"
_SOURCE = f"(NOT {_IGNORED} AND {_EXT} IN ({', '.join(repr(e) for e in paths.EXTENSION_LANGUAGES)}))"
_DISTINCT = "(SELECT DISTINCT path FROM file_changes WHERE path IS NOT NULL)"
_MESSAGE = "regexp_replace(coalesce(subject, '') || chr(10) || coalesce(body, ''), '^\\s+|\\s+$', '', 'g')"
_FIX = f"regexp_matches(m, '(?i)\\b({'|'.join(messages.FIX_WORDS)})\\b')"
_REVERT = f"regexp_matches(m, '(?i)\\b({'|'.join(messages.REVERT_WORDS)})\\b')"
_REFS = "regexp_extract_all(m, '#([0-9]+)|\\b[A-Z][A-Z0-9]+-[0-9]+\\b', 1)"
_TOKENS = "list_distinct(regexp_extract_all(coalesce({}, ''), '[A-Za-z_][A-Za-z0-9_]*'))"
LATEST = """(SELECT * FROM commits WHERE sha IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sha ORDER BY ingested_at DESC NULLS LAST, seq DESC NULLS LAST) = 1)"""

ORACLE = {
    "path_extension": f"SELECT path, {_EXT} AS extension FROM {_DISTINCT}",
    "language_label": f"SELECT path, {_LANGUAGE} AS language FROM (SELECT path, {_EXT} AS ext FROM {_DISTINCT})",
    "ignore_filter": f"SELECT path FROM {_DISTINCT} WHERE {_IGNORED}",
    "test_path_flag": f"SELECT path, {_TEST} AS is_test_path FROM {_DISTINCT}",
    "source_filter": f"SELECT path FROM {_DISTINCT} WHERE {_SOURCE}",
    "eligible_changes": f"""SELECT sha, path, status, CAST(coalesce(add_lines, 0) + coalesce(del_lines, 0) AS BIGINT) AS churn FROM file_changes
WHERE {_SOURCE} AND status IN ('A', 'M', 'R') AND coalesce(add_lines, 0) + coalesce(del_lines, 0) <= 200000""",
    "classify_messages": f"""SELECT sha, seq, {_FIX} OR {_REVERT} AS msg_is_fix, {_REVERT} AS msg_is_revert, len({_REFS}) > 0 AS msg_has_issue_ref,
{_FIX} AS msg_has_keyword FROM (SELECT sha, seq, {_MESSAGE} AS m FROM commits)""",
    "issue_refs": f"""SELECT sha, seq, CAST(generate_subscripts(refs, 1) - 1 AS BIGINT) AS place, coalesce(unnest(refs), '') AS reference
FROM (SELECT sha, seq, {_REFS} AS refs FROM (SELECT sha, seq, {_MESSAGE} AS m FROM commits))""",
    "container_of": "SELECT DISTINCT unit, CASE WHEN strpos(unit, '::') > 0 THEN array_to_string(string_split(unit, '::')[1:-2], '::') ELSE '' END AS holder FROM unit_changes WHERE unit IS NOT NULL",
    "hunk_ranges": """SELECT sha, path, CAST(seq AS INTEGER) AS old_start, del_lines AS old_count, CAST(seq AS INTEGER) AS new_start, add_lines AS new_count
FROM file_changes WHERE seq IS NOT NULL AND add_lines IS NOT NULL AND del_lines IS NOT NULL AND path IS NOT NULL""",
    "range_overlap": """SELECT sha, unit, cc, dlines, wmc_other, CAST(
  (SELECT count(*) FROM range(cc, cc + dlines + 1) AS r(line) WHERE (line >= 1 AND line < 1 + wmc_other % 7 + 1)
   ) + (SELECT count(*) FROM range(cc, cc + dlines + 1) AS r(line) WHERE (line >= wmc_other % 7 + 4 AND line < wmc_other % 7 + 4 + dlines % 9)) AS INTEGER) AS overlap
FROM unit_changes WHERE cc IS NOT NULL AND dlines IS NOT NULL AND wmc_other IS NOT NULL""",
    "token_set": f"SELECT sha, list_sort({_TOKENS.format('subject')}) AS tokens FROM {LATEST}",
    "token_jaccard": f"""SELECT sha, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 9) AS similarity
FROM (SELECT sha, {_TOKENS.format('subject')} AS a, {_TOKENS.format('body')} AS b FROM {LATEST})""",
    "unit_cost": "SELECT sha, file_id, unit, CAST(greatest(wmc_other, 1) AS BIGINT) * cc * dlines AS computed_cost, cost FROM unit_changes",
}
