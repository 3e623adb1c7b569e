"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm import codefiles, cooccurrence, names, packing, spampages, tokens
from lodestrata.session import cut
from lodestrata.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return codefiles.unwritten_files(table(spark, folder, "file_changes")).select("path")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.signature_pairs(p2_people(spark, folder))


def p2_people(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_people(table(spark, folder, "commits"), table(spark, folder, "given_names"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_cooccurrence(spark, folder).select("file_a", "file_b")


def p3_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.cooccurrence(table(spark, folder, "file_changes"), "sha", "file_id")
    return pairs.withColumnsRenamed({"item_a": "file_a", "item_b": "file_b"})


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), tokens.rank_file(spark))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode(p6_ids(spark, folder), tokens.rank_file(spark))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(tokens.count_tokens(table(spark, folder, "documents"), tokens.rank_file(spark)))
    capacities = [(r.pack_name, r.capacity) for r in table(spark, folder, "pack_sizes").select("pack_name", "capacity").distinct().collect()]
    return packing.pack_items(sizes, sorted(capacities))


def p7_packs(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_packed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spampages.spam_pages(table(spark, folder, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_people": p2_people,
    "p3_found": p3_found,
    "p3_cooccurrence": p3_cooccurrence,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_packs": p7_packs,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
}

_P3 = """
WITH e AS (SELECT DISTINCT sha, file_id FROM file_changes WHERE sha IS NOT NULL AND file_id IS NOT NULL),
n AS (SELECT file_id, count(*) AS k FROM e GROUP BY 1),
t AS (SELECT count(DISTINCT sha) AS n_baskets FROM file_changes),
p AS (SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS n_ab
      FROM e a JOIN e b ON a.sha = b.sha AND a.file_id < b.file_id GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT file_a, file_b, n_ab, x.k AS n_a, y.k AS n_b, n_baskets, CAST(n_ab AS DOUBLE) * n_baskets / (CAST(x.k AS DOUBLE) * y.k) AS lift
      FROM p JOIN n x ON x.file_id = file_a JOIN n y ON y.file_id = file_b, t
      WHERE n_ab >= 0.5 * least(x.k, y.k) AND n_ab * n_baskets >= 3 * x.k * y.k)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT file_a, file_b FROM r",
    "p3_cooccurrence": _P3 + "SELECT * FROM r",
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
