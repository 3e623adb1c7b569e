"""Turning a git repository into the stored relations, resumable."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import messages, paths
from lodestrata.operators import identity, impact
from lodestrata.session import cut
from lodestrata.sources import files, git
from lodestrata.sources.config import Config

TABLES = ["commits", "file_changes", "unit_changes", "bug_links", "file_ids", "file_alias"]


#: The progress file is updated, and what was read so far is stored, about so many times.
STEPS = 20
LINK = "fix_sha string, inducing_sha string, path string"


def _stored(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """What is stored of a relation that runs extend; empty before the first."""
    path = f"{out}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def _extend(spark: SparkSession, out: str, name: str, fresh: DataFrame, schema: str) -> DataFrame:
    fresh.write.mode("append").parquet(f"{out}/{name}.parquet")
    return spark.read.schema(schema).parquet(f"{out}/{name}.parquet")


def _check_context(spark: SparkSession, out: str, repo: str, wmc_context: str) -> None:
    """A history is scored in one way: another context than that of the stored rows is refused."""
    meta = files.read_text(spark, f"{out}/meta.json")
    if meta is None:
        files.write_text(spark, f"{out}/meta.json", json.dumps({"repo_path": repo, "wmc_context": wmc_context}))
    elif json.loads(meta)["wmc_context"] != wmc_context:
        raise ValueError(f"{out} was scored with wmc_context={json.loads(meta)['wmc_context']!r}")


def _read_diffs(spark: SparkSession, repo: str, out: str, log: DataFrame, progress: Callable[[int, int], None]) -> DataFrame:
    """The diffs of all commits of the log; those not stored yet are read and stored in STEPS ranges of their order."""
    todo = cut(log.join(_stored(spark, out, "diffed", "sha string"), "sha", "left_anti"))
    total, left = log.count(), todo.count()
    progress(total - left, total)
    if left:
        cuts = todo.agg(F.percentile_approx("seq", [i / STEPS for i in range(1, STEPS + 1)], 10_000).alias("cuts")).first().cuts
        done, below = total - left, -1
        for at in sorted(set(cuts)):
            part = todo.where((F.col("seq") > below) & (F.col("seq") <= at))
            _extend(spark, out, "file_diffs", git.file_diffs(part.repartition(spark.sparkContext.defaultParallelism, "sha"), repo), git.DIFF)
            _extend(spark, out, "diffed", part.select("sha"), "sha string")
            done, below = done + part.count(), at
            progress(done, total)
    # a run that broke off between the two writes has its commits' diffs twice
    return _stored(spark, out, "file_diffs", git.DIFF).dropDuplicates(["sha", "ordinal"])


def ingest(
    spark: SparkSession, repo: str, out: str, config: Config | None = None, *, since: str | None = None, until: str = "HEAD",
    max_count: int | None = None, want_units: bool = True, want_szz: bool = True, wmc_context: str = "before", progress_path: str | None = None,
) -> dict[str, DataFrame]:
    """Read a repository's history into Parquet relations under `out` and return them.

    What is costly to get, the diffs of each commit, the parsed contents of each blob and the authors of the lines
    each fix removed, is kept in relations of its own that a later run only extends: what is there is left out by
    anti-joins. All other relations are derived from these and written into a folder of this run; last of all
    the history's `current` file names that folder, so readers see one whole run. A progress file gets
    '<done> <total>' commits as their diffs are stored, and all of them only at the end of the run.
    """
    config = config or Config()
    _check_context(spark, out, repo, wmc_context)
    progress = lambda done, total: files.write_text(spark, progress_path, f"{done} {total}\n") if progress_path else None
    log = cut(git.read_log(spark, repo, since=since, until=until, max_count=max_count))
    flags = messages.classify(messages.message())
    commits = log.select("*", *[c.alias(n) for n, c in flags.items()], (F.size("parents") > 1).alias("is_merge"), F.get("parents", F.lit(0)).alias("parent"))

    # the last step is the run's end: scores and links are still to come when all diffs are there
    diffs = _read_diffs(spark, repo, out, log, lambda done, total: progress(min(done, max(total - 1, 0)), total))

    path = F.coalesce("new_path", "old_path", F.lit(""))
    source = paths.is_source("path", config.ignore, config.lang_by_ext) & ~F.col("is_binary")
    kept = diffs.withColumn("path", path).where(~F.col("is_binary") & ~paths.is_ignored("path", config.ignore)).join(commits.select("sha", "seq", "ts", "is_fix", "parent"), "sha")
    events = kept.select("seq", F.col("ordinal").cast("bigint").alias("ordinal"), "path", F.when(F.col("status") == "R", F.col("old_path")).alias("rename_from"))
    file_ids, file_alias = (cut(x) for x in identity.file_identity(events))
    # a path keeps its id unless a rename re-points it, so ids of the past are those of the paths' assignments
    chains = identity.assignments(events)
    ids = cut(_event_ids(events, chains, file_ids))
    rows = cut(kept.withColumn("is_source", source & F.col("status").isin("A", "M", "R")).join(ids, ["seq", "ordinal"]))

    scored = rows.where(F.col("is_source") & (F.col("add_total") + F.col("del_total") <= config.max_diff_lines))
    scored = scored.withColumns({"ext": paths.extension("path"), "old_ext": paths.extension(F.coalesce("old_path", "path"))})
    wanted = scored.select(F.col("new_oid").alias("oid"), "ext").unionByName(scored.where("status <> 'A'").select(F.col("old_oid").alias("oid"), F.col("old_ext").alias("ext"))).where("oid is not null").distinct()
    missing = wanted.join(_stored(spark, out, "blob_cache", git.BLOB).select("oid", "ext"), ["oid", "ext"], "left_anti")
    blobs = _extend(spark, out, "blob_cache", git.parse_blobs(missing, repo), git.BLOB)
    side = lambda oid, ext, p: blobs.select(F.col("oid").alias(oid), F.col("ext").alias(ext), F.col("units").alias(p), F.col("lines").alias(f"{p}_lines"))
    versions = scored.join(side("new_oid", "ext", "after"), ["new_oid", "ext"]).join(side("old_oid", "old_ext", "before"), ["old_oid", "old_ext"], "left")
    units = cut(impact.unit_impacts(versions, ["sha", "file_id", "ordinal"], wmc_context, config.rename_jaccard))
    per_file = impact.file_impact(units, ["sha", "file_id", "ordinal"])

    zero = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    changes = rows.join(per_file, ["sha", "file_id", "ordinal"], "left").select(
        "sha", "file_id", "path", F.coalesce(paths.language("path", config.lang_by_ext), F.lit("")).alias("lang"), "status", F.col("add_total").alias("add_lines"),
        F.col("del_total").alias("del_lines"), zero("mutation_cost"), zero("godclass_cost"), zero("mut_fns", "int"), zero("new_fns", "int"), zero("renames", "int"),
        paths.is_test("path", config.test_patterns).alias("is_test"), "ts", "is_fix", "seq", "is_source",
    )
    sums = changes.groupBy("sha").agg(*[F.sum(c).cast("int").alias(c) for c in ("mut_fns", "new_fns", "renames")])
    scores = impact.commit_impact(changes, F.col("is_source")).join(sums, "sha")
    full = commits.drop("parent").join(scores, "sha", "left").fillna(0, ["files_changed", "impact_mutation", "impact_godclass", "impact_composite", "mut_fns", "new_fns", "renames"])

    links = spark.createDataFrame([], "fix_sha string, inducing_sha string, file_id bigint")
    if want_szz:
        small = changes.where("is_source").groupBy("sha").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= config.szz_max_files).select("sha")
        fixes = rows.where("is_fix and size(removed) > 0 and parent is not null").where(paths.is_source("path", config.ignore, config.lang_by_ext)).join(small, "sha", "left_semi")
        asked = fixes.select("sha", "parent", F.coalesce("old_path", "path").alias("old_path"), "path", "removed", "file_id")
        known = _stored(spark, out, "line_authors", LINK)
        fresh = asked.join(known.select(F.col("fix_sha").alias("sha"), "path").distinct(), ["sha", "path"], "left_anti")
        authors = _extend(spark, out, "line_authors", git.blame_links(fresh, repo), LINK).where("inducing_sha is not null")
        ids_of = asked.select(F.col("sha").alias("fix_sha"), "path", "file_id").distinct()
        links = authors.join(ids_of, ["fix_sha", "path"]).select("fix_sha", "inducing_sha", "file_id").distinct()
    results = {
        "commits": full, "file_changes": changes.drop("renames", "is_source"), "bug_links": links, "file_ids": file_ids, "file_alias": file_alias,
        "unit_changes": (units if want_units else units.limit(0)).select("sha", "file_id", "unit", "container", "cc", "dlines", "wmc_other", "cost", "kind"),
    }
    run = f"run-{uuid.uuid4().hex}"
    for name, df in results.items():
        df.write.parquet(f"{out}/{run}/{name}.parquet")
    files.write_text(spark, f"{out}/{files.CURRENT}", run)
    total = log.count()
    progress(total, total)
    return {name: spark.read.parquet(f"{out}/{run}/{name}.parquet") for name in TABLES}


def _event_ids(events: DataFrame, chains: DataFrame, file_ids: DataFrame) -> DataFrame:
    """(seq, ordinal, file_id): the id that each event's path had at that time."""
    ids = chains.join(identity.root_ids(chains), "root").select(F.col("event").alias("parent"), "id")
    asked = events.select("path", F.struct("seq", "ordinal").alias("event"))
    return identity.latest_before(asked, chains.select("path", "event"), "path", same=True).join(ids, "parent").select("event.seq", "event.ordinal", F.col("id").alias("file_id"))
