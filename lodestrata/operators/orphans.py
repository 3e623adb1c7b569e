"""References whose target was not there when the referring row arrived."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

PARENT, REFERENCE = 0, 1
_KEYS = ["table_name", "column_name", "ref_key", "period"]


def sha_key(column: str) -> Column:
    """Letter case and surrounding blanks carry no meaning in a sha."""
    return F.lower(F.btrim(F.col(column), F.lit(" \t\r\n")))


def _references(rows: DataFrame, table_name: str, column: str, kind: str, key: Column) -> DataFrame:
    at = F.col("ingested_at")
    return rows.where(F.col(column).isNotNull() & at.isNotNull()).select(
        F.lit(table_name).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(kind).alias("kind"),
        key.alias("ref_key"),
        F.substring(at.cast("timestamp_ntz").cast("string"), 1, 7).alias("period"),
        at.cast("timestamp_ntz").alias("at"),
    )


def history_references(bug_links: DataFrame, file_changes: DataFrame) -> DataFrame:
    """All references of a history: both sides of bug links to commits, file changes to file ids."""
    return (
        _references(bug_links, "bug_links", "fix_sha", "sha", sha_key("fix_sha"))
        .unionByName(_references(bug_links, "bug_links", "inducing_sha", "sha", sha_key("inducing_sha")))
        .unionByName(_references(file_changes, "file_changes", "file_id", "id", F.col("file_id").cast("string")))
    )


def history_targets(commits: DataFrame, file_ids: DataFrame) -> DataFrame:
    """All targets of a history with the time they came and the time they went."""

    def of(rows: DataFrame, kind: str, key: Column) -> DataFrame:
        return rows.where(key.isNotNull()).select(
            F.lit(kind).alias("kind"),
            key.alias("ref_key"),
            F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"),
            F.col("removed_at").cast("timestamp_ntz").alias("removed_at"),
        )

    return of(commits, "sha", sha_key("sha")).unionByName(of(file_ids, "id", F.col("id").cast("string")))


_PROBED = (
    "table_name string, column_name string, ref_key string, period string, first_at timestamp_ntz, "
    "last_at timestamp_ntz, n_refs bigint, target_from timestamp_ntz, target_to timestamp_ntz, found boolean"
)


def _sortable(keys: pa.Array) -> np.ndarray:
    """Keys as fixed-width bytes, which numpy searches fastest; very long keys or ones with NUL as objects."""
    if len(keys) and (pc.max(pc.binary_length(keys)).as_py() > 96 or pc.any(pc.match_substring(keys, "\0")).as_py()):
        return np.array([k.encode() for k in keys.to_pylist()], dtype=object)
    return np.array(keys.cast(pa.binary()).to_pylist(), dtype="S") if len(keys) else np.array([], dtype="S1")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's targets come first and in order; each batch of references is searched in their sorted array."""
    kept: list[pa.RecordBatch] = []
    targets: pa.Table | None = None
    keys = np.array([], dtype="S1")
    for batch in batches:
        tag = batch.column("tag")
        kept.append(batch.filter(pc.equal(tag, PARENT)).select(["key", "first_at", "last_at"]))
        refs = batch.filter(pc.equal(tag, REFERENCE))
        if not refs.num_rows:
            continue
        if targets is None:
            targets = pa.Table.from_batches(kept).combine_chunks()
            column = targets.column("key").combine_chunks()
            keys = _sortable(column if isinstance(column, pa.Array) else pa.array([], pa.string()))
        wanted = _sortable(refs.column("key"))
        if keys.dtype != object and wanted.dtype == object:
            wanted_in = np.array([w if len(w) <= 96 and b"\0" not in w else b"\xff" for w in wanted], dtype="S97")
        else:
            wanted_in = wanted.astype(object) if keys.dtype == object else wanted
        place = np.searchsorted(keys, wanted_in)
        inside = np.minimum(place, max(len(keys) - 1, 0))
        hit = (keys[inside] == wanted_in) if len(keys) else np.zeros(len(wanted), bool)
        take = pa.array(inside.astype("int64"), mask=~np.asarray(hit, bool))
        yield pa.RecordBatch.from_arrays(
            [refs.column(c) for c in ("table_name", "column_name", "ref_key", "period", "first_at", "last_at", "n_refs")]
            + [_flat(targets.column("first_at").take(take)), _flat(targets.column("last_at").take(take)), pa.array(np.asarray(hit, bool))],
            names=["table_name", "column_name", "ref_key", "period", "first_at", "last_at", "n_refs", "target_from", "target_to", "found"],
        )


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def probe_references(references: DataFrame, targets: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each (table, column, key, period) of the references beside the life of its target.

    References are first reduced to their earliest and latest arrival and their number, so a key that a third of
    all rows refer to is one row per column and month afterwards. Targets are reduced to one row per key. Both
    are then cut into the same key ranges; within a range the targets form sorted arrays, and the references
    stream past them in batches that are probed by binary search. `ranges` defaults to the session's number of
    shuffle partitions, so a range's arrays shrink as that number grows with the data.
    """
    key = F.concat("kind", F.lit("|"), "ref_key").alias("key")
    refs = references.groupBy("kind", *_KEYS).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_refs")
    )
    lives = targets.groupBy("kind", "ref_key").agg(
        F.min("ingested_at").alias("first_at"), F.max("removed_at").alias("last_at")
    )
    nothing = F.lit(None).cast("string")
    both = lives.select(
        F.lit(PARENT).alias("tag"), key, nothing.alias("table_name"), nothing.alias("column_name"),
        nothing.alias("ref_key"), nothing.alias("period"), "first_at", "last_at", F.lit(None).cast("bigint").alias("n_refs"),
    ).unionByName(refs.select(F.lit(REFERENCE).alias("tag"), key, *_KEYS, "first_at", "last_at", "n_refs"))
    split = both.repartitionByRange(ranges, "key") if ranges else both.repartitionByRange("key")
    return split.sortWithinPartitions("tag", "key").mapInArrow(_probe, _PROBED)


def _verdicts(probed: DataFrame) -> DataFrame:
    born, gone = F.col("target_from"), F.col("target_to")
    never = ~F.col("found") | born.isNull()
    return (
        probed.withColumn("never", never)
        .withColumn("any_early", F.coalesce(F.col("first_at") < born, F.lit(False)))
        .withColumn("any_late", F.coalesce(F.col("last_at") >= gone, F.lit(False)))
        .withColumn("all_missing", never | F.coalesce(F.col("last_at") < born, F.lit(False)) | F.coalesce(F.col("first_at") >= gone, F.lit(False)))
        .withColumn("any_missing", F.col("never") | F.col("any_early") | F.col("any_late"))
    )


def orphan_keys(references: DataFrame, targets: DataFrame, ranges: int | None = None) -> DataFrame:
    """The distinct (table_name, column_name, ref_key, period) of references to missing targets.

    A target exists from the earliest `ingested_at` of its rows (inclusive) to its `removed_at` (exclusive; of
    differing values the latest). A target without any arrival time never exists. A null reference is none, and a
    row without arrival time cannot be judged: both are left out. An empty sha after trimming is a reference like
    any other. Empty tables are allowed on either side.
    """
    return _verdicts(probe_references(references, targets, ranges)).where("any_missing").select(*_KEYS)


def orphan_report(references: DataFrame, targets: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per table, column and month: n_refs, n_orphans (referring rows) and n_orphan_keys (distinct keys).

    Only months in which a target comes or goes hold both good and bad references; their rows alone are looked
    at again, one by one. All other groups are counted from their summary.
    """
    judged = _verdicts(probe_references(references, targets, ranges))
    whole = judged.select(
        *_KEYS, "n_refs", F.col("any_missing").cast("bigint").alias("orphan_key"),
        F.when(F.col("all_missing"), F.col("n_refs")).otherwise(F.lit(0)).alias("orphans"),
    )
    split = judged.where("any_missing and not all_missing").select(*_KEYS, "target_from", "target_to")
    again = (
        references.join(split, _KEYS)
        .where((F.col("at") < F.col("target_from")) | F.coalesce(F.col("at") >= F.col("target_to"), F.lit(False)))
        .groupBy(*_KEYS[:2], "period")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )
    return (
        whole.groupBy("table_name", "column_name", "period")
        .agg(F.sum("n_refs").alias("n_refs"), F.sum("orphans").alias("orphans"), F.sum("orphan_key").alias("n_orphan_keys"))
        .unionByName(again.select("table_name", "column_name", "period", F.lit(0).cast("bigint").alias("n_refs"), "orphans", F.lit(0).cast("bigint").alias("n_orphan_keys")))
        .groupBy("table_name", "column_name", "period")
        .agg(F.sum("n_refs").alias("n_refs"), F.sum("orphans").alias("n_orphans"), F.sum("n_orphan_keys").alias("n_orphan_keys"))
    )
