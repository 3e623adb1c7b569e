"""One identity per file across renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.operators.order import last_before, numbered
from lodestrata.session import cut


def latest_before(asked: DataFrame, assigned: DataFrame, path: str, same: bool = False) -> DataFrame:
    """(event, parent): the last assignment to `path` before each asked event, or `same` as it.

    Asked events and assignments of a path are put in one order, so the work does not grow with their product.
    """
    key = "path"
    tie = F.lit(1 if same else 0).alias("asked")
    side = lambda df, c, value, order: df.select(F.col(c).alias(key), "event", F.col("event.seq").alias("seq"), F.col("event.ordinal").alias("ordinal"), value.alias("given"), order)
    asks = side(asked, path, F.lit(None).cast(assigned.schema["event"].dataType), tie)
    gives = side(assigned, key, F.col("event"), F.lit(0 if same else 1).alias("asked"))
    found = last_before(asks.unionByName(gives), key, "seq", ["ordinal", "asked"], "given", "parent")
    return found.where("given is null and parent is not null").select("event", "parent")


def assignments(events: DataFrame) -> DataFrame:
    """The events that decide what a path stands for, each with its parent and the root of its chain.

    `events` has seq, ordinal, path and rename_from. A path is assigned by its first event and by each rename to it;
    all others leave it as it is, so a path that a tenth of all rows belong to gives one assignment. A rename's
    parent is the last assignment to the old path, if there is one; else, as for all others, the last to its own
    path. Chains are followed by pointer doubling, in rounds logarithmic in the longest chain of renames.
    """
    known = events.where("path is not null and seq is not null").select("path", "rename_from", F.struct("seq", F.coalesce("ordinal", F.lit(0)).alias("ordinal")).alias("event"))
    first = known.groupBy("path").agg(F.min_by(F.struct("event", "rename_from"), "event").alias("f")).select("path", "f.event", "f.rename_from")
    assigned = cut(first.unionByName(known.where("rename_from is not null").select("path", "event", "rename_from")).distinct())
    moved = latest_before(assigned.where("rename_from is not null"), assigned, "rename_from").withColumnRenamed("parent", "from_old")
    own = latest_before(assigned, assigned, "path").withColumnRenamed("parent", "from_own")
    linked = assigned.join(moved, "event", "left").join(own, "event", "left").select(
        "event", "path", F.col("from_old").isNotNull().alias("renamed"), F.coalesce("from_old", "from_own", "event").alias("root")
    )
    state = cut(linked)
    while True:
        up = state.select(F.col("event").alias("root"), F.col("root").alias("next"))
        jumped = cut(state.join(up, "root").select("event", "path", "renamed", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if not jumped.where("moved").limit(1).count():
            return jumped.drop("moved")
        state = jumped.drop("moved")


def root_ids(chains: DataFrame) -> DataFrame:
    """(root, id, first_path): ids dense from 1 in the order in which files first appear."""
    firsts = chains.where("event = root").select(F.col("root.seq").alias("seq"), F.col("root.ordinal").alias("ordinal"), "root", "path")
    return numbered(firsts, "seq", ["ordinal"]).select("root", (F.col("place") + 1).alias("id"), F.col("path").alias("first_path"))


def file_identity(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_ids, file_alias) of a history: (id, canonical_path) and (path, file_id), as at its end.

    Ids are dense from 1 in order of first appearance. A rename whose old path is known gives the new path the
    same id and makes it the canonical one; the old path keeps its id, so a file added there later shares it.
    (seq, ordinal) should be unique; null paths or seqs are left out.
    """
    chains = assignments(events)
    ids = root_ids(chains)
    last = chains.where("renamed").groupBy("root").agg(F.max_by("path", "event").alias("last_path"))
    file_ids = ids.join(last, "root", "left").select("id", F.coalesce("last_path", "first_path").alias("canonical_path"))
    now = chains.groupBy("path").agg(F.max_by("root", "event").alias("root"))
    return file_ids, now.join(ids, "root").select("path", F.col("id").alias("file_id"))


def rename_sources(changes: DataFrame) -> DataFrame:
    """Stored changes as events: a change of status R comes from the path that its file had before.

    Stored rows do not name the old path, so it is looked up in the file's own history. Rows of one commit are
    ordered by path; repeated rows are one event.
    """
    rows = changes.where("file_id is not null and path <> '' and seq is not null").groupBy("file_id", "seq", "path").agg(F.max("status").alias("status"))
    found = last_before(rows, "file_id", "seq", ["path"], "path", "old").select("seq", "path", F.when((F.col("status") == "R") & (F.col("old") != F.col("path")), F.col("old")).alias("rename_from"))
    once = found.groupBy("seq", "path").agg(F.max("rename_from").alias("rename_from"))
    return once.withColumn("ordinal", (F.row_number().over(Window.partitionBy("seq").orderBy("path")) - 1).cast("bigint"))
