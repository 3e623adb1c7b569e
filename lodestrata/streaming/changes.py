"""Histories that keep growing: appending what is new, and churn by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.features import lines


def new_rows(rows: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet; of rows with equal keys in the batch one."""
    fresh = rows.dropDuplicates(keys)
    return fresh if stored is None else fresh.join(stored.select(*keys).distinct(), keys, "left_anti")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], read: Callable[[], DataFrame | None]) -> StreamingQuery:
    """Append each micro-batch's new rows to Parquet at `path`, once, and stop when the input is used up.

    A batch that is run again after a failure finds its rows stored and adds nothing, as batches are told apart
    by their keys and not by their number. `read` gives what is stored, or None at first.
    """

    def write(batch: DataFrame, number: int) -> None:
        new_rows(batch, read(), keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_churn(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """(day, n_changes, churn): lines changed by day of arrival, of a stream or a table of changes.

    On a stream, a day ends when arrivals are `late` past it; rows that come later still are not counted.
    """
    timed = changes.where("ingested_at is not null").withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", late)
    days = timed.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n_changes"), F.sum(lines()).alias("churn"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_changes", "churn")
