"""Keeping an index of chunks with its sources from a stream of files, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import BucketTable
from ..operators.memory import latest


def sync(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], index: str, checkpoint: str, key: str = "path", order: str = "mtime", buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Replace each arriving path's chunks in the index below ``index``; runs until what has arrived is taken in.

    A batch writes the buckets of its paths alone, and its manifest last, so a batch that is run again after a loss writes the same once more. Files
    that none of the newest ``keep`` commits names go. The source tells of no deletions: ``reconciled`` takes those out.
    """
    table = BucketTable(stream.sparkSession, index, key, buckets)

    def take(batch: DataFrame, number: int) -> None:
        newest = latest(batch, key, order)
        table.replace(number, chunk(newest), newest)
        table.clean(keep)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, index: str, below: int | None = None) -> DataFrame | None:
    """The index as its newest commit has it (of a number below ``below``, if given), None before there is one."""
    return BucketTable(spark, index).read(below)


def reconciled(index: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    """The index without paths that the scan no longer finds."""
    return index.join(scan.select(key).distinct(), key, "left_semi")


def windowed(events: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by windows that tumble, or that begin every ``slide``; for streams with a watermark as for tables."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width, slide).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``by, session_start, session_end, n``: runs of events no further apart than the gap."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
