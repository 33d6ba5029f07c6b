"""Calls of tools as streams: starts joined with their ends, and a log that is written exactly once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def outcomes(events: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``span_id, started_at, ended_at, finished`` for every start: its end within a time after it, or none.

    For tables and streams of ``events(event_type, span_id, at)`` with timestamps. Of a stream, a start whose end doesn't come has its row once the
    watermark, ``late`` behind the newest event, is past the time an end could have; events that come later still are dropped, and state with them. A start with
    several ends has a row for each; rows without a time or a span are left out.
    """
    rows = events.withWatermark("at", late) if events.isStreaming else events

    def only(kind: str, name: str, key: str) -> DataFrame:
        # a condition on the time too: else it is asked before the watermark, which would then follow events of one kind
        wanted = F.when((F.col("event_type") == kind) & F.col("span_id").isNotNull(), F.col("at")) == F.col("at")
        return rows.where(wanted).select(F.col("span_id").alias(key), F.col("at").alias(name))

    started, ended = only("tool_started", "started_at", "span_id"), only("tool_ended", "ended_at", "_ended")
    same = F.expr(f"span_id = _ended AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {within}")
    return started.join(ended, same, "leftOuter").select("span_id", "started_at", "ended_at", F.col("ended_at").isNotNull().alias("finished"))


def logged(events: DataFrame, path: str, checkpoint: str, at: str = "started_at") -> StreamingQuery:
    """Writes a stream of events as JSON lines, in a folder for each day and batch, until what has arrived is written.

    A batch that is run again after a loss replaces its own folders, so each event is there once. ``files.audit_log`` reads the log.
    """
    query = events.writeStream.foreachBatch(lambda batch, number: write_batch(batch, path, number, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(batch: DataFrame, path: str, number: int, at: str = "started_at") -> None:
    """A batch's rows in place of what stands under its number; events without a time are of the day ``unknown``."""
    day = F.coalesce(F.substring(F.col(at).cast("string"), 1, 10), F.lit("unknown"))
    rows = batch.withColumn("dt", day).withColumn("batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").json(path)
