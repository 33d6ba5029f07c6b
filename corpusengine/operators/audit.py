"""Analytics over the audit log: span trees, unfinished calls, approvals, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def span_depths(spans: DataFrame) -> DataFrame:
    """``span_id, root_id, depth``: distance from the root that parents lead to; a span whose parent isn't there is a root.

    Pointers double in every round, so the joins are as many as the logarithm of the deepest nesting. Spans whose parents lead into a cycle
    have neither root nor depth: they are what is still moving when every chain of so many spans has ended.
    """
    known = spans.select(F.col("span_id").alias("k"))
    there = F.col("k").isNotNull()
    at = spans.join(known, spans["parent_id"] == known["k"], "left").select("span_id", F.when(there, F.col("parent_id")).otherwise(F.col("span_id")).alias("root_id"), there.cast("int").alias("depth"))
    at = cut(at)
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        up = at.select(F.col("span_id").alias("root_id"), F.col("root_id").alias("far"), F.col("depth").alias("more"))
        further = cut(at.join(up, "root_id").select("span_id", F.col("far").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        at = further.drop("moved")
        if further.where("moved").isEmpty():
            return at
    ends = further.select("span_id", F.when(~F.col("moved"), F.col("root_id")).alias("root_id"), F.when(~F.col("moved"), F.col("depth")).alias("depth"))
    return ends


def unfinished(events: DataFrame) -> DataFrame:
    """Started calls without an end."""
    ended = events.where("event_type = 'tool_ended'").select("span_id")
    return events.where("event_type = 'tool_started'").join(ended, "span_id", "left_anti")


def approvals(events: DataFrame) -> DataFrame:
    """``span_id, requested_at, decided_at, outcome``: decisions joined to the requests that caused them."""
    asked = events.where("event_type = 'approval_requested'").select("span_id", F.col("started_at").alias("requested_at"))
    said = events.where("event_type = 'approval_decided'").select(F.col("causation_id").alias("span_id"), F.col("started_at").alias("decided_at"), F.col("approval_outcome").alias("outcome"))
    return asked.join(said, "span_id", "left")


def usage(events: DataFrame, by: str) -> DataFrame:
    """``by, n, total, mean, p95`` of ``value``; the percentile is one of the values, by a sketch that errs in one rank of ten thousand."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))


def status(error: str | Column) -> Column:
    """Result status by the kind of error; none is a success, and an unknown one an error."""
    kinds = {"PolicyDenied": "policy_blocked", "SecurityBlocked": "security_blocked", "ConfirmRequired": "user_denied"}
    col, out = (F.col(error) if isinstance(error, str) else error), F.lit("error")
    for kind, name in kinds.items():
        out = F.when(col == kind, F.lit(name)).otherwise(out)
    return F.when(col.isNull(), F.lit("success")).otherwise(out)


def ended_at(started: str, milliseconds: str) -> Column:
    return F.timestamp_micros(F.unix_micros(started) + F.col(milliseconds) * 1000)


def joined_deltas(deltas: DataFrame, call: str = "call_id") -> DataFrame:
    """``call, index, text, finish_reason``: streamed pieces joined in order, the last reason that was given."""
    rows = deltas.groupBy(call, "index").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    return rows.select(call, "index", F.array_join(F.col("p.piece"), "").alias("text"), "finish_reason")
