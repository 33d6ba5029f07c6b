"""Compaction of conversations to a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed

OVERHEAD, MARGIN, TRIGGER, RESERVE = 4, 1.1, 0.8, 0.1


def cost(text: str | Column) -> Column:
    """Estimated tokens of a message: its white-space words and a constant."""
    s = squeezed(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.when(s == "", F.lit(OVERHEAD)).otherwise(F.size(F.split(s, " ")) + OVERHEAD)


def should_compress(messages: DataFrame, by: str, context: int, text: str = "text") -> DataFrame:
    """``by, estimate, compress``: whether the estimate with its margin passes the share of the context that triggers."""
    sums = messages.groupBy(by).agg(F.sum(cost(text)).cast("long").alias("estimate"))
    return sums.withColumn("compress", F.col("estimate") * F.lit(MARGIN) > F.lit(TRIGGER * context))


def context_size(configured: str | Column, window: str | Column) -> Column:
    """The context to budget for: the configured size if it is above zero, else half the model's window."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(of(configured) > 0, of(configured).cast("long")).otherwise(F.floor(of(window) / 2).cast("long"))


def should_compress_by(messages: DataFrame, models: DataFrame, by: str, text: str = "text") -> DataFrame:
    """``by, estimate, context, compress`` with each group's own context, from ``models(by, context_size, model_window)``."""
    sums = messages.groupBy(by).agg(F.sum(cost(text)).cast("long").alias("estimate"))
    rows = sums.join(models.select(by, context_size("context_size", "model_window").alias("context")), by)
    return rows.withColumn("compress", F.col("estimate") * F.lit(MARGIN) > F.col("context") * F.lit(TRIGGER))


def recent_tail(messages: DataFrame, by: str, seq: str, budget: int, text: str = "text") -> DataFrame:
    """The messages that are kept, in columns as given: from the last back while their costs fit, the last itself always.

    System messages are left out. A kept tool result brings the nearest earlier assistant with calls, free of charge; a result
    whose call isn't kept then goes. ``messages`` may have ``tool_calls`` (an array of structs with ``id``) and ``tool_call_id``. Order is by ``seq``.
    """
    rows = messages.where("role <> 'system'")
    back = Window.partitionBy(by).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(cost(text)).over(back)
    rows = rows.withColumn("_kept", (spent <= budget) | (F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq))) == 1))
    if "tool_calls" not in messages.columns:
        return rows.where("_kept").drop("_kept")
    calls = F.size(F.coalesce("tool_calls", F.expr("array()"))) > 0
    before = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    caller = F.last(F.when((F.col("role") == "assistant") & calls, F.col(seq)), ignorenulls=True).over(before)
    rows = rows.withColumn("_caller", F.when(F.col("_kept") & (F.col("role") == "tool"), caller))
    brought = rows.where("_caller is not null").select(F.col(by).alias("_by"), F.col("_caller").alias("_seq")).distinct()
    mark = F.col("_seq").isNotNull() & (F.col("role") == "assistant") & calls
    rows = rows.join(brought, F.col(by).eqNullSafe(F.col("_by")) & (F.col(seq) == F.col("_seq")), "left").withColumn("_brought", mark)
    kept = rows.where("_kept or _brought").drop("_kept", "_brought", "_caller", "_by", "_seq")
    ids = kept.where("role = 'assistant'").select(F.col(by).alias("_by"), F.explode("tool_calls.id").alias("_id")).distinct()
    tools = kept.where("role = 'tool'").join(ids, (F.col(by) == F.col("_by")) & (F.col("tool_call_id") == F.col("_id")), "left_semi")
    return kept.where("role <> 'tool'").unionByName(tools)


def compacted(messages: DataFrame, summaries: DataFrame, by: str, seq: str, budget: int) -> DataFrame:
    """``by, part, seq, role, text``: the first system message among the first three, the summary, then the tail."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    heads = messages.withColumn("_n", place).where("_n <= 3 and role = 'system'")
    first = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    heads = heads.withColumn("_n", first).where("_n = 1").select(by, F.lit(0).alias("part"), seq, "role", "text")
    said = summaries.select(by, F.lit(1).alias("part"), F.lit(None).cast(messages.schema[seq].dataType).alias(seq), F.lit("system").alias("role"), F.col("summary").alias("text"))
    return heads.unionByName(said).unionByName(recent_tail(messages, by, seq, budget).select(by, F.lit(2).alias("part"), seq, "role", "text"))
