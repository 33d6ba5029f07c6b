"""Reciprocal rank fusion and the hybrid retrieval built on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CANDIDATES = 60, 30
#: What a list of hits begins with, what stands in place of an empty one, and how much of a text it shows.
HITS, NO_HITS, PREVIEW = "检索到以下相关段落：", "检索无命中（索引可能为空，可先写几篇笔记）", 200


def fused(arms: list[DataFrame], key: str, by: list[str], rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """``by..., key, score, seen``: sums of 1/(k + rank - 1) over arms with ranks from 1; ``seen`` orders ties by arm and rank."""
    rows = None
    for i, arm in enumerate(arms):
        part = arm.select(*by, key, (1.0 / (k + F.col(rank) - 1)).alias("part"), (F.lit(i * 1_000_000) + F.col(rank)).alias("seen"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*by, key).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))


def best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group by score, ties by first appearance."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "seen"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def hybrid(sparse: DataFrame, dense: DataFrame, texts: DataFrame, key: str, by: list[str], top_k: int = 5, rerank: Callable[[Column], Column] = F.md5, queries: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``by..., key, score, rank``: the 2 top_k best fused rows joined to their texts, the first top_k of these in ``rerank``'s order.

    The default reranker is a test double. A model plugs in as ``scorer``, a pandas UDF of a query's text and a document's whose highest values come first, with the
    queries' texts as ``queries(by..., query_text)``; ``operators.rerank`` trains one. Ids that the texts
    lack, and null texts, are ranked by an empty text.
    """
    candidates = best(fused([sparse, dense], key, by), by, 2 * top_k).drop("rank")
    with_text = candidates.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    if scorer is None:
        order = rerank(F.encode("text", "UTF-8"))
    else:
        with_text = with_text.join(queries.select(*by, "query_text"), by, "left").withColumn("_value", scorer(F.coalesce("query_text", F.lit("")), F.col("text")))
        order = F.desc(F.round("_value", 9))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
    return with_text.withColumn("rank", place).where(F.col("rank") <= top_k).select(*by, key, "score", "rank")


def shown(hits: DataFrame, queries: DataFrame, texts: DataFrame, key: str, by: list[str], most: int = PREVIEW) -> DataFrame:
    """``by..., text``: for every row of ``queries`` its ranked ``hits(by..., key, rank)`` as a list, best first, each with the source, the key and the beginning of its text.

    ``texts(key, source, text)`` has what is shown; what it lacks is shown as empty. A query has as many lines as it has hits, so these should be the best few.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("- ["), some("source"), F.lit(":"), F.col(key).cast("string"), F.lit("] "), F.substring(some("text"), 1, most))
    lines = hits.select(*by, key, "rank").join(texts.select(key, "source", "text"), key, "left").select(*by, "rank", line.alias("line"))
    lists = lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("lines"))
    return queries.select(*by).join(lists, by, "left").select(*by, F.coalesce(F.concat(F.lit(HITS + "\n"), "lines"), F.lit(NO_HITS)).alias("text"))
