"""Classification of utterances by the routes of their nearest samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import clipped, entities, is_followup, merged_entities
from .dense import nearest

ALPHA, TOP_K = 0.6, 5
SEARCH, POINTS, TRIALS = 0.8, 100, 500
#: Routes whose limits are broadcast, about 4,000 bytes each; those of more travel with the scores.
ROUTES = 2_000


def hybrid_scores(dense: DataFrame, sparse: DataFrame | None, query: str, key: str, alpha: float = ALPHA, scaled_query: bool = True) -> DataFrame:
    """``query, key, score``: cosine plus the sparse product times (1 - alpha)², or (1 - alpha) for queries that aren't scaled."""
    if sparse is None:
        return dense.select(query, key, "score")
    factor = (1 - alpha) ** (2 if scaled_query else 1)
    rows = dense.select(query, key, F.col("score")).unionByName(sparse.select(query, key, (F.col("score") * factor).alias("score")))
    return rows.groupBy(query, key).agg(F.sum("score").alias("score"))


def hybrid_nearest(queries: DataFrame, corpus: DataFrame, sparse: DataFrame, k: int, query: str, key: str, alpha: float = ALPHA, scaled_query: bool = True) -> DataFrame:
    """``query, key, score, rank`` of the k rows with the greatest ``hybrid_scores``: sparse products travel to the vectors, and only k rows a query leave each batch."""
    factor = (1 - alpha) ** (2 if scaled_query else 1)
    by_row = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(query, F.col("score") * factor))).alias("plus"))
    return nearest(queries, corpus.join(by_row, key, "left"), k, query, key, plus="plus")


def route_scores(hits: DataFrame, query: str, route: str = "route") -> DataFrame:
    """``query, route, score, best_rank``: means over a query's hits (``rank`` from 1); better hits order equal means."""
    return hits.groupBy(query, route).agg(F.avg("score").alias("score"), F.min("rank").alias("best_rank"))


def chosen(scores: DataFrame, thresholds: DataFrame, query: str, route: str = "route", default: float | None = None) -> DataFrame:
    """``query, route, score``: the best route whose mean reaches its threshold, its own before the default; no row if none does."""
    limits = thresholds.select(route, F.col("threshold"))
    known = scores.join(limits, route)
    passed = known.where(F.coalesce(F.col("score") >= F.coalesce("threshold", F.lit(default).cast("double")), F.lit(True)))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "best_rank", route))
    return passed.withColumn("place", place).where("place = 1").select(query, route, "score")


def near_misses(scores: DataFrame, query: str, k: int = 3, route: str = "route") -> DataFrame:
    """``query, route, score, rank``: the k best routes whatever their thresholds."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "best_rank", route))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).select(query, route, "score", "rank")


def cascade(turns: DataFrame, choices: DataFrame, query: str, general: str = "general", route: str = "route") -> DataFrame:
    """``query, intent, source, confidence, entities`` of every row of ``turns(query, text, prev_intent, prev_text)``.

    A follow-up keeps the previous intent, and the previous text's entities where its own have none; else the chosen route counts
    unless it is the general one; what is left is marked ``llm``, to be decided elsewhere, as general with no confidence.
    """
    picks = choices.where(F.col(route) != general).select(query, F.col(route).alias("_route"), "score")
    rows = turns.join(picks, query, "left").withColumn("_follows", is_followup("text", "prev_intent"))
    source = F.when(F.col("_follows"), "followup").when(F.col("_route").isNotNull(), "router").otherwise("llm")
    intent = F.when(F.col("_follows"), F.col("prev_intent")).otherwise(F.coalesce("_route", F.lit(general)))
    confidence = F.when(F.col("_follows"), F.lit(1.0)).when(F.col("_route").isNotNull(), clipped("score")).otherwise(F.lit(0.0))
    found = F.when(F.col("_follows"), merged_entities(entities("prev_text"), entities("text"))).otherwise(entities("text"))
    return rows.select(query, intent.alias("intent"), source.alias("source"), confidence.alias("confidence"), found.alias("entities"))


def accuracy(predicted: DataFrame, truth: str = "truth", prediction: str = "route") -> DataFrame:
    """``n, correct, accuracy`` in one row; no prediction is a wrong one."""
    right = F.coalesce(F.col(truth) == F.col(prediction), F.lit(False)).cast("long")
    sums = predicted.agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"))
    return sums.withColumn("accuracy", F.col("correct") / F.greatest("n", F.lit(1)))


def confusion(predicted: DataFrame, truth: str = "truth", prediction: str = "route") -> DataFrame:
    return predicted.groupBy(truth, prediction).agg(F.count("*").alias("n"))


def fitted_thresholds(scores: DataFrame, truths: DataFrame, thresholds: DataFrame, query: str, route: str = "route", trials: int = TRIALS, seed: int = 0) -> DataFrame:
    """``route, threshold`` of the best of ``trials`` random draws, or the given ones if none is better.

    A draw takes for each route one of 100 even steps from 0.8 below its threshold to 0.8 above, within 0 and 1; the draw is
    a digest of trial, route and seed. A query's routes stay in one row, which judges all trials; sums by trial are taken before
    anything is shuffled. The draws, one number for each route and trial, are the small side.
    """
    spark = scores.sparkSession
    low, high = F.greatest(F.col("t") - SEARCH, F.lit(0.0)), F.least(F.col("t") + SEARCH, F.lit(1.0))
    told = F.concat_ws("|", F.col("trial").cast("string"), route, F.lit(str(seed)))
    step = F.conv(F.substring(F.md5(told.cast("binary")), 1, 8), 16, 10).cast("long") % POINTS
    given = thresholds.select(route, F.coalesce("threshold", F.lit(0.0)).alias("t"))
    draws = given.crossJoin(spark.range(trials + 1).withColumnRenamed("id", "trial"))
    draws = draws.select("trial", route, F.when(F.col("trial") == 0, F.col("t")).otherwise(low + (high - low) * step / (POINTS - 1)).alias("threshold"))
    limits = draws.groupBy(route).agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", "threshold"))), lambda d: d["threshold"]).alias("limits"))
    own = lambda *more: F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("low"), "best_rank", F.col(route).alias("name"), "score", *more))).alias("own")
    if given.count() <= ROUTES:
        # the limits are sent once, as a row, and not with every score
        every = limits.agg(F.map_from_entries(F.collect_list(F.struct(route, "limits"))).alias("every"))
        rows = scores.join(F.broadcast(given.select(route)), route, "left_semi").groupBy(query).agg(own()).join(truths.select(query, "truth"), query).crossJoin(F.broadcast(every))
        rows = rows.withColumn("own", F.transform("own", lambda o: F.struct(o["name"].alias("name"), o["score"].alias("score"), F.element_at("every", o["name"]).alias("limits"))))
    else:
        rows = scores.join(limits, route).groupBy(query).agg(own("limits")).join(truths.select(query, "truth"), query)
    # routes are in the order of choice, so the first that reaches its limit is the prediction
    named = F.transform(F.sequence(F.lit(1), F.lit(trials + 1)), lambda i: F.try_element_at(F.filter("own", lambda o: o["score"] >= F.element_at(o["limits"], i)), F.lit(1))["name"] == F.col("truth"))
    right = rows.select(F.posexplode(named).alias("trial", "right")).groupBy("trial").agg(F.count_if("right").alias("right")).where("right > 0")
    best = right.agg(F.min_by("trial", F.struct(-F.col("right"), "trial")).alias("best"))
    picked = draws.crossJoin(F.broadcast(best)).where(F.col("trial") == F.coalesce("best", F.lit(0)))
    return picked.select(route, "threshold")
