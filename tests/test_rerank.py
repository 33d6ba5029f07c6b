"""A trained scorer behind fusion."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusengine.operators import fuse, rerank, sparse


def test_trained_scorer_ranks_better_than_fusion(spark):
    """Queries are passages with some words changed; every document has a twin with the same words in another order, which a bag of words can't tell apart."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(400)]
    docs, queries = [], []
    for i in range(120):
        text = rng.choices(words, k=60)
        twin = text[:]
        rng.shuffle(twin)
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(twin))]
        asked = [w if rng.random() < 0.8 else rng.choice(words) for w in text[10:30]]
        queries.append((i, " ".join(asked), 2 * i))
    docs = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").cache()
    asked = spark.createDataFrame(queries, "query_id long, query_text string, wanted long").cache()
    arm = lambda q: sparse.okapi_top_batch(docs, q.withColumnRenamed("query_text", "text"), 30).select("query_id", "doc_id", "rank")
    noise = lambda q: q.crossJoin(docs.select("doc_id")).withColumn("rank", F.row_number().over(sparse.Window.partitionBy("query_id").orderBy(F.xxhash64("doc_id", "query_id")))).where("rank <= 30").select("query_id", "doc_id", "rank")
    learn, held = asked.where("query_id % 2 = 0"), asked.where("query_id % 2 = 1")
    pairs = arm(learn).join(learn, "query_id").join(docs, "doc_id").select("query_text", "text", (F.col("doc_id") == F.col("wanted")).alias("relevant"))
    weights = rerank.fitted(pairs)
    assert weights[1] > 0 or weights[2] > 0

    def right(rows):
        return rows.where("rank = 1").join(held, "query_id").where("doc_id = wanted").count()

    arms = arm(held).cache(), noise(held).cache()
    alone = right(fuse.best(fuse.fused(list(arms), "doc_id", ["query_id"]), ["query_id"], 5))
    ranked = fuse.hybrid(*arms, docs, "doc_id", ["query_id"], queries=held, scorer=rerank.scorer(spark, weights))
    assert right(ranked) >= 55 > alone + 10


def test_scorer_of_odd_texts(spark):
    score = rerank.scorer(spark, np.arange(6.0))
    rows = spark.createDataFrame([("a b", "A b c"), (None, None), ("", "x"), ("a", "")], "q string, t string").select(score("q", "t").alias("s")).collect()
    assert all(0 < r["s"] < 1 for r in rows) and rows[0]["s"] > rows[3]["s"]
    assert not rerank.fitted(spark.createDataFrame([("a", "b", True), ("a", "c", None)], "query_text string, text string, relevant boolean")).any()
