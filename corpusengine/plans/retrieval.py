"""Queries of retrieval and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, fuse, route, sparse

QUERY = "the onthat tionof and"
#: Rows whose key is divisible by this are the queries of batch searches.
EVERY = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def okapi_bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.okapi_top(table(spark, sf, "documents").select("doc_id", "text"), QUERY).select("doc_id", F.round("score", 6).alias("score"))


def okapi_bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = sparse.okapi_top_batch(table(spark, sf, "documents").select("doc_id", "text"), _queries(spark, sf).where(f"query_id % {EVERY} = 0"))
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def shown_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's best documents as a list; every other item asked for finds none of them."""
    asked = _queries(spark, sf).where(f"query_id % {EVERY} = 0").select("query_id")
    hits = okapi_bm25_batch(spark, sf).where(f"query_id % {2 * EVERY} = 0")
    return fuse.shown(hits, asked, table(spark, sf, "documents"), "doc_id", ["query_id"])


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.term_frequency(table(spark, sf, "documents"), "doc_id")


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.document_frequency(sparse.term_frequency(table(spark, sf, "documents"), "doc_id"))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.corpus_stats(table(spark, sf, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def intent_query_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = sparse.query_weights(_queries(spark, sf), table(spark, sf, "documents"), "query_id", "doc_id")
    return rows.select("query_id", "token", F.round("weight", 6).alias("weight"))


def intent_document_weights(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.document_weights(table(spark, sf, "documents"), "doc_id").select("doc_id", "token", F.round("weight", 6).alias("weight"))


def sparse_dot_top5(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = table(spark, sf, "documents"), _queries(spark, sf)
    weights, mean = sparse.router_weights(queries, docs, "query_id")
    rows = sparse.router_top(weights, docs, mean, 5, "query_id", "doc_id")
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _nearest(spark: SparkSession, sf: str, k: int, metric: str = "cosine") -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return dense.nearest(rows.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows, k, "query_id", "vec_id", metric=metric)


def dense_knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dense_knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 10, "l2").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark's items as texts against documents, and as vectors of the same number against vectors, doc_id standing for vec_id."""
    items = _queries(spark, sf).where(f"query_id % {EVERY} = 0")
    one = sparse.okapi_top_batch(table(spark, sf, "documents").select("doc_id", "text"), items, fuse.CANDIDATES)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding").join(items.select("query_id"), "query_id", "left_semi")
    return one, dense.nearest(asked, vectors, fuse.CANDIDATES, "query_id", "doc_id")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = fuse.best(fuse.fused(list(_arms(spark, sf)), "doc_id", ["query_id"]), ["query_id"], 10)
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    one, two = _arms(spark, sf)
    rows = fuse.hybrid(one, two, table(spark, sf, "documents"), "doc_id", ["query_id"])
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """The five nearest other vectors of each query, or with ``whole`` of each vector, with their labels as routes."""
    if whole:
        near = dense.nearest_others(table(spark, sf, "embeddings"), route.TOP_K, "query_id", "vec_id")
    else:
        near = _nearest(spark, sf, route.TOP_K + 1).where("query_id <> vec_id")
        near = sparse.ranked(near.drop("rank"), ["query_id"], "score", "vec_id", route.TOP_K)
    labels = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("r"), F.col("label")).alias("route"))
    return near.join(labels, "vec_id")


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """A threshold for the routes of even labels; the rest take the default."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    return labels.select(F.concat(F.lit("r"), F.col("label")).alias("route"), F.when(F.col("label") % 2 == 0, F.lit(0.25)).cast("double").alias("threshold"))


def route_scores(spark: SparkSession, sf: str) -> DataFrame:
    return route.route_scores(_hits(spark, sf, whole=True), "query_id").select("query_id", "route", F.round("score", 6).alias("score"))


def route_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = route.chosen(route.route_scores(_hits(spark, sf), "query_id"), _thresholds(spark, sf), "query_id", default=0.1)
    return rows.select("query_id", "route", F.round("score", 6).alias("score"))


def route_near_miss(spark: SparkSession, sf: str) -> DataFrame:
    return route.near_misses(route.route_scores(_hits(spark, sf, whole=True), "query_id"), "query_id").select("query_id", "route", "rank", F.round("score", 6).alias("score"))


def _predicted(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """The label and the chosen route of each query, or with ``whole`` of each vector."""
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("r"), F.col("label")).alias("truth"))
    truth = truth if whole else truth.where(f"query_id % {EVERY} = 0")
    picks = route.chosen(route.route_scores(_hits(spark, sf, whole), "query_id"), _thresholds(spark, sf), "query_id", default=0.1)
    return truth.join(picks, "query_id", "left")


def route_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return route.accuracy(_predicted(spark, sf)).select("n", "correct", F.round("accuracy", 6).alias("accuracy"))


def route_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return route.confusion(_predicted(spark, sf, whole=True))


def route_threshold_fit(spark: SparkSession, sf: str) -> DataFrame:
    scores = route.route_scores(_hits(spark, sf), "query_id")
    rows = route.fitted_thresholds(scores, _predicted(spark, sf), _thresholds(spark, sf), "query_id", trials=100)
    return rows.select("route", F.round("threshold", 6).alias("threshold"))


_W = r"[\p{L}\p{N}_]+"
_OKAPI = rf"""
d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '{_W}'), []) AS w FROM documents),
p AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL),
raw AS (SELECT token, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM p GROUP BY token),
idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM asked) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(w)) FROM d)))) AS score
  FROM p JOIN q USING (token) JOIN idf USING (token) GROUP BY ALL)"""
_ITEMS = f"asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % {EVERY} = 0)"
_STATS = rf"""
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_W}'), []) AS w FROM documents),
p AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL),
qw AS (SELECT query_id, token, i / sum(i) OVER (PARTITION BY query_id) AS weight FROM (
  SELECT query_id, token, ln(((SELECT count(*) FROM documents) + 1) / (df + 0.5)) AS i
  FROM (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '{_W}')) AS token FROM benchmark)
  JOIN (SELECT token, count(*) AS df FROM p GROUP BY token) USING (token))),
dw AS (SELECT doc_id, token, tf / nullif(1.5 * (1 - 0.75 * 0.75 * dl / (SELECT avg(len(w)) FROM d)) + tf, 0) AS weight FROM p)"""
_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
_PAIRS = f"""
n AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COS.format(a="q.embedding", b="v.embedding")} AS score
  FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % {EVERY} = 0)"""
_HITS = f"""{_PAIRS},
h AS (SELECT * FROM (SELECT query_id, 'r' || label AS route, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
  FROM n WHERE query_id <> vec_id) WHERE rank <= 5),
rs AS (SELECT query_id, route, avg(score) AS score, min(rank) AS best FROM h GROUP BY ALL),
th AS (SELECT DISTINCT 'r' || label AS route, CASE WHEN label % 2 = 0 THEN 0.25 END AS threshold FROM embeddings),
pick AS (SELECT query_id, route, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, route) AS k
  FROM rs JOIN th USING (route) WHERE score >= coalesce(threshold, 0.1)) WHERE k = 1),
pred AS (SELECT e.vec_id AS query_id, 'r' || e.label AS truth, pick.route FROM embeddings e LEFT JOIN pick ON pick.query_id = e.vec_id WHERE e.vec_id % {EVERY} = 0)"""
#: The same for all vectors as queries.
_WHOLE = _HITS.replace(f" WHERE q.vec_id % {EVERY} = 0", "").replace(f" WHERE e.vec_id % {EVERY} = 0", "")
_ARMS = f"""{_ITEMS}, {_OKAPI},
a1 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 30),
a2 AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a="q.embedding", b="v.embedding")}, 9) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN asked ON asked.query_id = q.vec_id JOIN embeddings v ON true) WHERE rank <= 30),
f AS (SELECT query_id, doc_id, sum(part) AS score, min(seen) AS seen FROM (
  SELECT query_id, doc_id, 1.0::DOUBLE / (59 + rank) AS part, rank AS seen FROM a1 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (59 + rank), 1000000 + rank FROM a2) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM f)"""

QUERIES = {f.__name__: f for f in (
    okapi_bm25_top10, okapi_bm25_batch, shown_hits, term_frequency, document_frequency, corpus_stats, intent_query_weights, intent_document_weights, sparse_dot_top5, dense_knn_cosine,
    dense_knn_l2, rrf_fusion, hybrid_retrieve, route_scores, route_choice, route_near_miss, route_accuracy, route_confusion, route_threshold_fit,
)}

SQL = {
    "okapi_bm25_top10": f"WITH asked AS (SELECT 0 AS query_id, '{QUERY}' AS text), {_OKAPI} SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) ORDER BY round(coalesce(score, 0), 9) DESC, doc_id LIMIT 10",
    "okapi_bm25_batch": f"WITH {_ITEMS}, {_OKAPI} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10",
    "term_frequency": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM documents) GROUP BY ALL",
    "document_frequency": f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM documents) GROUP BY ALL",
    "corpus_stats": f"SELECT count(*) AS n_docs, round(avg(len(coalesce(regexp_extract_all(lower(text), '{_W}'), []))), 6) AS avgdl FROM documents",
    "intent_query_weights": f"WITH {_STATS} SELECT query_id, token, round(weight, 6) AS weight FROM qw",
    "intent_document_weights": f"WITH {_STATS} SELECT doc_id, token, round(weight, 6) AS weight FROM dw",
    "sparse_dot_top5": f"WITH {_STATS}, s AS (SELECT query_id, doc_id, sum(qw.weight * dw.weight) AS score FROM qw JOIN dw USING (token) GROUP BY ALL) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5",
    "dense_knn_cosine": f"WITH {_PAIRS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM n) WHERE rank <= 10",
    "dense_knn_l2": f"WITH n AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % {EVERY} = 0) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), vec_id) AS rank FROM n) WHERE rank <= 10",
    "rrf_fusion": f"WITH {_ARMS} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM fr WHERE rank <= 10",
    "hybrid_retrieve": f"WITH {_ARMS} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY md5(coalesce(text, '')), doc_id) AS rank FROM fr LEFT JOIN documents USING (doc_id) WHERE fr.rank <= 10) WHERE rank <= 5",
    "route_scores": f"WITH {_WHOLE} SELECT query_id, route, round(score, 6) AS score FROM rs",
    "route_choice": f"WITH {_HITS} SELECT query_id, route, round(score, 6) AS score FROM pick",
    "route_near_miss": f"WITH {_WHOLE} SELECT query_id, route, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, route) AS rank FROM rs) WHERE rank <= 3",
    "route_accuracy": f"WITH {_HITS} SELECT count(*) AS n, count(*) FILTER (truth = route) AS correct, round(count(*) FILTER (truth = route) / greatest(count(*), 1), 6) AS accuracy FROM pred",
    "route_threshold_fit": f"""WITH {_HITS},
dr AS (SELECT trial, route, CASE WHEN trial = 0 THEN t ELSE lo + (hi - lo) * (CAST('0x' || substr(md5(trial || '|' || route || '|0'), 1, 8) AS BIGINT) % 100) / 99 END AS threshold FROM (
  SELECT *, greatest(t - 0.8, 0)::DOUBLE AS lo, least(t + 0.8, 1)::DOUBLE AS hi FROM (SELECT route, coalesce(threshold, 0)::DOUBLE AS t FROM th)), (SELECT unnest(range(0, 101)) AS trial)),
ps AS (SELECT trial, query_id, route FROM (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY round(score, 9) DESC, best) AS k FROM rs JOIN dr USING (route) WHERE score >= dr.threshold) WHERE k = 1),
rt AS (SELECT trial, count(*) AS n FROM ps JOIN (SELECT query_id, truth FROM pred) USING (query_id) WHERE truth = ps.route GROUP BY trial)
SELECT route, round(threshold, 6) AS threshold FROM dr WHERE trial = coalesce((SELECT trial FROM rt ORDER BY n DESC, trial LIMIT 1), 0)""",
    "route_confusion": f"WITH {_WHOLE} SELECT truth, route, count(*) AS n FROM pred GROUP BY ALL",
}
SQL["shown_hits"] = f"""WITH h AS ({SQL["okapi_bm25_batch"]}),
l AS (SELECT query_id, string_agg('- [' || coalesce(source, '') || ':' || doc_id || '] ' || substr(coalesce(text, ''), 1, {fuse.PREVIEW}), chr(10) ORDER BY rank) AS lines FROM h JOIN documents USING (doc_id) GROUP BY query_id)
SELECT item_id AS query_id, coalesce('{fuse.HITS}' || chr(10) || lines, '{fuse.NO_HITS}') AS text FROM benchmark LEFT JOIN l ON query_id = item_id AND item_id % {2 * EVERY} = 0 WHERE item_id % {EVERY} = 0"""
