"""Queries of words that are cut out of texts without blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.text import tokens
from .retrieval import table


def segmented_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the benchmark without their blanks and marks, cut by the words that documents have."""
    words = table(spark, sf, "documents").select(F.explode(tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    known = segment.lexicon(words)
    joined = F.array_join(tokens("text"), "")
    cut = segment.segmenter(spark, known, r"[\p{L}\p{N}_]")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(cut(F.array(joined)), "|").alias("words"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
SQL = {
    "segmented_items": f"""
WITH RECURSIVE counts AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT {segment.LEXICON}),
total AS (SELECT sum(n)::DOUBLE AS total, max(length(w)) AS longest FROM counts),
costs AS (SELECT w, floor(1000 * ln(total / n))::BIGINT AS c FROM counts, total),
items AS (SELECT row_number() OVER () AS rid, item_id, array_to_string({_WORDS}, '') AS t FROM benchmark),
spans AS (SELECT rid, e, n, substring(t, e - n + 1, n) AS w FROM (SELECT rid, t, e, unnest(range(1, least(e, longest) + 1)) AS n
  FROM (SELECT rid, t, unnest(range(1, length(t) + 1)) AS e FROM items), total)),
edges AS (SELECT rid, e, n, w, coalesce(c, CASE WHEN n = 1 THEN floor(1000 * ln(total))::BIGINT + 1000 END) AS c FROM spans LEFT JOIN costs USING (w), total),
steps AS (SELECT rid, e, list({{'n': n, 'w': w, 'c': c}} ORDER BY n) AS into FROM edges WHERE c IS NOT NULL GROUP BY rid, e),
paths AS (SELECT rid, 0::BIGINT AS e, [{{'c': 0::BIGINT, 'n': 0::BIGINT, 'p': ''}}] AS best FROM items
  UNION ALL SELECT p.rid, s.e, list_append(best, list_reduce(list_transform(s.into, lambda x: {{'c': best[s.e - x.n + 1].c + x.c, 'n': x.n, 'p': best[s.e - x.n + 1].p || '|' || x.w}}),
    lambda a, b: CASE WHEN b.c <= a.c THEN b ELSE a END)) FROM paths p JOIN steps s ON s.rid = p.rid AND s.e = p.e + 1)
SELECT item_id, substring(best[-1].p, 2) AS words FROM items JOIN paths USING (rid) WHERE paths.e = length(t)
""",
}
QUERIES = {"segmented_items": segmented_items}
