"""Queries of indexes that are kept from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import BucketTable
from ..operators.cells import CellIndex
from ..operators.inverted import InvertedIndex
from ..operators.lineage import new_folder
from . import retrieval
from .retrieval import _OKAPI, EVERY, _queries, table


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of a first batch, those that a second adds or replaces with texts turned round, and those that it removes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    turned = docs.where("doc_id % 9 = 0").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 40), " ").alias("text"))
    return docs.where("doc_id % 4 <> 3"), docs.where("doc_id % 4 = 3 AND doc_id % 9 <> 0").unionByName(turned), docs.where("doc_id % 7 = 2 AND doc_id % 9 <> 0 AND doc_id % 4 <> 3")


def inverted_index_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each query from an index that was made in two batches and merged once."""
    first, fresh, gone = _batches(spark, sf)
    index = InvertedIndex(spark, new_folder(spark, "inverted"), buckets=8)
    index.apply(1, first)
    index.apply(2, fresh, gone)
    index.merge(3)
    index.apply(4, gone=gone.where("doc_id % 2 = 0"))
    rows = index.top(_queries(spark, sf).where(f"query_id % {EVERY} = 0"))
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def inverted_index_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies after an addition, replacements and removals, from the deltas of two segments."""
    first, fresh, gone = _batches(spark, sf)
    index = InvertedIndex(spark, new_folder(spark, "inverted"), buckets=8)
    index.apply(1, first)
    index.apply(2, fresh, gone)
    return index.frequencies()


def bucketed_index_state(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 50 words by document after a second batch replaced some documents and removed others; the rest of the buckets was left alone."""
    first, fresh, gone = _batches(spark, sf)
    words = F.split("text", " ")
    chunk = lambda d: d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 50).cast("int")), lambda i: F.struct(i.alias("part"), F.size(F.slice(words, i * 50 + 1, 50)).alias("n")))).alias("c")).select("doc_id", "c.*")
    index = BucketTable(spark, new_folder(spark, "chunks"), "doc_id", 32)
    index.replace(0, chunk(first))
    index.replace(1, chunk(fresh), gone)
    return index.read()


def cell_index_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of each query by cosine, from the lists of all cells that may hold them."""
    rows = table(spark, sf, "embeddings")
    index = CellIndex.build(rows, new_folder(spark, "cells"))
    found = index.nearest_exact(rows.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def cell_index_l2(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    index = CellIndex.build(rows, new_folder(spark, "cells"), metric="l2")
    found = index.nearest_exact(rows.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_FINAL = """final AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN array_to_string(string_split(text, ' ')[:40], ' ') ELSE text END AS text FROM documents
  WHERE doc_id % 9 = 0 OR doc_id % 4 = 3 OR doc_id % 7 <> 2)"""
_WORDS = r"coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), [])"
SQL = {
    "inverted_index_top10": f"""WITH {_FINAL}, asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % {EVERY} = 0), {_OKAPI.replace("FROM documents", "FROM final")}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "inverted_index_frequencies": f"WITH {_FINAL} SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS token FROM final) GROUP BY token",
    "bucketed_index_state": f"""WITH {_FINAL}, w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM final)
SELECT doc_id, part::INT AS part, least(50, n - 50 * part)::INT AS n FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 50 + 1)) AS part FROM w)""",
}
SQL |= {"cell_index_cosine": retrieval.SQL["dense_knn_cosine"], "cell_index_l2": retrieval.SQL["dense_knn_l2"]}
QUERIES = {f.__name__: f for f in (inverted_index_top10, inverted_index_frequencies, bucketed_index_state, cell_index_cosine, cell_index_l2)}
