"""Queries in SQL through the table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import tables
from ..functions.text import WORDS
from .retrieval import table


def sql_windows(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, window, md5(words) AS words FROM token_windows(TABLE({docs}), column => 'text', size => 200, overlap => 50)", docs=docs)


def sql_lines(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark)
    pages = table(spark, sf, "pages").select("page_id", "html")
    return spark.sql("SELECT page_id, line_no, md5(line) AS line FROM matching_lines(rows => TABLE({pages}), column => 'html', pattern => '<h[1-3]')", pages=pages)


QUERIES = {f.__name__: f for f in (sql_windows, sql_lines)}
SQL = {
    "sql_windows": rf"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '{WORDS}'), []) AS w FROM documents)
SELECT doc_id, (a // 150)::INT AS window, md5(array_to_string(w[a + 1:a + 200], ' ')) AS words FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 200 THEN [0] ELSE range(0, len(w), 150) END) AS a FROM w)""",
    "sql_lines": r"""SELECT page_id, (k - 1)::INT AS line_no, md5(l[k]) AS line FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_split_to_array(coalesce(html, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM pages))
WHERE regexp_matches(l[k], '<h[1-3]')""",
}
