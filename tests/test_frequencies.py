"""Counts of tokens by document and of documents by token."""

from collections import Counter

import duckdb

from corpusengine.operators import sparse
from corpusengine.plans import registry
from tests import compare


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_long_rows_are_counted_once(spark):
    """No filter counts a row's tokens before they are counted; one below the count would cut the text anew for each token."""
    words = [f"w{i * i % 977}" for i in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "W1 w1-x")], "doc_id long, text string")
    post = sparse.term_frequency(docs, "doc_id")
    assert post._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    want = [(1, w, n) for w, n in Counter(words).items()] + [(4, "w1", 2), (4, "x", 1)]
    assert collected(post, "doc_id", "token", "tf") == sorted(want)
    assert dict(collected(sparse.document_frequency(post), "token", "df")) == Counter(w for _, w, _ in want)


def test_frequencies_of_repeated_keys_equal_sql(spark, tmp_path):
    """Rows that share a key are one document, though their lengths differ, and null is no document."""
    rows = [(1, "a b b"), (1, "b c"), (1, ""), (2, "a"), (None, "a z"), (None, "z"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("term_frequency", "document_frequency"):
        got, con = registry.QUERIES[name](spark, str(tmp_path)), duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert compare.rows(got.toPandas()) == compare.rows(con.execute(registry.SQL[name]).df())
