"""Table functions of SQL against the operators, and what analysis refuses."""

import pytest
from pyspark.errors import AnalysisException

from corpusengine.functions import tables
from corpusengine.functions.text import token_windows, tokens
from corpusengine.operators import chunk

TEXTS = [(1, "# A\nb c\n\n## \n#x\ny"), (2, None), (3, ""), (4, "no head\r\n# h"), (5, "w " * 25), (6, "##\n\n# t  ")]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    df = spark.createDataFrame(TEXTS, "k int, text string")
    df.createOrReplaceTempView("docs_of_tables")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windows(spark, docs):
    got = spark.sql("SELECT * FROM token_windows(TABLE(docs_of_tables), column => 'text', overlap => 3, size => 10)")
    assert got.columns == ["k", "window", "words"]
    want = docs.select("k", token_windows(tokens("text"), 10, 3).alias("w")).collect()
    assert rows(got) == sorted((r["k"], i, " ".join(w)) for r in want for i, w in enumerate(r["w"]))


def test_sections(spark, docs):
    got = spark.sql("SELECT k, section, heading, body FROM markdown_sections(TABLE(docs_of_tables), 'text')")
    assert rows(got) == rows(chunk.markdown_sections(docs, "k"))


def test_lines(spark, docs):
    got = spark.sql("SELECT k, line_no, line FROM matching_lines(TABLE(SELECT * FROM docs_of_tables WHERE k < 5), column => 'text', pattern => '^#')")
    assert rows(got) == [(1, 0, "# A"), (1, 3, "## "), (1, 4, "#x"), (4, 1, "# h")]


@pytest.mark.parametrize(("call", "message"), [
    ("token_windows(TABLE(docs_of_tables), column => 'none', size => 10, overlap => 3)", "no column 'none'"),
    ("token_windows(TABLE(docs_of_tables), column => 'k', size => 10, overlap => 3)", "holds no text"),
    ("token_windows(TABLE(docs_of_tables), column => 'text', size => 'ten', overlap => 3)", "constant int"),
    ("token_windows(TABLE(docs_of_tables), column => 'text', size => 3, overlap => 3)", "less than size"),
    ("token_windows(1, column => 'text', size => 3, overlap => 1)", "must be a table"),
    ("matching_lines(TABLE(docs_of_tables), column => 'text', pattern => '(')", "pattern"),
    ("matching_lines(TABLE(docs_of_tables), column => 'text', patern => 'a')", "patern|PATERN|unexpected|UNRECOGNIZED|missing"),
    ("markdown_sections(TABLE(SELECT 1 AS section, '' AS text), 'text')", "already"),
])
def test_wrong_arguments_are_refused_at_analysis(spark, docs, call, message):
    with pytest.raises(AnalysisException, match=message):
        spark.sql(f"SELECT * FROM {call}")
