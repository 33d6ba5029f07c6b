"""A training-data pipeline: each stage filters or rewrites what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusengine.llm import decontam, mixing, passages, simhash, toxicity
from corpusengine.llm.shared import discarded, stored


#: Rows of an Arrow batch while stages run: texts are long, and a worker holds a batch several times over.
ARROW_ROWS = 500


def arrow_rows(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches in this session; texts go to workers a few at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't reject."""
    arrow_rows(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: the least."""
    arrow_rows(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a lesser document keeps."""
    arrow_rows(spark)
    return passages.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule calls clean."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that is taken of a document, with the columns of documents and ``copy`` (from 1)."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and the fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next, which is the last to need it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        discarded(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
