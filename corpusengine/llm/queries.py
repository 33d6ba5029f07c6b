"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hpylm, lexical, mixing, neighbours, pagetext, passages, resampling, simhash, toxicity, urlfilter, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scored(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tk")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extracted(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents")).drop("dk")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("payload", "record", "of_record")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(_table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_model": op1_language_model, "op2_decontamination": op2_decontamination, "op3_mixing": op3_mixing, "op4_passages": op4_passages, "op5_warc": op5_warc, "op6_embeddings": op6_embeddings, "op7_page_text": op7_page_text, "op8_toxicity": op8_toxicity, "op9_simhash": op9_simhash, "op10_urls": op10_urls, "op11_resampling": op11_resampling, "op12_neighbours": op12_neighbours, "op13_search": op13_search, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.oracle(), "op3_mixing": mixing.oracle(), "op5_warc": warc.oracle(), "op10_urls": urlfilter.oracle(), "op11_resampling": resampling.oracle(), "op13_search": lexical.oracle()}
