"""Queries of vaults and feeds, which are written from documents and read by their data sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, new_folder
from ..sources import files, papers, readers
from .papers import _SECTIONS, _WORK, ATOM, TEI, WORK
from .retrieval import table


def written(rows: DataFrame, root: str) -> int:
    """Writes each row of ``rows(path, text)`` as a file below the root, and counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = readers.opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                system.create_dir(f"{base}/{row['path'].rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{base}/{row['path']}") as f:
                    f.write(row["text"].encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def vault_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Papers rendered as notes in a folder for each source, written as a vault; those below some folders are read back."""
    docs = table(spark, sf, "documents")
    shown = files.rendered(papers.tei_sections(docs.select("doc_id", F.expr(TEI).alias("xml")), "doc_id"), "doc_id")
    notes = shown.join(docs.select("doc_id", "source"), "doc_id").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    root = new_folder(spark, "vault")
    written(notes, root)
    readers.register(spark)
    rows = spark.read.format("vault").option("path", root).load()
    return rows.where(F.col("path").startswith("src1")).select("path", "length", "text")


def _feeds(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Files of both feeds: works a line each, entries a feed for each twenty documents."""
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).cast("long").alias("pack"), "doc_id", F.expr(WORK).alias("work"), F.expr(ATOM).alias("entry"))
    sorted_ = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c))), lambda s: s[c])
    packs = cut(docs.groupBy("pack").agg(F.array_join(sorted_("work"), "\n").alias("works"), F.array_join(F.filter(sorted_("entry"), lambda e: e.endswith("</entry>")), "").alias("entries")))
    roots = new_folder(spark, "works"), new_folder(spark, "entries")
    written(packs.select(F.concat(F.col("pack").cast("string"), F.lit(".jsonl")).alias("path"), F.col("works").alias("text")), roots[0])
    # every seventh feed is cut off
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "entries", F.when(F.col("pack") % 7 == 3, F.lit("")).otherwise(F.lit("</feed>")))
    written(packs.select(F.concat(F.col("pack").cast("string"), F.lit(".xml")).alias("path"), feed.alias("text")), roots[1])
    return roots


def feed_works(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.read_papers(spark, "openalex", _feeds(spark, sf)[0])
    return rows.select(F.col("seq.path").alias("path"), *(c for c in rows.columns if c != "seq"))


def feed_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Records and unreadable files of a feed."""
    readers.register(spark)
    rows = spark.read.format("feed").option("path", _feeds(spark, sf)[1]).load()
    return rows.groupBy(F.col("error").isNotNull().alias("unreadable")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


QUERIES = {f.__name__: f for f in (vault_notes, feed_works, feed_errors)}
SQL = {
    "vault_notes": f"""SELECT path, strlen(text)::BIGINT AS length, text FROM (SELECT source || '/' || doc_id || '.md' AS path, string_agg('## ' || heading || chr(10) || body, chr(10) || chr(10) ORDER BY k) AS text
  FROM ({_SECTIONS}) JOIN documents USING (doc_id) GROUP BY doc_id, source) WHERE path LIKE 'src1%'""",
    "feed_works": f"SELECT (seq // 20) || '.jsonl' AS path, * EXCLUDE (seq) FROM ({_WORK})",
    "feed_errors": "SELECT doc_id // 20 % 7 = 3 AS unreadable, CASE WHEN doc_id // 20 % 7 = 3 THEN count(DISTINCT doc_id // 20) ELSE count(*) FILTER (doc_id % 11 <> 3) END AS n, count(DISTINCT doc_id // 20) AS files FROM documents GROUP BY 1, doc_id // 20 % 7 = 3",
}
