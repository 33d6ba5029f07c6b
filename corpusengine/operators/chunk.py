"""Sections of texts and pages, and their overlapping windows as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import chunk_id
from ..functions.text import py_lines, py_strip, token_windows

#: What a section of references is called.
REFERENCES = ["references", "参考文献", "bibliography"]
SIZE, OVERLAP = 512, 64


def markdown_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section, heading, body``: a line that begins with # opens a section; one with neither heading nor body is left out.

    A document is cut where a line begins with #, within its row and without a shuffle.
    """
    whole = F.array_join(py_lines(F.coalesce(F.col(text), F.lit(""))), "\n")
    rows = docs.select(key, F.startswith(whole, F.lit("#")).cast("int").alias("begun"), F.posexplode_outer(F.split(whole, "\n(?=#)")).alias("pos", "part"))
    head = F.startswith("part", F.lit("#"))
    lines = F.split("part", "\n", 2)
    heading = F.when(head, F.regexp_replace(lines[0], "^[# ]+", "")).otherwise("")
    body = F.when(head, F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))).otherwise(F.col("part"))
    out = rows.select(key, (F.col("pos") + F.col("begun")).cast("long").alias("section"), heading.alias("heading"), body.alias("body"))
    return out.where("heading <> '' or body <> ''")


def font_sections(lines: DataFrame, key: str, seq: str = "seq", size: str = "size", text: str = "text", least: float = 12.0) -> DataFrame:
    """``key, section, heading, body`` from the lines of pages: a large line opens a section if the one before it has a body, else it is body too.

    So of large lines in a row every second one opens, beginning with the first where a small line came before and with the second where none did.
    Blank lines say nothing; sections without a body are left out. Lines of a document are ordered together.
    """
    rows = lines.select(key, seq, (F.coalesce(F.col(size), F.lit(0.0)) >= least).alias("large"), py_strip(text).alias("line")).where("line <> ''")
    ordered = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum((~F.col("large")).cast("int")).over(ordered))
    place = F.row_number().over(Window.partitionBy(key, "run", "large").orderBy(seq))
    rows = rows.withColumn("opens", F.col("large") & (place % 2 == F.when(F.col("run") > 0, 1).otherwise(0)))
    rows = rows.withColumn("section", F.sum(F.col("opens").cast("int")).over(ordered))
    said = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct(F.col(seq).alias("seq"), "line"))))
    out = rows.groupBy(key, "section").agg(F.coalesce(F.max(F.when(F.col("opens"), F.col("line"))), F.lit("")).alias("heading"), said.alias("said")).where(F.size("said") > 0)
    return out.select(key, "section", "heading", F.concat(F.array_join(F.col("said.line"), "\n"), F.lit("\n")).alias("body"))


def html_sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, section, heading, body``: what follows each h1 to h6 to the next, without tags, white space as one blank."""
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    parts = F.split(F.regexp_replace(clean, r"(?i)<h[1-6][^>]*>", "\u0001"), "\u0001")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    rows = pages.select(key, F.posexplode(parts).alias("section", "part")).where("section > 0")
    heading = F.regexp_extract("part", r"(?is)^(.*?)</h[1-6]>", 1)
    return rows.select(key, "section", plain(heading).alias("heading"), plain(F.regexp_replace("part", r"(?is)^.*?</h[1-6]>", "")).alias("body"))


def without_references(sections: DataFrame) -> DataFrame:
    name = F.lower(py_strip("heading"))
    return sections.where(~(F.startswith(name, F.lit(REFERENCES[0])) | F.startswith(name, F.lit(REFERENCES[1])) | F.startswith(name, F.lit(REFERENCES[2]))))


def chunked(sections: DataFrame, path: str = "path", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id, path, heading, chunk_index, text``: windows of each section's words, numbered through the path once references are gone.

    Chunks depend on their own path alone, so numbering partitions by it. Blank chunks are dropped after being numbered.
    """
    words = F.filter(F.split(F.col("body"), r"(?U)\s+"), lambda w: w != "")
    rows = without_references(sections).select(path, "section", "heading", words.alias("w"))
    rows = rows.select(path, "section", "heading", F.posexplode(token_windows("w", size, overlap)).alias("part", "words"))
    place = F.row_number().over(Window.partitionBy(path).orderBy("section", "part")) - 1
    rows = rows.withColumn("chunk_index", place.cast("int")).withColumn("text", F.array_join("words", " "))
    return rows.where("text <> ''").select(chunk_id(F.col(path).cast("string"), "chunk_index").alias("chunk_id"), path, "heading", "chunk_index", "text")


def missing_headings(notes: DataFrame, template: list[str], key: str, heading: str = "heading") -> DataFrame:
    """``key, missing``: the template's headings that a note lacks, in the template's order."""
    have = notes.groupBy(key).agg(F.collect_set(py_strip(heading)).alias("have"))
    return have.select(key, F.filter(F.array(*map(F.lit, template)), lambda t: ~F.array_contains("have", t)).alias("missing"))


def grep(docs: DataFrame, pattern: str, key: str, text: str = "text", limit: int | None = 30) -> DataFrame:
    """``key, line_no, line`` of lines that match, in order of key and line, the first ``limit``."""
    rows = docs.select(key, F.posexplode(py_lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    rows = rows.select(key, (F.col("line_no") + 1).alias("line_no"), "line")
    return rows if limit is None else rows.orderBy(key, "line_no").limit(limit)
