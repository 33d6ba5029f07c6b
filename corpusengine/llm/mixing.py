"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, stored

#: The weights that sources take in turn, the share of all words that is mixed, the most of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size that are meant to be put in order together.
PER_CELL = 10_000
#: A cell with so many times that is one of many equal rows, and cut further.
FULL = 4


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` and ``salt``, 60 bits of a digest of id and text, by which documents of a source and size are in order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return docs.select("*", size.alias("size"), F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long").alias("salt"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a source.

    Sources take the weights in turn by code point, null last. Filling by weight until each source
    stops at ``most`` times its size is one level that all open sources reach: sources close in the order
    of cap over weight, and the level follows from sums over those already closed: it is that of the first that stays
    open, the greatest of all that lie below their caps.
    """
    everyone = Window.partitionBy()
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = by_source.withColumn("turn", (F.row_number().over(turn) - 1) % len(weights))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(everyone))
    closing = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = closing.rowsBetween(Window.unboundedPreceding, -1)
    after = closing.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("open_level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, per_cell: int = PER_CELL) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, source, text)``.

    Within a source every document expects target / source_size copies. Documents stand in a
    fixed order (size, digest of id and text); the prefix sum of expected copies is the rate times the
    place, and a document is emitted once for each integer that the sum, begun at one offset drawn from
    the source's name, crosses at it. As sizes ascend, the words taken are within twice the largest document of the target. Places
    come from counts of cells (source, size, first bits of the digest), and those from counts of sizes, so no task ever holds a source's documents;
    cells are as small as keeps about ``per_cell`` documents of the most frequent size together, and one that equal rows fill is cut by where these are stored. All sources, a row each, pass through one task.

    A null text or one without words has size 0; a source of such documents takes 0 words. Null is a source of its
    own. Rows that repeat a doc_id are documents of their own, ties between equal rows broken arbitrarily. No rows give
    no rows. Other columns are ignored.
    """
    rows = cut(sizes(docs.select("doc_id", "source", "text")).drop("text"))
    rows = _drawn(rows, rows, weights, share, most, per_cell)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _drawn(counted: DataFrame, rows: DataFrame, weights: tuple[int, ...], share: float, most: float, per_cell: int) -> DataFrame:
    """``rows(doc_id, source, size, salt, ...)`` with ``source_size, target, copies``; ``counted`` has the same sources, sizes and salts."""
    levels = cut(counted.groupBy("source", "size").agg(F.count("*").alias("n")))
    largest = int(levels.agg(F.max("n")).first()[0] or 0)
    bits = min(60, max(4, math.ceil(math.log2(max(1, largest / per_cell)))))
    cell = F.shiftright("salt", 60 - bits)
    by_source = targets(levels.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("level_at", F.coalesce(F.sum("n").over(earlier("source").orderBy("size")), F.lit(0))).drop("n")
    key = ["source", "size", "cell"]
    cells = counted.groupBy("source", "size", cell.alias("cell")).agg(F.count("*").alias("n"))
    full = cut(cells.where(F.col("n") > FULL * per_cell).select(*key, F.lit(True).alias("full")))
    rows = rows.withColumn("cell", cell)
    if not full.isEmpty():
        # only equal rows fill a cell so: they are told apart by where they are stored, and a cell's digests and ids by themselves
        rows = stored(rows.withColumn("part", F.spark_partition_id()), "mix")
        fine = F.when(F.col("full"), F.struct("salt", "doc_id", "part"))
        rows = _null_safe(rows, full, *key, how="left").withColumn("fine", fine).drop("full", "part")
        key = [*key, "fine"]
        cells = rows.groupBy(*key).agg(F.count("*").alias("n"))
    cells = cells.withColumn("cell_at", F.coalesce(F.sum("n").over(earlier("source", "size").orderBy(*key[2:])), F.lit(0))).drop("n")
    cells = _null_safe(cells, levels, "source", "size").withColumn("at", F.col("level_at") + F.col("cell_at")).drop("level_at", "cell_at")
    cells = _null_safe(cells, by_source, "source")
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("\u0000")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = cells.withColumn("rate", rate).withColumn("offset", offset)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("salt", "doc_id")))
    rows = _null_safe(rows, cells, *key)
    place = (F.col("at") + F.col("place")).cast("double")
    copies = F.floor(F.col("rate") * place + F.col("offset")) - F.floor(F.col("rate") * (place - 1.0) + F.col("offset"))
    return rows.withColumn("copies", copies.cast("long"))


def _null_safe(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left's key columns."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"r_{k}"])
    return left.join(renamed, on, how).drop(*(f"r_{k}" for k in keys))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every column of ``docs`` (but one named ``copy``) and ``copy`` (from 1), a row for each copy that ``mixed`` emits.

    Texts are shuffled once, by cell; each row has copies of its own, also those without an id or with one that is repeated.
    """
    columns = [c for c in docs.columns if c != "copy"]
    counted = cut(sizes(docs.select("doc_id", "source", "text")).select("source", "size", "salt"))
    rows = sizes(docs.select("doc_id", "source", "text", F.struct(*columns).alias("row"))).select("doc_id", "source", "size", "salt", "row")
    drawn = _drawn(counted, rows, WEIGHTS, SHARE, MOST, PER_CELL).where("copies > 0")
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in columns), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for ``mixed`` less ``copies``, over a relation with doc_id, source and text."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS salt FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS whole FROM s),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY size, salt, doc_id) AS DOUBLE) AS place,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  CAST(('0x' || substr(md5(coalesce(d.source, chr(0))), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate * place + off) - floor(rate * (place - 1.0::DOUBLE) + off)) AS BIGINT) * size AS taken FROM p
"""
