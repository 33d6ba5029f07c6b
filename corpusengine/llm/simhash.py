"""SimHash fingerprints and their near-duplicates by exact comparison of tiles.

Equal fingerprints are one row with a smallest doc_id before anything is compared. Two fingerprints that differ in at most
``radius`` bits agree wholly on one of radius + 1 equal parts of their bits, so rows meet in groups that share the last bits of a part; this
loses no link, and spreads the comparison over as many tasks as there are values. A group is cut into tiles in the order of its population counts. Tiles
are compared with each other by exclusive-or and bit counts, a pair whose population counts are further apart than the
radius is skipped, and of the links found in a pair of tiles only a spanning forest leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut
from .words import batches, spaced, tokenise

#: Fixed values of the contract.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a tile; two tiles and their matrix of differences are what a task holds.
TILE = 2048


def fingerprint_batch(texts: pd.Series) -> np.ndarray:
    """A fingerprint for each text, whole."""
    w = tokenise(texts)
    count = np.diff(w.first)
    out = np.zeros(len(count), np.uint64)
    data, at = spaced(w)  # any shingle is a run of these bytes
    digest = xxhash.xxh64_intdigest
    last = np.maximum(count - (SHINGLE - 1), np.minimum(count, 1))  # shingles of each text
    begin = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(last)[:-1]]), last) + np.arange(last.sum())
    stop = np.minimum(begin + SHINGLE, np.repeat(w.first[1:], last))
    pairs = zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)
    h = np.fromiter((digest(data[a:b], SEED) for a, b in pairs), np.uint64, len(begin))
    some = np.flatnonzero(last)
    if len(some):
        starts = (np.cumsum(last) - last)[some]
        value = np.zeros(len(some), np.uint64)
        for byte, octet in enumerate(h.view(np.uint8).reshape(-1, 8).T):  # the counts of eight bits at a time, each in a lane of its own
            lanes = _SPREAD[octet]
            ones = _segment_sums(lanes, starts, last[some])
            over = 2 * ones > last[some][:, None]
            value |= (over.astype(np.uint64) << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(1, dtype=np.uint64)
        out[some] = value
    return out


_SPREAD = np.array([[x >> i & 1 for i in range(8)] for x in range(256)], np.uint8)
_SPREAD = (_SPREAD.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


def _segment_sums(lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per segment the sums of the eight byte lanes; a lane holds 255 ones, so longer segments are summed in pieces."""
    pieces = -(-sizes // 255)
    cut_at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.add.reduceat(lanes, cut_at)
    split = sums[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
    return np.add.reduceat(split.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) and the long columns ``also``, which hold no null, for every row of ``docs(doc_id, text)``; null texts and texts without words get zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield frame[["doc_id", *also]].assign(fp=fingerprint_batch(frame["text"]).view(np.int64))

    # ids as text: pandas would turn longs with nulls among them into floats
    rows = docs.select(F.col("doc_id").cast("string"), *also, "text").mapInPandas(run, ", ".join(["doc_id string", *(f"{c} long" for c in also), "fp long"]))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: edges between rows of ``distinct(id long, fp long)`` that connect just those that chains of links connect.

    A link joins fingerprints that differ in ``radius`` bits or fewer. Ids must be distinct.
    """
    parts = radius + 1
    width = 64 // parts
    # as many bits of a part as make groups of about a tile; fewer bits only compare more
    bits = min(width, max(0, math.ceil(math.log2(max(1, distinct.count()) / tile))))
    keys = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << bits) - 1).alias("value")) for i in range(parts)]
    rows = distinct.select("id", "fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("key")).select("id", "fp", "ones", "key.*")
    sizes = cut(rows.groupBy("part", "value", "ones").agg(F.count("*").alias("n")))
    # tiles are runs of population counts; a count with more rows than a tile is dealt over several by a hash
    upto = Window.partitionBy("part", "value").orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("part", "value")
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(whole)}).where("all > 1")
    low = F.floor(F.col("before") / tile)
    sizes = cut(sizes.select("part", "value", "ones", low.alias("low"), F.greatest(F.lit(1), F.floor((F.col("before") + F.col("n") - 1) / tile) - low + 1).alias("over")))
    dealt = rows.join(sizes, ["part", "value", "ones"])
    dealt = cut(dealt.select("part", "value", "id", "fp", "ones", (F.col("low") + F.pmod(F.xxhash64("id"), "over")).alias("tile")))
    ends = cut(dealt.groupBy("part", "value", "tile").agg(F.min("ones").alias("least"), F.max("ones").alias("most")))
    left, right = (ends.select("part", "value", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "least", "most"))) for s in "lr")
    near = (F.col("tile_l") <= F.col("tile_r")) & (F.col("least_r") <= F.col("most_l") + radius) & (F.col("least_l") <= F.col("most_r") + radius)
    pairs = cut(left.join(right, ["part", "value"]).where(near).select("part", "value", "tile_l", "tile_r"))
    both = pairs.select("part", "value", "tile_l", "tile_r", F.explode(F.array_distinct(F.array("tile_l", "tile_r"))).alias("tile"))
    # a number of partitions of its own: the rows are few bytes and much work, which adaptive execution would put into a few tasks
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = both.join(dealt, ["part", "value", "tile"]).repartition(tasks, "part", "value", "tile_l", "tile_r")
    return sent.groupBy("part", "value", "tile_l", "tile_r").applyInPandas(lambda pdf: _compare(pdf, radius), "a long, b long")


def _compare(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links between a tile pair's two tiles, or within the tile paired with itself."""
    pdf = pdf.sort_values("id")
    left, right = pdf[pdf["tile"] == pdf["tile_l"]], pdf[pdf["tile"] == pdf["tile_r"]]
    x, y = left["fp"].to_numpy().view(np.uint64), right["fp"].to_numpy().view(np.uint64)
    same = pdf["tile_l"].iat[0] == pdf["tile_r"].iat[0]
    rows, cols = [], []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[at : at + 256, None] ^ y[None, :]) <= radius)
        keep = i + at < j if same else slice(None)
        rows.append(i[keep] + at)
        cols.append(j[keep])
    a, b = left["id"].to_numpy()[np.concatenate(rows)], right["id"].to_numpy()[np.concatenate(cols)]
    return pd.DataFrame(dict(zip("ab", spanning(a, b), strict=True)))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between longs, one from each end to the smallest it reaches: at most as many as there are ends."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            far = root[root]
            if (far == root).all():
                break
            root = far
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reached by links, its own included. Rows that repeat a doc_id
    keep a row each; a row with a null doc_id keeps its fingerprint and takes the component of equal or linked fingerprints,
    null if there is none. Null and wordless texts have the fingerprint zero and link like any other. No rows give no rows.
    """
    fps = cut(fingerprints(docs))
    classes = components(fps)
    leasts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(classes.join(leasts, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components(fps: DataFrame) -> DataFrame:
    """``fp, least, root``: the distinct fingerprints of ``fps(doc_id, fp)`` with their least doc_id and what names their component."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # links join fingerprints, by the fingerprints themselves; a component's id is the least doc_id over it
    edges = links(distinct.select(F.col("fp").alias("id"), "fp"))
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    return cut(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, but one a component: that of the least doc_id, of several with it one by a hash of the text.

    Rows without a doc_id come last; of rows that are equal in both one stays.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("k2"))
    fps = cut(fingerprints(keyed, "k", "k2"))
    named = fps.join(components(fps.select("doc_id", "fp")).select("fp", "root"), "fp")
    rows = named.groupBy("root", "k", "k2").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "k2", "n")).alias("at"))
    kept = cut(least.select("at.k", "at.k2", "at.n"))
    out = keyed.join(kept.where("n = 1"), ["k", "k2"]).select("row.*")
    many = kept.where("n > 1")
    if many.isEmpty():
        return out
    repeated = keyed.join(many, ["k", "k2"]).withColumn("place", F.row_number().over(Window.partitionBy("k", "k2").orderBy("n"))).where("place = 1")
    return out.unionByName(repeated.select("row.*"))
