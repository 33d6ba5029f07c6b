"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors are one row with a weight. A table's bucket is the signs of a few projections; buckets are cut into tiles, and a task gets
two tiles of one bucket, whose cosines are one matrix product in double precision. A pair that meets in several tables is counted in
the first of these alone, so numbers of links are exact over the pairs found; tasks emit sums of links and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut
from .simhash import spanning

COSINE = 0.9
#: The chance that a pair at just the least cosine meets in some table; closer pairs meet more surely.
RECALL = 0.995
#: Rows that a bucket is meant to have, by which the number of signs follows the number of vectors; rows in a tile.
BUCKET, TILE = 512, 1024
SEED = 20


def tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs a table and tables for n vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    signs = min(30, max(1, round(math.log2(max(2, n) / BUCKET))))
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**signs)))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector has a direction: not null or empty, every component a finite number, not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hashed(signs: int, count: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            lengths = frame["embedding"].map(len)
            for dim, part in frame.groupby(lengths, sort=False):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, signs * count))
                x = np.array(part["embedding"].tolist(), np.float64)
                bits = (x @ planes[dim] >= 0).reshape(len(x), count, signs)
                keys = (bits * (1 << np.arange(signs, dtype=np.int64))).sum(2).astype(np.int32)
                yield pd.DataFrame({"id": part["id"], "m": part["m"], "dim": dim, "vector": [v.tobytes() for v in x], "keys": [k.tobytes() for k in keys], "key": list(keys)})

    return run


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of two tiles of a bucket: rows (id, null, links) for sums and (id, other id, 0) for a spanning forest."""
    table, same = int(pdf["table"].iat[0]), pdf["tile_l"].iat[0] == pdf["tile_r"].iat[0]
    sides = []
    for side in ("tile_l", "tile_r"):
        part = pdf[pdf["tile"] == pdf[side]].sort_values("id")
        x = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
        with np.errstate(over="ignore"):
            scale = np.abs(x).max(1, keepdims=True)
        x = x / scale
        sides.append((part["id"].to_numpy(), part["m"].to_numpy(), x / np.sqrt((x * x).sum(1, keepdims=True)), np.frombuffer(b"".join(part["keys"]), np.int32).reshape(len(part), -1)[:, :table]))
    (ids, ms, x, ks), (ids2, ms2, y, ks2) = sides
    sums, sums2, rows, cols = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64), [], []
    for at in range(0, len(x), 128):
        got = x[at : at + 128] @ y.T
        i, j = np.nonzero(got >= cosine - 1e-12)
        keep = i + at < j if same else np.ones(len(i), bool)
        for p in np.flatnonzero(keep & (np.abs(got[i, j] - cosine) < 1e-12)):  # too near the bound for a sum in any order
            keep[p] = math.fsum(x[at + i[p]] * y[j[p]]) >= cosine
        i, j = i[keep] + at, j[keep]
        rows.append(i)
        cols.append(j)
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= ks[i, t] != ks2[j, t]
        sums += np.bincount(i[first], ms2[j[first]], len(ids)).astype(np.int64)
        sums2 += np.bincount(j[first], ms[i[first]], len(ids2)).astype(np.int64)
    i, j = np.concatenate(rows), np.concatenate(cols)
    a, b = spanning(ids[i], ids2[j])
    ends, n = np.concatenate([ids, ids2]), np.concatenate([sums, sums2])
    linked = n > 0
    out = pd.DataFrame({"a": np.concatenate([ends[linked], a]), "b": pd.array([pd.NA] * int(linked.sum()) + b.tolist(), "Int64"), "n": np.concatenate([n[linked], np.zeros(len(a), np.int64)])})
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
    null vec_id (their component is null) or vectors of unequal length. Of rows that repeat a vec_id
    each is a vector that the others of its id count like any other, and all share a component. No rows give no rows.
    """
    # equal vectors meet by 128 bits of hashes, so that only longs are join keys
    same = ["h", "h2"]
    rows = embeddings.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding").alias("h2"), (usable() & F.col("vec_id").isNotNull()).alias("ok"))
    classes = rows.where("ok").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    classes = cut(classes)
    signs, count = tables(classes.count(), cosine, recall)
    schema = "id long, m long, dim int, vector binary, keys binary, key array<int>"
    hashed = cut(classes.select("id", "m", "embedding").mapInPandas(_hashed(signs, count), schema))
    places = hashed.select("id", "dim", F.posexplode("key").alias("table", "key"))
    sizes = cut(places.groupBy("table", "dim", "key").agg(F.count("*").alias("n")).where("n > 1"))
    sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    pairs = sizes.select("table", "dim", "key", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("x"))
    pairs = pairs.select("table", "dim", "key", "tiles", "x", F.explode(F.sequence(F.col("x"), F.col("tiles") - 1)).alias("y"))
    pairs = cut(pairs.select("table", "dim", "key", "tiles", F.col("x").alias("tile_l"), F.col("y").alias("tile_r"), F.explode(F.array_distinct(F.array("x", "y"))).alias("tile")))
    # a row joins its bucket to learn the tiles, then its tile's pairs
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = places.join(sizes, ["table", "dim", "key"]).select("table", "dim", "key", "id", tile.alias("tile"))
    sent = cut(dealt).join(pairs.drop("tiles"), ["table", "dim", "key", "tile"])
    # a number of partitions of its own: adaptive execution would go by bytes and put much work into few tasks
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.join(hashed.drop("key", "dim"), "id").repartition(tasks, "table", "dim", "key", "tile_l", "tile_r")
    found = cut(sent.groupBy("table", "dim", "key", "tile_l", "tile_r").applyInPandas(lambda pdf: _compare(pdf, cosine), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.select(*same, "id", "m").join(links, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    named = cut(named.select(*same, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "id").alias("root")))
    linked = rows.where("ok").select("vec_id", *same).join(named, same).select("vec_id", "n", "root")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("root"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("root"), F.lit(False)).alias("kept"))
