"""A vector index on disk: k-means cells, a list of vectors for each, probing of the cells nearest to a query, exact reranking.

Cosine is searched as the distance of unit vectors, so that one geometry serves both metrics: what is nearer than a bound can only lie in cells whose
centre is no further away than the bound and the cell's radius together. ``nearest`` probes a number of cells, fitted for a recall;
``nearest_exact`` probes the first ones for a bound, then all cells that the bound doesn't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dense
from .lineage import cut
from .manifest import Manifest

#: Vectors that centres are learned from, rounds of learning, and the most cells; centres are sent to all tasks.
SAMPLE, ROUNDS, CELLS = 20_000, 12, 4_096
#: Vectors of a list, and queries, that a task multiplies; queries that probes are fitted on.
TILE, QUERIES, FIT = 8_192, 2_048, 200
#: Rows of queries and cells that a task returns at once.
ROWS = 4_096
SEED = 17


def centres(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of at most ``count`` cells by Lloyd's rounds; a cell that loses all its vectors takes the one that is furthest from its centre."""
    rng = np.random.default_rng(SEED)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    at = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(ROUNDS):
        cell, far = assigned(x, at)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, x)
        n = np.bincount(cell, minlength=len(at))
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        empty = np.flatnonzero(n == 0)
        moved[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
        if np.array_equal(moved, at):
            break
        at = moved
    return at


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def assigned(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and how far it is, in pieces of a bounded matrix."""
    cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 1024):
        d = distances(x[a : a + 1024], at)
        cell[a : a + 1024] = d.argmin(1)
        far[a : a + 1024] = d.min(1)
    return cell, far


class CellIndex:
    """Rows ``(key long, vector)`` of one dimension below ``root``, for the metric ``cosine`` or ``l2``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, root)
        held = self.manifest.read()
        if held is not None:
            self.metric, self.dim, self.key = held["metric"], held["dim"], held["key"]
            rows = spark.read.parquet(f"{self.root}/centres").orderBy("cell").toPandas()  # CELLS at most
            self.at, self.radius = np.array(rows["centre"].tolist(), np.float64).reshape(len(rows), -1), rows["radius"].to_numpy(np.float64)

    @classmethod
    def build(cls, rows: DataFrame, root: str, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", cells: int | None = None) -> CellIndex:
        """Writes the index of all rows. Centres are learned from SAMPLE vectors at most, by a hash of their keys; every row is in a list.

        There are about as many cells as the root of the number of rows, unless told. Vectors that are null, of another length than the most rows, or with null
        or non-finite components aren't indexed, nor are zero vectors by cosine, or rows without a key.
        """
        spark = rows.sparkSession
        whole = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        rows = rows.where(whole & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
        rows = rows.where(F.exists("v", lambda x: x != 0)) if metric == "cosine" else rows
        sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        dim, n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (1, 0)
        rows = rows.where(F.size("v") == dim)
        count = max(1, min(CELLS, round(math.sqrt(n)) if cells is None else cells))
        taken = np.array(rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()["v"].tolist(), np.float64).reshape(-1, dim)
        at = centres(_units(taken, metric), count) if n else np.zeros((1, dim))
        sent = spark.sparkContext.broadcast(at)

        def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame["v"].tolist(), np.float64).reshape(len(frame), -1)
                cell, far = assigned(_units(x, metric), sent.value)
                yield pd.DataFrame({"key": frame["key"], "v": frame["v"], "far": far, "cell": cell})

        lists = rows.mapInPandas(listed, "key long, v array<double>, far double, cell long")
        # a full cell is written by several tasks
        lists.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{root}/lists")
        far = spark.read.schema("far double, cell long").parquet(f"{root}/lists").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell long, centre array<double>")
        places.join(far, "cell", "left").fillna({"radius": -1.0, "n": 0}).coalesce(1).write.mode("overwrite").parquet(f"{root}/centres")
        index = cls(spark, root)
        index.manifest.commit(0, {"metric": metric, "dim": dim, "key": key})
        return cls(spark, root)

    def _asked(self, queries: DataFrame, query_key: str, vector: str) -> DataFrame:
        whole = F.coalesce((F.size(vector) == self.dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        rows = queries.where(whole).select(F.col(query_key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("q"))
        return rows.where(F.exists("q", lambda x: x != 0)) if self.metric == "cosine" else rows

    def _probed(self, asked: DataFrame, chosen: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
        """``query, q, cell`` for the cells of each query that ``chosen(distances to centres, rows)`` marks."""
        metric, at = self.metric, self.spark.sparkContext.broadcast(self.at)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), 512):
                    some = frame.iloc[a : a + 512]
                    i, cell = np.nonzero(chosen(distances(_units(np.array(some["q"].tolist(), np.float64), metric), at.value), some))
                    for b in range(0, len(i), ROWS):
                        j = i[b : b + ROWS]
                        yield pd.DataFrame({"query": some["query"].to_numpy()[j], "q": some["q"].to_numpy()[j], "cell": cell[b : b + ROWS]})

        return asked.mapInPandas(run, "query long, q array<double>, cell long")

    def lists(self, probed: DataFrame) -> DataFrame:
        """``key, v, cell`` of the lists of the cells that are probed: partitions of others aren't read."""
        wanted = [r[0] for r in probed.select("cell").distinct().collect()]  # CELLS at most
        rows = self.spark.read.schema("key long, v array<double>, far double, cell long").parquet(f"{self.root}/lists")
        return rows.where(F.col("cell").isin(wanted)).select("key", "v", "cell") if wanted else rows.select("key", "v", "cell").limit(0)

    def _compared(self, probed: DataFrame, k: int) -> DataFrame:
        """``query, key, score``: of each cell that is probed the k nearest; lists are cut into tiles, and a cell's queries too."""
        metric, probed = self.metric, cut(probed)
        rows = self.lists(probed)
        sizes = self.spark.read.parquet(f"{self.root}/centres").select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int").alias("tiles"))
        sizes = sizes.join(probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "cell")
        left = probed.join(sizes, "cell").select("query", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"))
        right = rows.join(sizes, "cell").select("key", "v", "cell", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        by = ["cell", "tile", "part"]

        def near(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(found):
                return pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "score": np.zeros(0)})
            q, x, keys = np.array(queries["q"].tolist(), np.float64), np.array(found["v"].tolist(), np.float64), found["key"].to_numpy()
            q, x, best = _units(q, metric), _units(x, metric), dense.Best(len(q), k)
            for tile in dense.tiles(len(x), len(q)):
                if metric == "cosine":
                    s = q @ x[tile].T
                else:
                    s = np.empty((len(q), len(x[tile])))
                    for i, v in enumerate(q):
                        s[i] = -np.linalg.norm(x[tile] - v, axis=1)
                best.add(s, keys[tile])
            return pd.DataFrame({"query": queries["query"].to_numpy()[best.query], "key": best.key, "score": best.score})

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, "query long, key long, score double")

    def _ranked(self, found: DataFrame, k: int, query_key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key"))
        score = F.abs("score") if self.metric == "l2" else F.col("score")
        return found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias(query_key), F.col("key").alias(self.key), score.alias("score"), "rank")

    def nearest(self, queries: DataFrame, k: int = 10, probes: int = 8, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """``query_key, key, score, rank`` of the k nearest among the lists of the ``probes`` cells nearest to each query; as ``dense.nearest`` otherwise."""
        first = lambda d, _: d <= np.partition(d, min(probes, d.shape[1]) - 1, 1)[:, [min(probes, d.shape[1]) - 1]]
        return self._ranked(self._compared(self._probed(self._asked(queries, query_key, vector), first), k), k, query_key)

    def nearest_exact(self, queries: DataFrame, k: int = 10, probes: int = 8, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """As ``nearest``, and then the lists of all other cells that may hold something nearer than the k-th found, or as near; nothing is missed."""
        asked = self._asked(queries, query_key, vector)
        most = min(probes, len(self.at))
        first = lambda d: d <= np.partition(d, most - 1, 1)[:, [most - 1]]
        found = cut(self._compared(self._probed(asked, lambda d, _: first(d)), k))
        far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) if self.metric == "cosine" else F.abs("score")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
        bound = found.withColumn("place", place).where(F.col("place") == k).select("query", far.alias("bound"))
        asked = cut(asked.join(bound, "query", "left").fillna(float("inf"), ["bound"]))
        radius = self.spark.sparkContext.broadcast(self.radius)
        slack = 1e-6 if self.metric == "cosine" else 1e-9  # a cosine's rounding is a larger one of the distance

        def rest(d: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
            bounds = rows["bound"].to_numpy()[:, None]
            return ~first(d) & (radius.value >= 0) & (d - radius.value <= bounds + slack * (1 + d))

        more = self._compared(self._probed(asked, rest), k)
        return self._ranked(found.unionByName(more), k, query_key)

    def fitted(self, k: int = 10, recall: float = 0.95) -> int:
        """The least number of probes that finds the share ``recall`` of the k nearest of FIT indexed vectors, which are taken by a hash of their keys."""
        rows = self.spark.read.schema("key long, v array<double>, far double, cell long").parquet(f"{self.root}/lists")
        sample = cut(rows.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(FIT).select(F.col("key").alias("query"), F.col("v").alias("vector")))
        true = dense.nearest(sample, rows.select("key", "cell", F.col("v").alias("vector")), k, "query", "key", "vector", self.metric).select("query", "key")
        cells = true.join(rows.select("key", "cell"), "key").select("query", "cell").toPandas()  # k for each of FIT
        queries = sample.toPandas()
        if not len(queries):
            return 1
        order = np.argsort(np.argsort(distances(_units(np.array(queries["vector"].tolist(), np.float64), self.metric), self.at), 1, kind="stable"), 1)
        row = pd.Series(range(len(queries)), queries["query"]).groupby(level=0).first()
        ranks = np.sort(order[row[cells["query"]].to_numpy(), cells["cell"].to_numpy()])
        return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1


def _units(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" and len(x) else x
