"""Approximate nearest neighbours by cross-polytope hashing: pseudo-rotations, nearest signed axes, multiprobe tables, exact reranking.

A vector is divided by the greatest norm of all and gets one more component that makes it a unit vector, a query is divided by its own norm and gets a
zero, so that inner products order candidates as the original ones do. A pseudo-rotation is three rounds of random signs and a fast
Hadamard transform; the hash is the signed axis that the result is nearest to, or one such axis from each of several rotations if there are many vectors. A query
probes in each table the buckets whose axes it is nearest to. How many, is fitted: a bounded sample of queries is compared with all vectors, and
the least number is taken that finds the share TARGET of their true neighbours.

Equal vectors are hashed and compared once. Buckets are cut into tiles, tiles are dealt to bins, and a query goes to a bin once, whatever it probes there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discarded, stored
from .vectors import usable

#: Fixed values of the contract: neighbours, and queries are rows whose id this divides.
K, ONE_IN = 20, 20
TABLES, ROUNDS, SEED = 4, 3, 12
#: Rows that a bucket is meant to have at most, by which rotations a table follow the number of vectors.
BUCKET = 4096
#: Queries that the number of probes is fitted on, the share of their neighbours that it must find, and the most probes of a table with several rotations.
SAMPLE, TARGET, PROBES = 256, 0.95, 4096
#: Probes a table that are made first, for a bound of what the others may find.
FIRST = 4
#: Vectors of a bucket that a task multiplies at once; vectors and queries that a task holds.
TILE, BIN, QUERIES = 2048, 8192, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two, scaled to keep norms."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows, n)
        step *= 2
    return x / math.sqrt(n)


def axes(unit: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Nearness of each row to the signed axes (positive ones first) after a table's pseudo-rotation number ``turn``."""
    width = 1 << (unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, unit.shape[1], table, turn]).choice([-1.0, 1.0], (ROUNDS, width))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], 1)


def bucket_keys(unit: np.ndarray, depth: int) -> np.ndarray:
    """The bucket of each row in every table: its nearest axes as digits of one number."""
    out = np.zeros((len(unit), TABLES), np.int64)
    for table in range(TABLES):
        for turn in range(depth):
            near = axes(unit, table, turn)
            out[:, table] = out[:, table] * near.shape[1] + near.argmax(1)
    return out


def probes(unit: np.ndarray, table: int, depth: int, most: int) -> np.ndarray:
    """For each row the buckets of a table by the squares of what their axes lack to the nearest ones, ``most`` of them at most."""
    keys, cost = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for turn in range(depth):
        near = axes(unit, table, turn)
        lack = (near.max(1, keepdims=True) - near) ** 2
        order = np.argsort(lack, 1, kind="stable")[:, :most]
        both = (cost[:, :, None] + np.take_along_axis(lack, order, 1)[:, None, :]).reshape(len(unit), -1)
        named = (keys[:, :, None] * near.shape[1] + order[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(both, 1, kind="stable")[:, :most]
        cost, keys = np.take_along_axis(both, best, 1), np.take_along_axis(named, best, 1)
    return keys


def lifted(x: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """Vectors as unit vectors with a component for what their norm lacks to the longest."""
    y = x / scale / longest
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))], 1)


def aimed(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, without a part in the last component."""
    y = x / np.abs(x).max(1, keepdims=True)
    return np.concatenate([y / np.sqrt((y * y).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of each row of x with the same row of y, summed from the first component on, so that they don't depend on what else is in an array."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def nearest_in(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and inner product of at least the k rows nearest to each query; what ties with them comes too, numbers only."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = queries @ rows.T
        kth = np.partition(s, -k, 1)[:, [-k]] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
        slack = 1e-12 * np.abs(queries).sum(1, keepdims=True) * np.abs(rows).max()
        q, r = np.nonzero(~(s < kth - slack))
        score = products(queries[q], rows[r])
    known = ~np.isnan(score)
    return q[known], r[known], score[known]


def best_of(found: pd.DataFrame, by: str, k: int) -> pd.DataFrame:
    """The k rows of highest score of each query, ties by the least id."""
    found = found.sort_values([by, "score", "least"], ascending=[True, False, True])
    return found[found.groupby(by).cumcount() < k]


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


class Searcher:
    """Classes of equal vectors, hashed and dealt to buckets; made once and searched with any of them."""

    def __init__(self, embeddings: DataFrame, k: int = K, one_in: int = ONE_IN) -> None:
        self.k, self.spark = k, embeddings.sparkSession
        self.kind = np.float32 if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
        same = ["h", "h2"]
        self.rows = embeddings.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding").alias("h2")).where(usable() & F.col("vec_id").isNotNull())
        classes = self.rows.groupBy(*same).agg(F.min("vec_id").alias("least"), F.max(F.col("vec_id") % one_in == 0).alias("asked"), F.first("embedding").alias("embedding"))
        # of equal vectors the k + 1 least ids can be among a query's nearest
        first = self.rows.select(*same, "vec_id", F.dense_rank().over(Window.partitionBy(*same).orderBy("vec_id")).alias("place")).where(F.col("place") <= k + 1)
        ids = first.groupBy(*same).agg(F.collect_set("vec_id").alias("ids"))
        self.classes = cut(classes.join(ids, same).withColumn("c", F.monotonically_increasing_id()))
        self.count = self.classes.count()

    def fit(self) -> None:
        """Scales, rotations a table, hashes and probes."""
        size = self.classes.agg(F.max(F.array_max(F.transform("embedding", F.abs))).cast("double"), F.max(F.size("embedding"))).first()
        self.scale, width = size[0], 2 << size[1].bit_length()
        length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / self.scale) ** 2)
        self.longest = math.sqrt(self.classes.agg(F.max(length)).first()[0])
        self.depth = min(62 // width.bit_length(), max(1, round(math.log(max(1, self.count / BUCKET)) / math.log(width))))
        while True:
            self.hashed = self._hashed()
            self.most = self._probes()
            if self.most or self.depth == 1:
                return
            self.depth -= 1  # the tables of several rotations don't find enough

    def _hashed(self) -> DataFrame:
        scale, longest, depth, kind = self.scale, self.longest, self.depth, self.kind

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for _, part in frame.groupby(frame["embedding"].map(len), sort=False):
                    x = np.array(part["embedding"].tolist(), np.float64)
                    yield pd.DataFrame({"c": part["c"], "least": part["least"], "asked": part["asked"], "vector": [v.tobytes() for v in x.astype(kind)], "keys": list(bucket_keys(lifted(x, scale, longest), depth))})

        return cut(self.classes.select("c", "least", "asked", "embedding").mapInPandas(run, "c long, least long, asked boolean, vector binary, keys array<long>"))

    def _probes(self) -> int:
        """The least number of probes a table that finds TARGET of the true neighbours of SAMPLE queries; 0 if PROBES don't."""
        k, kind = self.k, self.kind
        sample = self.hashed.where("asked").orderBy(F.xxhash64("c")).limit(SAMPLE).select("c", "vector").toPandas()
        if not len(sample):
            return 1
        found = self._scanned(sample)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
        true = found.where("query <> c").withColumn("place", place).where(F.col("place") <= k).select("query", "keys").toPandas()  # k rows a sampled query
        if not len(true):
            return 1
        keys = np.array(true["keys"].tolist(), np.int64)
        lowest = np.full(len(true), np.iinfo(np.int64).max)
        at = {}
        for _, group in sample.groupby(sample["vector"].map(len)):
            ids, unit = group["c"], aimed(_rows(group["vector"], kind))
            width = 2 << (unit.shape[1] - 1).bit_length()
            most = width if self.depth == 1 else min(PROBES, width**self.depth)
            for table in range(TABLES):
                at |= {(int(c), table): {int(key): i for i, key in enumerate(row)} for c, row in zip(ids, probes(unit, table, self.depth, most), strict=True)}
        for i, query in enumerate(true["query"]):
            lowest[i] = min(at[query, table].get(int(keys[i, table]), lowest[i]) for table in range(TABLES))
        wanted = np.sort(lowest)[math.ceil(TARGET * len(lowest)) - 1]
        return 0 if wanted == np.iinfo(np.int64).max else int(wanted) + 1

    def _scanned(self, queries: pd.DataFrame) -> DataFrame:
        """``query, c, score, least, keys``: of each task's vectors the k + 1 nearest to each of the queries (c, vector), QUERIES of them at most."""
        k, kind = self.k, self.kind
        sent = self.spark.sparkContext.broadcast([(g["c"].to_numpy(), _rows(g["vector"], kind)) for _, g in queries.groupby(queries["vector"].map(len))])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for frame in frames:
                for n, part in frame.groupby(frame["vector"].map(len), sort=False):
                    for ids, vectors in sent.value:
                        if vectors.shape[1] * np.dtype(kind).itemsize != n:
                            continue
                        for a in range(0, len(part), TILE):
                            some = part.iloc[a : a + TILE]
                            q, r, score = nearest_in(vectors, _rows(some["vector"], kind), k + 1)
                            found = pd.DataFrame({"query": ids[q], "c": some["c"].to_numpy()[r], "score": score, "least": some["least"].to_numpy()[r], "keys": some["keys"].to_numpy()[r]})
                            held = best_of(found if held is None else pd.concat([held, found]), "query", k + 1)
            if held is not None:
                yield held

        return self.hashed.mapInPandas(run, "query long, c long, score double, least long, keys array<long>")

    def nearest(self) -> DataFrame:
        """``c, found``: for each class that has queries its k + 1 nearest as structs ``(place, vec_id, score)``, nearest first."""
        k, kind, depth, most = self.k, self.kind, self.depth, self.most
        hashed = self.hashed.withColumn("dim", F.length("vector"))
        place = F.xxhash64("dim", "table", "key")
        placed = hashed.select("c", "dim", F.posexplode("keys").alias("table", "key")).select("c", place.alias("place"))
        tiles = cut(placed.groupBy("place").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
        dealt = placed.join(tiles, "place").select("c", F.xxhash64("place", F.pmod(F.xxhash64("c"), F.col("tiles"))).alias("tile"))

        def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for dim, part in frame.groupby("dim", sort=False):
                    for a in range(0, len(part), 256):
                        some = part.iloc[a : a + 256]
                        unit = aimed(_rows(some["vector"], kind))
                        for table in range(TABLES):
                            yield pd.DataFrame({"c": some["c"], "dim": dim, "table": table, "keys": list(probes(unit, table, depth, most))})

        wanted = hashed.where("asked").select("c", "dim", "vector").mapInPandas(probed, "c long, dim int, table int, keys array<long>")
        wanted = wanted.select("c", "dim", "table", F.posexplode("keys").alias("order", "key")).select("c", "order", place.alias("place")).join(tiles, "place")
        wanted = cut(wanted.select("c", "order", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64("place", t.cast("long")))).alias("tile")))
        # the first buckets give a bound that all others must reach, so that the rows found don't follow the number of bins
        found = stored(self._compared(dealt, wanted.where(F.col("order") < FIRST), None), "found")
        self.tables = [found]
        if most > FIRST:
            bound = self._best(found).where(F.col("place") == k + 1).select(F.col("query").alias("c"), F.col("score").alias("bound"))
            self.tables.append(stored(self._compared(dealt, wanted.where(F.col("order") >= FIRST), bound), "found"))
            found = found.unionByName(self.tables[1])
        each = cut(self._listed(found))
        # queries that found less than they should are compared with all vectors, in blocks
        whole = each.where(F.col("place") == k + 1).select(F.col("query").alias("c"))
        lacking = cut(self.hashed.where("asked").join(whole, "c", "left_anti").select("c", "vector"))
        blocks = math.ceil(lacking.count() / QUERIES)
        if blocks:
            each = each.join(lacking.select(F.col("c").alias("query")), "query", "left_anti")
            for block in range(blocks):
                some = lacking.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == block).toPandas()
                if len(some):
                    each = each.unionByName(self._listed(self._scanned(some).drop("keys")))
        return each.groupBy(F.col("query").alias("c")).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))

    def _listed(self, found: DataFrame) -> DataFrame:
        """``query, place, vec_id, score``: the k + 1 nearest ids of the candidates found."""
        best = self._best(found).where(F.col("place") <= self.k + 1).select("query", "c", "score")
        each = best.join(self.classes.select("c", "ids"), "c").select("query", "score", F.explode("ids").alias("vec_id"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("place", place).where(F.col("place") <= self.k + 1)

    @staticmethod
    def _best(found: DataFrame) -> DataFrame:
        """Each candidate of a query once, with its ``place``."""
        once = found.repartition("query").groupBy("query", "c").agg(F.first("score").alias("score"), F.first("least").alias("least"))
        return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least")))

    def _compared(self, dealt: DataFrame, wanted: DataFrame, bound: DataFrame | None) -> DataFrame:
        """``query, c, score, least``: of the tiles that queries probe, those of each bin's k + 1 nearest that reach the query's bound."""
        k, kind = self.k, self.kind
        bins = max(1, math.ceil(self.count * TABLES / BIN))
        wanted = cut(wanted.groupBy("c", F.pmod("tile", F.lit(bins)).alias("bin")).agg(F.collect_set("tile").alias("tiles")))
        # a bin that many queries probe is sent to several tasks, each with some of them
        parts = cut(wanted.groupBy("bin").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
        asking = wanted.join(parts, "bin").join(self.hashed.select("c", "vector"), "c")
        asking = asking.withColumn("bound", F.lit(-math.inf)) if bound is None else asking.join(bound, "c", "left").fillna(-math.inf, ["bound"])
        asking = asking.select("bin", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "c", "tiles", "vector", "bound")
        sent = dealt.withColumn("bin", F.pmod("tile", F.lit(bins))).join(parts, "bin").join(self.hashed.select("c", "least", "vector"), "c")
        sent = sent.select("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "c", "tile", "least", "vector")

        def best(out: list[pd.DataFrame]) -> pd.DataFrame:
            return best_of(pd.concat(out).drop_duplicates(["query", "c"]), "query", k + 1)

        def compared(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "score": np.zeros(0), "least": np.zeros(0, np.int64)})]
            of = dict(tuple(rows.groupby("tile", sort=False)))
            for tile, some in queries.explode("tiles").groupby("tiles", sort=False):
                part = of.get(tile, rows.iloc[:0])
                for n, same in some.groupby(some["vector"].map(len), sort=False):
                    alike = part[part["vector"].map(len) == n]
                    for a in range(0, len(same) if len(alike) else 0, 1024):
                        these = same.iloc[a : a + 1024]
                        q, r, score = nearest_in(_rows(these["vector"], kind), _rows(alike["vector"], kind), k + 1)
                        near = score >= these["bound"].to_numpy()[q]
                        out.append(pd.DataFrame({"query": these["c"].to_numpy()[q[near]], "c": alike["c"].to_numpy()[r[near]], "score": score[near], "least": alike["least"].to_numpy()[r[near]]}))
                if len(out) > 64:
                    out = [best(out)]
            return best(out)

        return sent.groupBy("bin", "part").cogroup(asking.groupBy("bin", "part")).applyInPandas(compared, "query long, c long, score double, least long")


def nearest(embeddings: DataFrame, k: int = K, one_in: int = ONE_IN) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose vec_id ``one_in`` divides, its k nearest others by inner product, as found.

    Scores are inner products in double precision, ties go to the smaller vec_id; a query with fewer other vectors gets all of them. Queries whose
    buckets hold fewer than k + 1 vectors are compared with all. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without a vec_id, take no part. Vectors of unequal length aren't compared, nor are
    those whose product isn't a number. A row that repeats another whole counts once; of rows that share only their vec_id each is a candidate, none for
    its own id. No queries give no rows. Other columns are ignored.
    """
    searcher = Searcher(embeddings, k, one_in)
    if not searcher.count:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    searcher.fit()
    found = searcher.nearest()
    by_class = cut(searcher.classes.where("asked").select("c", "h", "h2").join(found, "c").select("h", "h2", "found"))
    discarded(*searcher.tables)
    queries = searcher.rows.where(F.col("vec_id") % one_in == 0).select(F.col("vec_id").alias("query_id"), "h", "h2").distinct()
    others = queries.join(by_class, ["h", "h2"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    each = others.select("query_id", F.posexplode("found").alias("at", "one"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
