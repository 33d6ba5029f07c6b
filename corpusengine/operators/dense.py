"""Dense vectors: cosine, exact nearest neighbours of a checked set of queries or of all rows, and test doubles of encoders."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Query vectors that are broadcast at once; more are taken in blocks.
QUERY_BLOCK = 2_000
#: Scores that a task holds at once: rows are compared in tiles of so many by the number of queries.
SCORES = 1 << 20
#: Components of a block of vectors, 1 MB as doubles; blocks of a part of the queries, and parts of the queries in a part of the corpus (about 40 MB).
VALUES, BLOCKS, PARTS = 1 << 17, 2, 20


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double precision over the shorter length."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    x, y = (F.transform(F.slice(_c(v), F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda s, v: s + v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """The dot product over the norms, a norm of zero counting as one."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


class Best:
    """The k best of the rows seen so far for each of n queries, by scores to nine places; ties go to the smaller key, and scores that aren't numbers don't count."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, s: np.ndarray, keys: np.ndarray) -> None:
        """Takes in the scores (queries, rows) of rows; only those that reach a query's k-th best so far are sorted."""
        # what is less than this is less when it is rounded too, so that few scores are rounded
        found = s >= (self.least - 1e-9 - 1e-12 * np.abs(self.least))[:, None]
        if s.shape[1] > self.k and np.count_nonzero(found) > 4 * self.k * len(s):
            r = np.round(s, 9)
            r[np.isnan(r)] = -np.inf
            found &= r >= np.partition(r, -self.k, axis=1)[:, [-self.k]]
        i, j = np.divmod(np.flatnonzero(found), max(1, s.shape[1]))
        touched = np.zeros(len(s), bool)
        touched[i] = True
        old = touched[self.query]  # the rest stays as it is
        query, score = np.concatenate([self.query[old], i]), np.concatenate([self.score[old], s[i, j]])
        self.key = keys[:0] if self.key is None else self.key
        key = np.concatenate([self.key[old], keys[j]])
        order = np.lexsort((key, -np.round(score, 9), query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k]
        by = np.argsort(np.concatenate([self.query[~old], query[kept]]), kind="stable")
        self.query, self.score, self.key = (np.concatenate([held[~old], new[kept]])[by] for held, new in ((self.query, query), (self.score, score), (self.key, key)))
        last = order[place == self.k - 1]
        self.least[query[last]] = np.round(score[last], 9)


def tiles(rows: int, queries: int) -> Iterator[slice]:
    """Slices of rows whose scores are SCORES at most, or one row each."""
    step = max(1, SCORES // max(1, queries))
    return (slice(a, a + step) for a in range(0, rows, step))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", metric: str = "cosine", plus: str | None = None) -> DataFrame:
    """``query_key, key, score, rank`` of the k nearest rows of the corpus by cosine, or by ``l2`` distance.

    Queries are collected in blocks of QUERY_BLOCK and sent to the corpus, which is scanned where it lies in tiles of SCORES: each is one matrix
    product, and only k rows a query leave a task. ``plus`` names a column of the corpus with a map from query keys to what is added to their scores, so that other evidence counts before
    rows are dropped. Ties go to the smaller key. Null and empty vectors, and those of other lengths than a query's or with null components, are near nothing.
    The set of queries is the small side.
    """
    spark, found = corpus.sparkSession, None
    whole = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False))
    queries, corpus = queries.where(whole), corpus.where(whole)
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    types = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]
    schema = f"`{query_key}` {types[0]}, `{key}` {types[1]}, score double"
    dealt = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v"), F.pmod(F.xxhash64(query_key), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        by_length: dict[int, list] = {}
        for r in dealt.where(F.col("block") == block).collect():
            by_length.setdefault(len(r["v"]), []).append((r["q"], r["v"]))
        if not by_length:
            continue
        sent = spark.sparkContext.broadcast({n: ([q for q, _ in rows], np.array([v for _, v in rows], np.float64)) for n, rows in by_length.items()})

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            best = {n: Best(len(ids), k) for n, (ids, _) in sent.value.items()}
            for frame in frames:
                for n, rows in frame.groupby(frame[vector].map(len), sort=False):
                    if n in best:
                        keys = rows[key].to_numpy()
                        for tile in tiles(len(rows), len(best[n].least)):
                            best[n].add(near(*sent.value[n], rows.iloc[tile]), keys[tile])
            for n, found in best.items():
                if len(found.query):
                    ids = pd.Series(sent.value[n][0])
                    yield pd.DataFrame({query_key: ids.iloc[found.query].to_numpy(), key: found.key, "score": np.abs(found.score) if metric == "l2" else found.score})

        def near(ids: list, q: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
            x = np.array(rows[vector].tolist(), np.float64)
            if metric == "cosine":
                one = lambda m: np.where(m == 0, 1, m)
                s = (q / one(np.linalg.norm(q, axis=1))[:, None]) @ (x / one(np.linalg.norm(x, axis=1))[:, None]).T
            else:
                s = np.empty((len(q), len(x)))
                for i, v in enumerate(q):
                    s[i] = -np.linalg.norm(x - v, axis=1)
            if plus is not None:
                place = {q: i for i, q in enumerate(ids)}
                for j, more in enumerate(rows[plus]):
                    for e in () if more is None else more:
                        if e["key"] in place:
                            s[place[e["key"]], j] += e["value"]
            return s

        extra = [] if plus is None else [F.map_entries(plus).alias(plus)]
        part = corpus.select(key, vector, *extra)
        part = part.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    direction = F.desc(F.round("score", 9)) if metric == "cosine" else F.asc(F.round("score", 9))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(direction, key))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def packed(rows: DataFrame, key: str, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``block, size, keys, data``, stored, and its number of partitions: the vectors of ``nearest`` as unit vectors of doubles, VALUES components a block, BLOCKS blocks of a partition."""
    whole = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False)) & F.col(key).isNotNull()
    rows = rows.where(whole).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    parts = math.ceil((rows.agg(F.sum(F.size("v"))).first()[0] or 1) / (VALUES * BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by length: keys and vectors that don't fill a block yet
        for batch in batches:
            v = batch.column("v")
            sizes, ends = pc.list_value_length(v).to_numpy(), np.cumsum(pc.list_value_length(v).to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                held.setdefault(n, []).append((batch.column("k").take(pa.array(at)), flat[(ends[at] - n)[:, None] + np.arange(n)].astype(np.float64)))
                if sum(len(keys) for keys, _ in held[n]) * n >= VALUES:
                    rest = yield from blocks(n, held.pop(n), False)
                    held |= {n: [rest]} if len(rest[0]) else {}
        for n, some in held.items():
            yield from blocks(n, some, True)

    def blocks(n: int, some: list, last: bool) -> Iterator[pa.RecordBatch]:
        keys, x = pa.concat_arrays([k for k, _ in some]), np.concatenate([m for _, m in some])
        step, done = max(1, VALUES // n), 0
        while done < len(x) if last else done + step <= len(x):
            m, length = x[done : done + step], np.linalg.norm(x[done : done + step], axis=1)
            unit = m / np.where(length == 0, 1, length)[:, None]
            yield pa.RecordBatch.from_pydict({"size": [n], "keys": pa.array([keys[done : done + step].to_pylist()], pa.list_(keys.type)), "data": [unit.tobytes()]})
            done += step
        return keys[done:], x[done:]

    found = rows.repartition(parts).mapInArrow(run, f"size long, keys array<{dict(rows.dtypes)['k']}>, data binary")
    return cut(found.withColumn("block", F.monotonically_increasing_id())), parts


def nearest_others(rows: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding") -> DataFrame:
    """``query_key, key, score, rank`` of the k nearest rows of each row by cosine, as ``nearest`` has it, those of its own key left out; rows without a key take no part.

    Every row is a query. Vectors are packed in blocks; each part of the queries' blocks meets each part of the corpus's in a task, which compares two
    blocks at a time in tiles of SCORES and gives k rows a query. No vector passes the driver, and neither a task's work nor its memory
    grows with the table; the number of tasks grows as its square.
    """
    blocks, parts = packed(rows, key, vector)
    named = lambda d, side: d.select(*(F.col(c).alias(f"{side}_{c}") for c in ("block", "size", "keys", "data")))
    corpus = blocks.coalesce(math.ceil(parts / PARTS))
    pairs = named(blocks, "q").crossJoin(named(corpus, "c").hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                if r["q_block"].as_py() != block:
                    if block is not None and len(best.query):
                        yield found(keys, best)
                    block, keys, q = r["q_block"].as_py(), r["q_keys"].values.to_numpy(zero_copy_only=False), matrix(r["q_data"], r["q_size"])
                    best, order = Best(len(keys), k), np.argsort(keys, kind="stable")
                if r["q_size"].as_py() != r["c_size"].as_py():
                    continue
                others, x = r["c_keys"].values.to_numpy(zero_copy_only=False), matrix(r["c_data"], r["c_size"])
                low, high = (np.searchsorted(keys[order], others, side) for side in ("left", "right"))
                for tile in tiles(len(x), len(keys)):
                    s = q @ x[tile].T
                    for j in np.flatnonzero(high[tile] > low[tile]):
                        s[order[low[tile][j] : high[tile][j]], j] = np.nan
                    best.add(s, others[tile])
        if block is not None and len(best.query):
            yield found(keys, best)

    def matrix(data: pa.BinaryScalar, n: pa.Int64Scalar) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), np.float64).reshape(-1, n.as_py())

    def found(keys: np.ndarray, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({query_key: keys[best.query], key: best.key, "score": best.score})

    kind = dict(rows.dtypes)[key]
    near = pairs.mapInArrow(run, f"`{query_key}` {kind}, `{key}` {kind}, score double")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def fake_vector(dim: int = 64) -> Callable[[Column], Column]:
    """An encoder for tests: unit vectors from a generator seeded by the text's md5."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            seed = int(hashlib.md5((text or "").encode("utf-8")).hexdigest()[:8], 16)
            v = np.random.RandomState(seed).uniform(-1, 1, dim)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return encode
