"""An inverted index that is kept: immutable segments of postings by token bucket, tombstones, deltas of frequencies, merges.

A batch writes one segment: the postings of its documents, the changes of document frequencies that it makes, its documents' own terms, and the keys whose
older postings it makes void. What was indexed before isn't rewritten; a removed document's frequencies are taken back from its terms, which
stand in the bucket of its key. Scores equal those of an index made anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .manifest import Manifest
from .sparse import K1, B, counted, okapi_idf, ranked, tokens

#: Parts that the rows of a bucket are written in, as a common token's postings may be most of them; and rows of a part, about, beyond which there are more parts.
SPREAD, PART = 4, 500_000


class InvertedIndex:
    """Documents ``(key, text)`` below ``root``; keys are of the type given."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", kind: str = "long", buckets: int = 64) -> None:
        self.spark, self.key, self.kind, self.manifest = spark, key, kind, Manifest(spark, root)
        held = self.manifest.read()
        self.buckets = held["buckets"] if held else buckets
        self._schemas = {
            "documents": f"`{key}` {kind}, dl long, terms array<struct<token string, tf long>>", "postings": f"token string, `{key}` {kind}, tf long, dl long",
            "frequencies": "token string, df long", "tombstones": f"`{key}` {kind}",
        }

    def _bucket(self, by: str | Column) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, number: int, rows: DataFrame, by: str, size: int = 0) -> None:
        path = f"{self.manifest.root}/{table}/segment={number}"
        rows = rows.withColumn("bucket", self._bucket(by))
        parts = max(SPREAD, math.ceil(size / (PART * self.buckets)))
        spread = [F.pmod(F.xxhash64(self.key), F.lit(parts))] if self.key in rows.columns else []
        # more parts than usual are dealt to as many tasks, as otherwise those that sort them would grow
        dealt = rows.repartition(parts * self.buckets, "bucket", *spread) if spread and parts > SPREAD else rows.repartition("bucket", *spread)
        dealt.sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, table: str, segments: list[int]) -> DataFrame:
        schema = f"{self._schemas[table]}, segment int, bucket int"
        if not segments:
            return self.spark.createDataFrame([], schema)
        base = f"{self.manifest.root}/{table}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/segment={n}" for n in segments))

    def _only(self, rows: DataFrame, by: str | Column, asked: DataFrame) -> DataFrame:
        """Of a table the buckets that hold what is asked for: others aren't read."""
        wanted = [r[0] for r in asked.select(self._bucket(by)).distinct().collect()]  # buckets at most
        return rows.where(F.col("bucket").isin(wanted)) if wanted else rows.limit(0)

    def _newest(self, segments: list[int]) -> DataFrame:
        """``key, newest``: keys that a later segment has written anew or removed, and the last that did."""
        return self._read("tombstones", segments).groupBy(self.key).agg(F.max("segment").alias("newest"))

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """Rows of documents or postings that no later segment makes void."""
        return rows.join(self._newest(segments), self.key, "left").where(F.col("newest").isNull() | (F.col("segment") >= F.col("newest"))).drop("newest")

    def apply(self, number: int, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Adds or replaces the documents ``fresh(key, text)`` and removes the keys of ``gone``, in one segment.

        Numbers ascend; the same one again replaces its segment. Of rows that share a key, one counts; rows without one are left out, and a key in both
        is replaced.
        """
        key, held = self.key, self.manifest.read(number) or {"segments": [], "n": 0, "total": 0}
        fresh = self.spark.createDataFrame([], f"`{key}` {self.kind}, text string") if fresh is None else fresh.select(key, "text").where(F.col(key).isNotNull()).dropDuplicates([key])
        names = cut(fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key).where(F.col(key).isNotNull())).distinct())
        # keys are told apart, so that each row's tokens are counted by themselves
        own = cut(counted(fresh, key).select(key, F.col("dl").cast("long").alias("dl"), "terms"))
        post = own.select(key, "dl", F.explode("terms").alias("t")).select("t.token", key, "t.tf", "dl")
        size = own.agg(F.coalesce(F.sum(F.coalesce(F.size("terms"), F.lit(0))), F.lit(0))).first()[0]
        before = self._only(self._read("documents", held["segments"]), key, names)
        old = cut(self._live(before, held["segments"]).join(names, key, "left_semi"))
        self._write("documents", number, own, key)
        self._write("postings", number, post, "token", size)
        change = post.select("token", F.lit(1).alias("df")).unionByName(old.select(F.explode("terms.token").alias("token"), F.lit(-1).alias("df")))
        self._write("frequencies", number, change.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), "token")
        self._write("tombstones", number, old.select(key), key)
        sums = [d.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() for d in (self._read("documents", [number]), old)]
        n, total = (held[c] + sums[0][i] - sums[1][i] for i, c in enumerate(("n", "total")))
        self.manifest.commit(number, {"buckets": self.buckets, "segments": [*held["segments"], number], "n": n, "total": total})

    def documents(self) -> DataFrame:
        """``key, dl, terms`` of all that is indexed."""
        segments = (self.manifest.read() or {"segments": []})["segments"]
        return self._live(self._read("documents", segments), segments).select(self.key, "dl", "terms")

    def frequencies(self) -> DataFrame:
        """``token, df`` of all that is indexed."""
        segments = (self.manifest.read() or {"segments": []})["segments"]
        return self._read("frequencies", segments).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def merge(self, number: int) -> None:
        """One segment in place of all: what is void goes, frequencies are summed."""
        held = self.manifest.read(number)
        if held is None:
            return
        for table, by in (("documents", self.key), ("postings", "token")):
            read = self._read(table, held["segments"])
            self._write(table, number, self._live(read, held["segments"]).drop("segment", "bucket"), by, read.count() if table == "postings" else 0)
        self._write("frequencies", number, self._read("frequencies", held["segments"]).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"), "token")
        self._write("tombstones", number, self.spark.createDataFrame([], f"`{self.key}` {self.kind}"), self.key)
        self.manifest.commit(number, held | {"segments": [number]})

    def clean(self, keep: int = 1) -> None:
        """Removes segments that none of the newest ``keep`` commits names."""
        named = {n for m in self.manifest.forget(keep) for n in m["segments"]}
        for table in self._schemas:
            for name in self.manifest.children(table):
                if name.startswith("segment=") and int(name.removeprefix("segment=")) not in named:
                    self.manifest.remove(f"{table}/{name}")

    def okapi(self, queries: DataFrame, query_key: str = "query_id", k1: float = K1, b: float = B) -> DataFrame:
        """``query_key, key, score`` for documents that share a token with the query, as ``sparse.okapi`` has it; only the buckets of the queries' tokens are read."""
        held = self.manifest.read() or {"segments": [], "n": 0, "total": 0}
        asked = queries.select(query_key, F.explode(tokens("text")).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("qf"))
        weights = cut(asked.join(okapi_idf(cut(self.frequencies()), held["n"]), "token"))
        hits = self._only(self._read("postings", held["segments"]), "token", weights).join(weights, "token")
        hits = self._live(hits, held["segments"])
        norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(held["total"] / held["n"] if held["n"] else 1.0))
        return hits.groupBy(query_key, self.key).agg(F.sum(F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("score"))

    def top(self, queries: DataFrame, k: int = 10, query_key: str = "query_id") -> DataFrame:
        """``query_key, key, score, rank`` of the k best for each query."""
        return ranked(self.okapi(queries, query_key), [query_key], "score", self.key, k)
