"""A table in buckets of its key that is replaced key by key: a commit rewrites the buckets it touches, and no others."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifest import Manifest
from .sync import replaced


class BucketTable:
    """Rows below ``root`` by hash buckets of ``key``. A bucket's rows are the files of the last commit that touched it, as the manifest says."""

    def __init__(self, spark: SparkSession, root: str, key: str = "path", buckets: int = 64) -> None:
        self.spark, self.key, self.manifest = spark, key, Manifest(spark, root)
        held = self.manifest.read()
        self.buckets = held["of"] if held else buckets

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, below: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """All rows as of the newest commit (of a lower number, if given), or those of some buckets; None before there is one."""
        held = self.manifest.read(below)
        if held is None:
            return None
        schema = StructType.fromJson(json.loads(held["schema"]))
        paths = [f"{self.manifest.root}/data/version={v}/bucket={b}" for b, v in held["versions"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, number: int, fresh: DataFrame, gone: DataFrame | None = None, stamp: str | None = None) -> list[int]:
        """Puts the rows of ``fresh`` in place of those of their keys, and removes the keys of ``gone``; returns the buckets written.

        With ``stamp``, keys whose rows all have the stamp that is held already are left as they are, so a batch that says nothing new writes nothing. The same
        number replaces what it committed before. Rows without a key are left out.
        """
        key, below = self.key, self.manifest.read(number)
        fresh = fresh.where(F.col(key).isNotNull())
        names = fresh.select(key).distinct()
        if stamp is not None and below is not None:
            new, old = (d.groupBy(key).agg(F.min(stamp).alias(f"{s}0"), F.max(stamp).alias(f"{s}1")) for d, s in ((fresh, "_new"), (self.read(number), "_old")))
            same = new.join(old, key).where(F.col("_new0").eqNullSafe(F.col("_old0")) & F.col("_new1").eqNullSafe(F.col("_old1"))).select(key)
            fresh, names = fresh.join(same, key, "left_anti"), names.join(same, key, "left_anti")
        names = names if gone is None else names.unionByName(gone.select(key).where(F.col(key).isNotNull())).distinct()
        touched = sorted(r[0] for r in names.select(self._bucket(key).alias("b")).distinct().collect())  # buckets at most
        versions = dict(below["versions"]) if below else {}
        if touched:
            have = self.read(number, touched)
            rows = fresh if have is None else replaced(have, fresh, names, key)
            rows.withColumn("bucket", self._bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.manifest.root}/data/version={number}")
            written = {n.removeprefix("bucket=") for n in self.manifest.children(f"data/version={number}") if n.startswith("bucket=")}
            versions = {b: v for b, v in versions.items() if int(b) not in touched} | {b: number for b in written}
        if touched or below is None:
            schema = fresh.schema.json() if below is None else below["schema"]
            self.manifest.commit(number, {"of": self.buckets, "schema": schema, "versions": versions})
        return touched

    def clean(self, keep: int = 2) -> list[str]:
        """Removes files that none of the newest ``keep`` commits names; returns what went."""
        named = {(str(b), str(v)) for m in self.manifest.forget(keep) for b, v in m["versions"].items()}
        went = []
        for version in self.manifest.children("data"):
            v = version.removeprefix("version=")
            buckets = [n for n in self.manifest.children(f"data/{version}") if n.startswith("bucket=")]
            old = [b for b in buckets if (b.removeprefix("bucket="), v) not in named]
            for name in [f"data/{version}"] if len(old) == len(buckets) else [f"data/{version}/{b}" for b in old]:
                self.manifest.remove(name)
                went.append(name)
        return went
