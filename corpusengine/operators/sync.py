"""Incremental synchronisation of an index with its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(state: DataFrame, scan: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    """``key, change``: new, changed (any difference, older times too), unchanged or removed."""
    old, new = state.select(key, F.col(stamp).alias("old"), F.lit(True).alias("had")), scan.select(key, F.col(stamp).alias("new"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return old.join(new, key, "full").select(key, change.alias("change"))


def replaced(existing: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """``existing`` without the keys in ``gone``, and the fresh rows."""
    return existing.join(gone.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upserted(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return replaced(existing, fresh, fresh, key)


def all_documents(chunks: DataFrame, key: str = "id") -> DataFrame:
    """``key, text, path, mtime`` of everything stored; a missing path is empty and a missing time zero."""
    return chunks.select(key, "text", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"))


def parsed_once(files: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame], key: tuple[str, ...] = ("path", "mtime", "length"), value: str = "parsed") -> DataFrame:
    """``key, value, fresh``: what the cache holds of a file, and ``parse(files)`` of those whose path, time or size it lacks.

    ``parse`` gives ``key, value``, and a null value where it fails; failures aren't to be cached, see ``cacheable``.
    """
    known = files.select(*key).distinct()
    hits = known.join(cache.select(*key, value), list(key)).withColumn("fresh", F.lit(False))
    misses = files.join(cache.select(*key), list(key), "left_anti")
    return hits.unionByName(parse(misses).select(*key, value).withColumn("fresh", F.lit(True)))


def cacheable(parsed: DataFrame, value: str = "parsed") -> DataFrame:
    """What ``parsed_once`` adds to the cache."""
    return parsed.where(F.col("fresh") & F.col(value).isNotNull()).drop("fresh")


def state_of(chunks: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    return chunks.groupBy(key).agg(F.max(stamp).alias(stamp))
