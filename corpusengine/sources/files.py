"""Vaults of files and append-only logs."""

from __future__ import annotations

import glob
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import denied_path

#: Path segments that are never read.
DENIED = [".git", ".claude"]

AUDIT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("event_type", "span_id", "trace_id", "session_id", "agent_type", "tool_name", "risk_level")),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("parent_id", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("turn", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("started_at", "ended_at", "policy_decision", "result_status")), T.StructField("duration_ms", T.LongType()),
    T.StructField("security_scan", T.StructType([T.StructField("violations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("rule_id", "severity", "snippet")])))])),
    *(T.StructField(n, T.StringType()) for n in ("error", "result_summary")), T.StructField("policy_rules", T.MapType(T.StringType(), T.StringType())),
    *(T.StructField(n, T.StringType()) for n in ("approval_outcome", "causation_id", "model")), *(T.StructField(n, T.IntegerType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")), T.StructField("finish_reason", T.StringType()),
])


def vault(spark: SparkSession, root: str, suffixes: str = "[mM][dD],[pP][dD][fF]") -> DataFrame:
    """``path, mtime, length`` of the files below a root with one of the suffixes, denied paths left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{suffixes}}}").load(root)
    files = files.select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length")
    return files.where(~denied_path("path", DENIED))


def globbed(spark: SparkSession, root: str, pattern: str, limit: int = 50) -> DataFrame:
    """``path`` of the first files below a root, in order, whose path from there matches a glob (``**`` for any folders); denied paths are left out.

    No pattern leads out of the root, as only what is below it is listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:")) + "/", "")
    return files.where(below.rlike("^" + glob.translate(pattern, recursive=True, include_hidden=True, seps="/")) & ~denied_path("path", DENIED)).orderBy("path").limit(limit)


def texts(spark: SparkSession, root: str, glob: str = "*.[mM][dD]") -> DataFrame:
    """``path, mtime, text`` of whole files as UTF-8, malformed bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def is_pdf(content: str = "content"):  # noqa: ANN201
    return F.substring(F.col(content), 1, 4) == F.lit(b"%PDF")


def named(files: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """Files whose base name is the one given but for white space and case; the caller sees by the count whether it is the only one."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"(?U)\s+", " "))
    rows = files.where(norm(F.element_at(F.split("path", "/"), -1)) == norm(F.lit(name)))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with its declared schema; lines that aren't JSON come as nulls."""
    return spark.read.schema(AUDIT).json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, a folder for each day they started on."""
    events.withColumn("dt", F.substring("started_at", 1, 10)).write.mode("append").partitionBy("dt").json(path)


def only(files: DataFrame, name: str) -> str:
    """The path of the one file that ``named`` finds; FileNotFoundError if there is none, ValueError if there are several."""
    found = [r["path"] for r in named(files, name, 2).collect()]
    if len(found) > 1:
        raise ValueError(f"{name!r} isn't the only file of its name")
    if not found:
        raise FileNotFoundError(name)
    return found[0]


def rendered(sections: DataFrame, key: str, order: str = "section") -> DataFrame:
    """``key, text``: sections as they are shown, ``## heading`` and the body below, an empty line between; ``heading`` and ``body`` must not be null."""
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "heading", "body"))).alias("s"))
    return rows.select(key, F.array_join(F.transform("s", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n"), s["body"])), "\n\n").alias("text"))
