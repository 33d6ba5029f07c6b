"""Lineage cuts and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .store import filesystem


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in this one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows through a reliable checkpoint: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows through a Parquet table in the shared folder, in folders by the columns named, for what is too wide for ``cut``."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame | str) -> None:
    """Removes stored tables and folders that nothing reads any more, as all that follows from them is stored."""
    for table in tables:
        for path in [table] if isinstance(table, str) else {f.rpartition("/")[0] for f in table.inputFiles()}:
            fs, at = filesystem(f"{path}/x")
            fs.delete_dir(at.rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of what is stored by now, which it does when it collects garbage."""
    spark.sparkContext._jvm.System.gc()
