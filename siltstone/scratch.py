"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set in its place only where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{what}-{uuid.uuid4().hex}"


def saver(spark: SparkSession, what: str = "table") -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to a folder of its own and gives the table read back."""

    def save(df: DataFrame) -> DataFrame:
        path = new_folder(spark, what)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now; it waits for the JVM to collect what referred to them."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of every file below ``path``, sorted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, each = [], where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while each.hasNext():
        file = each.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return sorted(found)
