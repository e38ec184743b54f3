"""What the operators share: word patterns, scratch tables, small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one is set only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Bytes of a batch of rows on its way between Spark and Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold ``BATCH_BYTES`` at most: several are held at once, by Spark and by the worker, and each worker keeps its largest."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siltstone/{what}-{uuid.uuid4().hex}"
        self._n = 0
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, df: DataFrame) -> None:
        """Delete the files of a saved table that no later step reads."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(self.spark, file)


class Bucketed:
    """Rows dealt once to files bucketed and sorted by ``key``: joins and groups by it read them without a shuffle.

    ``distinct`` keeps one row of a key (the smallest value of each column). There are as many buckets as shuffles have partitions, unless
    given. The catalogue knows the table only while it is written; ``rows`` goes on reading its files, which ``delete`` removes.
    """

    def __init__(self, rows: DataFrame, key: str, scratch: Scratch, distinct: bool = False, buckets: int | None = None):
        self.spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(self.spark)
        self.path = f"{scratch.root}/{name}"
        rows = rows.repartition(self.buckets, key)
        (
            (rows.groupBy(key).agg(*(F.min(c).alias(c) for c in rows.columns if c != key)) if distinct else rows)
            .write.format("parquet").option("compression", "zstd").option("path", self.path)
            .bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        )
        self.rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")

    def delete(self) -> None:
        delete(self.spark, self.path)


#: Tables up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, n_rows: int, row_bytes: int = 32, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its ``n_rows`` rows of about ``row_bytes`` stay under ``limit``, else as it is."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now; it waits for the JVM to collect what referred to them."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def col(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has columns called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
