"""A stream of changes applied to a table: each micro-batch is merged once, however often it is delivered.

The table is a folder of buckets by hash of the key. A micro-batch rewrites only the buckets that it touches, under its own number, and then writes a version: the list
of each bucket's newest number. The version is the last thing written, so a batch that dies half-way is done again from the version
before it, and a batch whose version stands is skipped. Deleted keys stay as tombstones, so that an older change that comes late does not bring them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

_VERSION = "bucket int, batch long"


class MergedTable:
    """Rows by ``key``, the newest by ``order``; changes have ``action`` ('upsert' or 'delete') and the columns of ``schema``.

    ``order`` never goes back for a key's newest row: changes may come late, twice or in any order. Of changes of equal order the delete counts, of equal
    upserts any (they should be one and the same). A null key is a key. ``action``, ``changes`` and ``bucket`` are names that ``schema`` must not have.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, buckets: int = 32):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = T.StructType([*schema.fields, T.StructField("action", T.StringType()), T.StructField("changes", T.LongType())])
        self._names = [f.name for f in schema.fields]

    def version(self) -> int | None:
        """Number of the last batch that is in the table; None for none."""
        if not scratch.exists(self.spark, f"{self.path}/versions"):
            return None
        done = [f.rsplit("/", 2)[-2] for f, _, _ in scratch.files(self.spark, f"{self.path}/versions") if f.endswith("/_SUCCESS")]
        return max((int(name.removeprefix("batch=")) for name in done), default=None)

    def _places(self) -> dict[int, int]:
        last = self.version()
        rows = [] if last is None else self.spark.read.schema(_VERSION).json(f"{self.path}/versions/batch={last}").collect()
        return {r.bucket: r.batch for r in rows}  # a row a bucket

    def _rows(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in places.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, tombstones: bool = False) -> DataFrame:
        """The table: ``schema`` and ``changes`` (how many were applied to the key); with ``action`` and deleted rows if asked for."""
        found = self._rows(self._places())
        return found if tombstones else found.where("action <> 'delete'").drop("action")

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Apply a batch of changes. Batches are numbered in ascending order; one that is in the table already is skipped."""
        last = self.version()
        if last is not None and batch <= last:
            return
        new = changes.select(*self._names, "action", F.lit(1).cast("long").alias("changes"))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        new = scratch.saver(self.spark, "changes")(new.withColumn("bucket", bucket))
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        places = self._places()
        old = self._rows({b: n for b, n in places.items() if b in touched}).withColumn("bucket", bucket)
        newest = F.max_by(F.struct(*self._names, "action"), F.struct(F.col(self.order), F.col("action") == "delete"))
        merged = old.unionByName(new).groupBy("bucket", F.col(self.key).alias("merged_key")).agg(newest.alias("row"), F.sum("changes").alias("changes"))
        out = merged.select("row.*", "changes", "bucket").repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        listed = list((places | dict.fromkeys(touched, batch)).items())
        self.spark.createDataFrame(listed, _VERSION).coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/batch={batch}")

    def vacuum(self) -> None:
        """Delete batches that the newest version does not read, and older versions. Not while readers hold an older one."""
        kept, last = set(self._places().values()), self.version()
        for what, keep in (("data", kept), ("versions", {last})):
            names = {f.split(f"/{what}/batch=")[1].split("/")[0] for f, _, _ in scratch.files(self.spark, f"{self.path}/{what}")}
            for name in names - {str(b) for b in keep}:
                scratch.delete(self.spark, f"{self.path}/{what}/batch={name}")

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Merge all that a stream of changes has available."""
        writer = changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.start().awaitTermination()
