"""Exact dedup against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, shared_dir, shuffle_partitions


class DigestIndex:
    """Digests of all texts seen so far, as a table bucketed and sorted by digest.

    One row a digest: ``digest`` (SHA-256 of the UTF-8 text), ``keep_id`` (the document
    that stays), ``group_size`` (documents of the load that brought it). The files
    outlive the session: open the same ``path`` again with the same ``buckets``.

    Loads are deduplicated by a sort-merge anti-join that also brings back what the index knows of the digests it holds: the index
    is read bucket by bucket without a shuffle, and only the load's distinct digests move. What did not match is appended. ``close`` takes
    the table out of the session's catalogue; the files stay.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def digests(self) -> DataFrame:
        """The whole index, bucketed."""
        return self.spark.table(self.table)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def matched(self, groups: DataFrame) -> DataFrame:
        """``groups`` (``digest``, ``keep_id``, ``group_size``) as the index knows them where it does; ``fresh`` where not."""
        known = self.digests().select(F.col("digest").alias("seen"), F.col("keep_id").alias("seen_id"), F.col("group_size").alias("seen_size"))
        fresh = F.col("seen").isNull()
        return groups.join(known.hint("merge"), F.col("digest") == F.col("seen"), "left").select(
            "digest",
            F.when(fresh, F.col("keep_id")).otherwise(F.col("seen_id")).alias("keep_id"),
            F.when(fresh, F.col("group_size")).otherwise(F.col("seen_size")).alias("group_size"),
            fresh.alias("fresh"),
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and within itself; append its new digests.

        Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
        ``text_sha256``. Of equal texts in one load the largest id stays; a text that
        an earlier load brought is not kept, and its ``keep_id`` is that load's.
        ``group_size`` counts the documents with the text in the load that brought it.

        Null text counts as empty; texts are equal when their bytes are. Rows that
        repeat an id are one document and share its decision; a null id stays
        only where the whole group has null ids. An empty table gives no
        rows. Other columns are not read and may have any name.

        The digest of a hot text is counted before it is shuffled; the way back from groups to
        rows is a plain equi-join of narrow rows, whose large partitions adaptive execution splits.
        """
        load = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
        )
        scratch = Scratch(self.spark, "digests")
        load = scratch.save(load, "load")
        groups = load.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        if self.buckets != shuffle_partitions(self.spark):
            groups = groups.repartition(self.buckets, "digest")
        groups = scratch.save(self.matched(groups), "groups")
        (
            groups.where("fresh").drop("fresh").repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )
        return load.join(groups, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one load of a fresh index."""
    path = f"{shared_dir(spark)}/siltstone/digest-index-{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, buckets=shuffle_partitions(spark))
    found = index.add(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index.close()
    return found


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
