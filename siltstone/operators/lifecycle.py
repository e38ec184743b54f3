"""The life of stored documents: upsert, tombstones, purge, reconcile, retention, erasure. Tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source", "external_id"]


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after ``incoming``: excluded rows stay, equal hashes are touched, others replaced, new ones added; ``action`` says which."""
    old = stored.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("indexed_at").alias("old_at"))
    new = incoming.select(*KEY, F.col("content_hash").alias("new_hash"), F.col("indexed_at").alias("new_at"))
    both = old.join(new, KEY, "full_outer")
    action = (
        F.when(F.col("new_hash").isNull(), "keep")
        .when(F.col("old_status") == "excluded", "skip")
        .when(F.col("old_hash").isNull(), "insert")
        .when((F.col("old_hash") == F.col("new_hash")) & (F.col("old_status") == "active"), "touch")
        .otherwise("replace")
    )
    both = both.withColumn("action", action)
    stays = F.col("action").isin("keep", "skip")
    return both.select(
        *KEY,
        "action",
        F.when(stays, F.col("old_status")).otherwise("active").alias("status"),
        F.when(stays, F.col("old_hash")).otherwise(F.col("new_hash")).alias("content_hash"),
        F.when(stays, F.col("old_at")).otherwise(F.col("new_at")).alias("indexed_at"),
    )


def reconcile(enumerated: DataFrame, stored: DataFrame, run_started) -> DataFrame:
    """What a crawl has to do with each item: keep, index, delete or remove_tombstone.

    ``enumerated`` has the fingerprints of the sources, ``stored`` those of the store with the time of modification and the content hash. A stored
    row without a fingerprint is unchanged where the new one starts with its time or contains its hash. A null fingerprint counts as not
    seen. Unseen rows go unless they were indexed after ``run_started`` or come from the manual source; unseen tombstones are removed.
    """
    seen = enumerated.where(F.col("fingerprint").isNotNull()).select(*KEY, F.col("fingerprint").alias("new"))
    both = seen.join(stored, KEY, "full_outer")
    same = F.when(F.coalesce("fingerprint", F.lit("")) != "", F.col("fingerprint") == F.col("new")).otherwise(
        F.startswith("new", F.col("modified").cast("string")) | F.contains("new", F.col("content_hash"))
    )
    action = (
        F.when(F.col("status").isNull(), "index")
        .when(F.col("new").isNotNull() & (F.col("status") == "excluded"), "keep")
        .when(F.col("new").isNotNull() & F.coalesce(same, F.lit(False)), "keep")
        .when(F.col("new").isNotNull(), "index")
        .when(F.col("source") == "manual", "keep")
        .when(F.col("status") == "excluded", "remove_tombstone")
        .when(F.col("indexed_at") >= run_started, "keep")
        .otherwise("delete")
    )
    return both.select(*KEY, action.alias("action"))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Documents, chunks, terms and outgoing links without the documents of ``gone``; inbound links and vectors stay."""
    keys = {"documents": "doc_id", "chunks": "doc_id", "terms": "chunk_id", "links": "from_doc"}
    return {name: df.join(gone.select(F.col("doc_id").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def tombstone(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """Documents with the marked ones excluded (never of the manual source)."""
    hit = documents.join(marked.select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("hit") & (F.col("source") != "manual"), "excluded").otherwise(F.col("status"))
    return hit.withColumn("status", status).drop("hit")


def retained(rows: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows that are not older than ``days`` at ``as_of``."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))


def retention(tables: dict[str, tuple[DataFrame, str, int]], as_of) -> DataFrame:
    """``name``, ``kept``, ``dropped`` of each table (rows, time column, days): what ``retained`` leaves of it. Rows without a time are kept."""

    def counted(name: str, rows: DataFrame, ts: str, days: int) -> DataFrame:
        old = F.coalesce(F.col(ts) < as_of - F.make_dt_interval(days=F.lit(days)), F.lit(False))
        return rows.agg(F.lit(name).alias("name"), F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))

    return reduce(DataFrame.unionByName, [counted(name, *of) for name, of in tables.items()])


def erased(tables: dict[str, tuple[DataFrame, str]], persons: DataFrame, blank: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables (rows, column of the person) without what ``persons`` (``person``) left in them.

    In a table that ``blank`` names, the person's rows stay, for the counts that rest on them: texts of the listed columns become ``[erased]`` and the person null. In
    the others their rows go. A null person is nobody's; persons may be many and are joined, not collected.
    """
    who = persons.select(F.col("person").alias("__person")).where(F.col("__person").isNotNull()).distinct()
    out = {}
    for name, (rows, key) in tables.items():
        if name not in blank:
            out[name] = rows.join(who, F.col(key) == F.col("__person"), "left_anti")
            continue
        hit = rows.join(who, F.col(key) == F.col("__person"), "left")
        mine = F.col("__person").isNotNull()
        changed = {c: F.when(mine & F.col(c).isNotNull(), "[erased]").otherwise(F.col(c)) for c in blank[name]} | {key: F.when(~mine, F.col(key))}
        out[name] = hit.withColumns(changed).drop("__person")
    return out
