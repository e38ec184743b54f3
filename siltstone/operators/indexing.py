"""Documents into the index: what changed is cut into chunks and written as one change, what is gone or switched off goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .postings_index import PostingsIndex

STORED = "doc_id long, fingerprint string, status string"


def decided(documents: DataFrame, stored: DataFrame, enabled: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``action`` of every document that was enumerated or is stored.

    ``documents`` (``doc_id``, ``subtype``, ``fingerprint``) are what the sources have, ``stored`` (``doc_id``, ``fingerprint``, ``status``) what the base has, ``enabled`` (``subtype``) what
    the settings switch on. An excluded document stays out (``excluded``); a switched-off one goes if it is stored (``delete``) or is left (``disabled``); one of the same fingerprint
    is ``unchanged``, the others are to be indexed (``index``); what is stored and not enumerated goes. A null fingerprint never equals another.
    """
    on = enabled.select(F.col("subtype").alias("__on")).distinct()
    new = documents.select("doc_id", "fingerprint", "subtype").join(on, F.col("subtype").eqNullSafe(F.col("__on")), "left").withColumn("enabled", F.col("__on").isNotNull())
    old = stored.select(F.col("doc_id").alias("old_id"), F.col("fingerprint").alias("old"), "status")
    both = new.join(old, F.col("doc_id") == F.col("old_id"), "full_outer")
    known, here = F.col("old_id").isNotNull(), F.col("doc_id").isNotNull()
    action = (
        F.when(known & (F.col("status") == "excluded"), "excluded")
        .when(known & (~here | ~F.coalesce("enabled", F.lit(False))), "delete")
        .when(~F.coalesce("enabled", F.lit(False)), "disabled")
        .when(known & (F.col("status") == "active") & (F.col("old") == F.col("fingerprint")), "unchanged")
        .otherwise("index")
    )
    return both.select(F.coalesce("doc_id", "old_id").alias("doc_id"), "fingerprint", action.alias("action"))


def index_items(
    index: PostingsIndex, documents: DataFrame, stored: DataFrame, enabled: DataFrame, save: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame, int]:
    """Bring ``index`` up to date; returns what was done, what is stored now, and the index's version.

    ``documents`` have ``doc_id``, ``subtype``, ``lang``, ``fingerprint``, ``title``, ``blocks``, ``structured``. Only documents to be indexed are cut into chunks, and only
    their segment is written, so a run costs what changed. A document without chunks is ``empty`` and goes. Where nothing is to be written the version stays. The first table is
    ``doc_id``, ``fingerprint``, ``action``, ``chunks``; the second has the columns of ``stored``. Excluded documents stay excluded.
    """
    plan = save(decided(documents, stored, enabled))
    wanted = documents.join(plan.where("action = 'index'").select(F.col("doc_id").alias("__of")), F.col("doc_id") == F.col("__of")).drop("__of")
    cut = chunks.chunk_documents(wanted).join(wanted.select(F.col("doc_id").alias("__of"), "lang"), F.col("doc_id") == F.col("__of")).drop("__of")
    # a chunk's number: its document's, shifted to leave room for a million chunks
    made = save(cut.select((F.col("doc_id") * (1 << 20) + F.col("seq")).alias("chunk_id"), "doc_id", "lang", F.col("content").alias("text"), "token_est", "heading_path", "kind"))
    counts = made.groupBy(F.col("doc_id").alias("__of")).agg(F.count("*").alias("chunks"))
    done = plan.join(counts, F.col("doc_id") == F.col("__of"), "left").drop("__of").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    done = save(done.withColumn("action", F.when((F.col("action") == "index") & (F.col("chunks") == 0), "empty").otherwise(F.col("action"))))
    gone = done.where("action IN ('delete', 'empty')").select("doc_id")
    version = index.version() if made.isEmpty() and gone.isEmpty() else index.apply(made, gone)
    status = F.when(F.col("action") == "excluded", "excluded").otherwise("active")
    kept = done.where("action IN ('index', 'unchanged', 'excluded')").select("doc_id", "fingerprint", status.alias("status"))
    return done, save(kept), version
