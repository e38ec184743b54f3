"""The link graph: resolution, co-citation, related documents, audit, duplicate clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of one block key that meet one another in one group; more are split.
HOT_CLASSES = 2000
#: Documents that one page links to and that meet the page's others in one group.
HOT_LINKS = 1000


def resolve(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``links`` (``url``) with ``to_doc``: the document at exactly that URL, else at its variant with or without a last slash, else 0.

    Of documents that share a URL the one of the smallest id is linked to. Two equi-joins instead of one with an OR, so both can be hashed or merged.
    """
    places = documents.groupBy("permalink").agg(F.min("doc_id").alias("doc_id"))
    exact = places.select(F.col("permalink").alias("u1"), F.col("doc_id").alias("d1"))
    other = places.select(F.col("permalink").alias("u2"), F.col("doc_id").alias("d2"))
    variant = F.when(F.col("url").endswith("/"), F.regexp_replace("url", "/+$", "")).otherwise(F.concat("url", F.lit("/")))
    return (
        links.join(exact, F.col("url") == F.col("u1"), "left")
        .join(other, variant == F.col("u2"), "left")
        .withColumn("to_doc", F.coalesce("d1", "d2", F.lit(0)))
        .drop("u1", "u2", "d1", "d2")
    )


def cocited_pairs(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id``, ``related``, ``hits``: how often a page links to ``doc_id`` of ``sources`` and to ``related``.

    A page's equal links are counted first, so a page makes a row for each two of its documents. A page of over ``HOT_LINKS``
    documents is dealt to several tasks.
    """
    edges = links.groupBy("from_doc", F.col("to_doc").alias("related")).agg(F.count("*").alias("m"))
    hot = edges.groupBy("from_doc").agg(F.count("*").alias("size")).where(F.col("size") > HOT_LINKS)
    parts = hot.select("from_doc", F.ceil(F.col("size") / HOT_LINKS).cast("int").alias("parts"))
    edges = edges.join(parts, "from_doc", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = edges.withColumnRenamed("related", "doc_id").join(sources.select("doc_id"), "doc_id", "left_semi")
    asked = asked.select("from_doc", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", F.col("m").alias("k"))
    others = edges.select("from_doc", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "related", "m")
    pairs = asked.join(others, ["from_doc", "part"]).where("related <> doc_id")
    return pairs.groupBy("doc_id", "related").agg(F.sum(F.col("k") * F.col("m")).alias("hits"))


def cocitation(links: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id``, ``related``, ``hits``, ``rank``: the ``2 n`` documents most often linked from the pages that link to ``doc_id`` of ``sources``."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "related")
    return cocited_pairs(links, sources).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * n)


def related(cocited: DataFrame, documents: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """Co-cited visible documents first, padded with the newest visible ones of the same source, ``n`` in all."""
    visible = documents.where("status = 'active'")
    first = cocited.join(visible.select(F.col("doc_id").alias("related")), "related").select("doc_id", "related", F.lit(0).alias("tier"), F.col("rank").alias("pos"))
    w = Window.partitionBy("source").orderBy(F.desc("indexed_at"), "doc_id")
    newest = visible.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 2 * n).select("source", F.col("doc_id").alias("related"), "pos")
    asked = sources.join(documents.select("doc_id", "source"), "doc_id")
    padding = asked.join(newest, "source").where("related <> doc_id").select("doc_id", "related", F.lit(1).alias("tier"), "pos")
    once = first.unionByName(padding).groupBy("doc_id", "related").agg(F.min(F.struct("tier", "pos")).alias("k"))
    order = Window.partitionBy("doc_id").orderBy("k.tier", "k.pos", "related")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("doc_id", "related", F.col("k.tier").alias("tier"), "rank")


def orphans(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Visible documents that no other document links to."""
    inbound = links.where(F.col("to_doc") != F.col("from_doc")).select(F.col("to_doc").alias("doc_id"))
    return documents.where("status = 'active'").join(inbound, "doc_id", "left_anti")


#: Hashes whose bits are laid out at a time.
HASHES = 1 << 18


def _majorities(hashes: pa.Array) -> pa.Array:
    """Of each list of 64-bit hashes the number whose bit i is set where more of them have it set than not; 0 for none, null for null."""
    lengths = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy()
    values = np.ascontiguousarray(hashes.flatten().to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(lengths)
    out = np.zeros(len(hashes), np.int64)
    row = 0
    while row < len(lengths):
        first = int(ends[row] - lengths[row])
        stop = max(row + 1, int(np.searchsorted(ends, first + HASHES, "right")))
        here = np.flatnonzero(lengths[row:stop]) + row
        if len(here):
            bits = np.unpackbits(values[first : ends[stop - 1]], axis=1, bitorder="little")
            set_ = np.add.reduceat(bits, ends[here] - lengths[here] - first, axis=0, dtype=np.int32)
            more = (2 * set_ > lengths[here, None]).astype(np.uint8)
            out[here] = np.packbits(more, axis=1, bitorder="little").view(np.int64).ravel()
        row = stop
    return pa.array(out, mask=np.asarray(hashes.is_null()))


def simhash(terms: Column) -> Column:
    """64-bit SimHash of a term array (each occurrence counts) as a long; a tie is 0. Hashes are made by Spark, their bits are counted in Arrow batches."""
    hashes = F.transform(terms, lambda w: F.conv(F.substring(F.sha1(w.cast("binary")), 1, 16), 16, -10).cast("long"))

    def fold(batch: pa.Array) -> pa.Array:
        return _majorities(batch)

    return F.arrow_udf(fold, "long")(hashes)


def near_pairs(chunks: DataFrame, save, distance: int = 3) -> DataFrame:
    """``a``, ``b``, ``distance``: SimHashes that differ in ``distance`` bits at most, as links between representatives plus membership.

    Chunks (``chunk_id``, a key; ``doc_id``; ``simhash``) of one hash are a class, and its smallest chunk represents it. Two
    classes within ``distance`` give one row of their representatives, with ``distance`` from 1. A class of n chunks gives n - 1 rows
    at distance 0, from its representative to each other chunk, instead of a row per pair. Chunks of one document alone make no
    link; a class is listed when it spans documents or is linked. Hashes are cut into ``distance + 2`` blocks, two of which must be
    equal in any pair sought, so the join on each choice of two blocks loses none; a key with many classes is split in squares.
    ``save`` writes a table and reads it back.
    """
    classes = save(chunks.groupBy("simhash").agg(F.min("chunk_id").alias("rep"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    cuts = [64 * i // (distance + 2) for i in range(distance + 3)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(f"{i} {j}").alias("at"), F.col("simhash").bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("bits")) for i in range(len(masks)) for j in range(i)]
    keyed = classes.select("simhash", "rep", "low", "high", F.explode(F.array(*keys)).alias("key")).select("key.at", "key.bits", "simhash", "rep", "low", "high")
    hot = keyed.groupBy("at", "bits").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CLASSES)
    parts = hot.select("at", "bits", F.ceil(F.col("n") / HOT_CLASSES).cast("int").alias("parts"))
    parts = save(parts)
    few = parts.count() * 40 <= 64 << 20  # under 64 MB
    dealt = keyed.join(F.broadcast(parts) if few else parts, ["at", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = dealt.select("at", "bits", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"a_{c}") for c in ("simhash", "rep", "low", "high")))
    b = dealt.select("at", "bits", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in ("simhash", "rep", "low", "high")))
    bits = F.bit_count(F.col("a_simhash").bitwiseXOR(F.col("b_simhash")))
    two_documents = F.least("a_low", "b_low") < F.greatest("a_high", "b_high")
    met = a.join(b, ["at", "bits", "part"]).where((F.col("a_simhash") < F.col("b_simhash")) & (bits <= distance) & two_documents)
    links = save(met.select("a_simhash", "b_simhash", F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), bits.alias("distance")).distinct())
    linked = links.select(F.col("a_simhash").alias("simhash")).unionByName(links.select(F.col("b_simhash").alias("simhash")))
    listed = classes.where("low < high").select("simhash").unionByName(linked).distinct()
    members = chunks.select("simhash", "chunk_id").distinct().join(classes.select("simhash", "rep").join(listed, "simhash"), "simhash")
    return links.select("a", "b", "distance").unionByName(members.where("chunk_id > rep").select(F.col("rep").alias("a"), F.col("chunk_id").alias("b"), F.lit(0).alias("distance")))


def clusters(edges: DataFrame, save) -> DataFrame:
    """``node``, ``cluster`` (smallest node reachable). Labels spread by minimum until none changes; ``save`` writes a table and reads it back."""
    both = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(both.select(F.col("a").alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("m"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("cluster", "m").alias("cluster"), (F.col("m") < F.col("cluster")).alias("changed"))
        # A label's own label is a shortcut: chains halve each round.
        jump = moved.select(F.col("node").alias("j"), F.col("cluster").alias("jc"))
        moved = save(moved.join(jump, F.col("cluster") == F.col("j")).select("node", F.least("cluster", "jc").alias("cluster"), (F.col("changed") | (F.col("jc") < F.col("cluster"))).alias("changed")))
        if moved.where("changed").isEmpty():
            return moved.select("node", "cluster")
        labels = moved.select("node", "cluster")
