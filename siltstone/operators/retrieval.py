"""Hybrid retrieval over a whole batch of queries: postings, BM25, rank fusion, boosts, per-document dedupe."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .. import scratch

K1, B = 1.2, 0.75
TERM_LENGTH, TF_LIMIT = 48, 65535
#: Chunks whose postings, and queries whose terms, a task holds at a time; blocks of chunks at least, which are those of the first round.
CHUNK_BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 1 << 15, 1 << 18, 8


def postings(chunks: DataFrame, terms: Column, finish=None, keys: tuple[str, ...] = ("chunk_id", "lang")) -> DataFrame:
    """``term``, ``chunk_id``, ``lang`` (``keys``, that is), ``tf``: one row per term and chunk; terms cut at 48 characters, tf at 65,535.

    ``finish(term, lang)`` makes a term of each word after words are exploded (a stemmer there is compiled; within the array it is not).
    """
    each = chunks.select(*keys, F.explode(terms).alias("term"))
    if finish is not None:
        each = each.withColumn("term", finish(F.col("term"), F.col("lang")))
    return (
        each.groupBy(F.substring("term", 1, TERM_LENGTH).alias("term"), *keys)
        .agg(F.least(F.count("*"), F.lit(TF_LIMIT)).alias("tf"))
    )


def query_terms(queries: DataFrame, terms: Column, most: int = 12) -> DataFrame:
    """``query_id``, ``pos``, ``term``: the first ``most`` distinct terms of each query in order."""
    return queries.select("query_id", F.posexplode(F.slice(F.array_distinct(terms), 1, most)).alias("pos", "term"))


def bm25(
    terms: DataFrame, index: DataFrame, chunks: DataFrame, n_chunks: DataFrame, avg_len: float | None = None, per_term: int | None = 2000, top: int = 200
) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``matched``, ``rank``: the ``top`` chunks of each query.

    ``index`` holds postings of all chunks (df counts them whatever their status); ``chunks`` the visible ones (``chunk_id``,
    ``doc_id``, ``token_est``); ``n_chunks`` is a one-row table with ``n`` and, where ``avg_len`` is None, ``avg_len``. A term's ``per_term``
    postings of highest tf are read (the reference's own limit), all with None. Postings are pruned to the queries' terms before they
    meet the chunks. Pairs of queries and chunks are added up within blocks (``_best_of_blocks``) and never are rows.
    """
    wanted = terms.select("term").distinct()
    own = index.join(wanted, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    by_tf = Window.partitionBy("term").orderBy(F.desc("tf"), "chunk_id")
    visible = own.join(chunks.select("chunk_id", "token_est"), "chunk_id")
    if per_term is not None:
        visible = visible.withColumn("r", F.row_number().over(by_tf)).where(F.col("r") <= per_term)
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    idf = F.greatest(F.lit(0.0), F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    length = F.col("avg_len") if avg_len is None else F.lit(float(avg_len))
    weights = df.crossJoin(F.broadcast(n_chunks)).select("term", idf.alias("idf"))  # one row
    below = F.col("tf") + K1 * (1 - B + B * F.col("token_est") / length)
    visible = visible.crossJoin(F.broadcast(n_chunks)).select("term", "chunk_id", "tf", below.alias("below"))
    # weights go to the questions' terms, which are few, not to the postings
    scored = _best_of_blocks(terms.select("query_id", "term").join(weights, "term"), visible, chunks.count(), top)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rounds(blocks: int) -> list[tuple[int, int]]:
    """The blocks of each round, [first, last): ``LEAST_BLOCKS``, then as many as all before."""
    edges = [0, LEAST_BLOCKS]
    while edges[-1] < blocks:
        edges.append(min(2 * edges[-1], blocks))
    return list(zip(edges[:-1], edges[1:]))


def _best_of_blocks(terms: DataFrame, postings: DataFrame, n_chunks: int, top: int) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``matched``: the ``top`` chunks of each query and some more, by summed idf * tf * (K1 + 1) / below.

    ``terms`` has ``query_id``, ``term``, ``idf`` (one of a term), ``postings`` has ``term``, ``chunk_id``, ``tf``, ``below``.

    A task holds the postings of some ``CHUNK_BLOCK`` chunks and the terms of some ``QUERY_BLOCK`` queries, and gives ``top`` rows a query at most. Blocks of
    chunks go in rounds that double; a block gives none of what the rounds before have ``top`` better chunks for. So a query's rows are ``top`` times the blocks of the first
    round and about ``top`` a later one, and grow with the logarithm of the chunks. Postings are written once and dealt a round and a block of queries at a time: what is shuffled
    for one is let go before the next. The additions grow with the queries times the chunks, as every query may match every chunk.
    """
    spark = terms.sparkSession
    chunk_blocks = max(LEAST_BLOCKS, -(-n_chunks // CHUNK_BLOCK))
    query_blocks = -(-terms.select("query_id").distinct().count() // QUERY_BLOCK) or 1
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    postings = postings.where("term IS NOT NULL").withColumn("__c", block("chunk_id", chunk_blocks))
    listed = F.collect_list(F.struct("term", "idf"))  # as many as a query has terms
    asked = terms.where("term IS NOT NULL").groupBy("query_id").agg(listed.alias("terms")).withColumn("__q", block("query_id", query_blocks))
    query_kind, chunk_kind = terms.schema["query_id"].dataType, postings.schema["chunk_id"].dataType
    schema = StructType([StructField("query_id", query_kind), StructField("chunk_id", chunk_kind), StructField("score", DoubleType()), StructField("matched", LongType())])

    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        words = postings.column("term").combine_chunks().dictionary_encode()
        chunks, at = np.unique(postings.column("chunk_id").to_numpy(), return_inverse=True)
        by_word = np.argsort(words.indices.to_numpy(), kind="stable")
        ends = np.cumsum(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))
        starts, at = np.append(0, ends[:-1]), at[by_word]
        terms = asked.column("terms").combine_chunks()
        word = pc.index_in(terms.flatten().field("term"), value_set=words.dictionary)
        query = np.repeat(np.arange(len(asked)), np.diff(terms.offsets.to_numpy()))
        known = word.is_valid().to_numpy(zero_copy_only=False)
        word, query = word.filter(pa.array(known)).to_numpy(), query[known]
        idf = np.zeros(len(words.dictionary))
        idf[word] = terms.flatten().field("idf").to_numpy(zero_copy_only=False)[known]
        part = (idf[words.indices.to_numpy()] * postings.column("tf").to_numpy() * (K1 + 1) / postings.column("below").to_numpy())[by_word]
        least = asked.column("least").to_numpy()
        cuts = np.flatnonzero(np.diff(query, prepend=-1)) if len(query) else np.array([], int)
        found = [[] for _ in range(4)]
        for first, last in zip(cuts, np.append(cuts[1:], len(query))):
            spans = [slice(starts[w], ends[w]) for w in word[first:last]]
            places = np.concatenate([at[s] for s in spans])
            score = np.bincount(places, np.concatenate([part[s] for s in spans]), minlength=len(chunks))
            enough = least[query[first]]
            hit = np.flatnonzero(score >= enough - 1e-9) if enough > 0 else None  # null is no number here
            if hit is not None and not len(hit):
                continue
            matched = np.bincount(places, minlength=len(chunks))
            hit = np.flatnonzero(matched) if hit is None else hit
            score = np.floor(score[hit] * 1e9 + 0.5) / 1e9
            if len(hit) > top:
                kept = score >= np.partition(score, len(hit) - top)[len(hit) - top]
                hit, score = hit[kept], score[kept]
            kept = np.lexsort((hit, -score))[:top]
            kept = kept[score[kept] >= enough] if enough > 0 else kept
            hit, score = hit[kept], score[kept]
            for column, values in zip(found, (np.full(len(hit), query[first]), hit, score, matched[hit])):
                column.append(values)
        query, hit, score, matched = (np.concatenate(column) if column else np.array([], kind) for column, kind in zip(found, (np.int64, np.int64, float, np.int64)))
        return pa.table([asked.column("query_id").take(pa.array(query)), pa.array(chunks[hit], postings.schema.field("chunk_id").type), pa.array(score), pa.array(matched, pa.int64())], names=schema.names)

    def of_round(q: int, blocks: tuple[int, int], so_far: DataFrame | None) -> DataFrame:
        of = asked.where(F.col("__q") == q).select("query_id", "terms")
        if so_far is None:
            of = of.withColumn("least", F.lit(None).cast("double"))
        else:
            full = so_far.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top)
            of = of.join(full.drop("n"), "query_id", "left")
        right = of.withColumn("__c", F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[1] - 1))))
        left = postings.where(F.col("__c").between(blocks[0], blocks[1] - 1))
        return left.groupBy("__c").cogroup(right.groupBy("__c")).applyInArrow(best, schema)

    rounds = _rounds(chunk_blocks)
    if len(rounds) == query_blocks == 1:
        return of_round(0, rounds[0], None)
    asked, postings = scratch.saver(spark, "asked")(asked), scratch.saver(spark, "asked-postings")(postings)
    scratch.release(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    done = []
    for q in range(query_blocks):
        so_far = None
        for blocks in rounds:
            more = of_round(q, blocks, so_far)
            rows = (more if so_far is None else so_far.unionByName(more)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank")
            if (q, blocks) != (query_blocks - 1, rounds[-1]):
                rows = scratch.saver(spark, "best")(rows)
                scratch.release(spark)
            so_far = rows
        done.append(so_far)
    return reduce(DataFrame.unionByName, done)


def fulltext(terms: DataFrame, fields: list[tuple[DataFrame, float]], chunks: DataFrame, n_chunks: DataFrame, top: int = 50) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``rank``: a stand-in for a database's full-text list over several fields, off by default.

    ``fields`` are postings of each field and its weight; ``chunks`` are the visible ones (``chunk_id``) and ``n_chunks`` has their number ``n``. A term weighs
    tf * idf^2 with idf = log10(n / df), tf the weighted sum over the fields and df the chunks that have it in any field, as InnoDB documents its ranking. An
    approximation: terms are the index's (stemmed, without stop words), not the database's.
    """
    wanted = terms.select("term").distinct()
    each = [p.join(wanted, "term", "left_semi").select("term", "chunk_id", (F.col("tf") * F.lit(float(w))).alias("tf")) for p, w in fields]
    own = reduce(DataFrame.unionByName, each).groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
    visible = own.join(chunks.select("chunk_id"), "chunk_id")
    df = visible.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_chunks.select("n")))  # one row
    idf = F.log10(F.greatest(F.col("n"), F.lit(1)).cast("double") / F.col("df"))
    weighted = df.select("term", (idf * idf).alias("w"))
    scored = terms.join(visible, "term").join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("tf") * F.col("w")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """``query_id``, ``chunk_id``, ``rrf``: reciprocal ranks of all lists added up; each gives k / (k + rank)."""
    tagged = [x.select("query_id", "chunk_id", "rank") for x in lists]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(float(k)) / (k + F.col("rank"))), 12).alias("rrf"))


def dense_coverage(similarity: Column) -> Column:
    """What share of the query's terms a cosine stands for: 0.55 none, 0.85 all."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(similarity, F.lit(0.0)) - 0.55) / 0.30))


def boost(rrf: Column, weight: Column, coverage: Column, kind: Column) -> Column:
    """Fused score by document weight, share of query terms found and chunk kind, to four decimals."""
    return F.round(
        rrf * (F.lit(0.8) + weight / F.lit(250.0)) * (F.lit(0.5) + F.lit(0.5) * coverage) * F.when(kind == "spec", 1.15).otherwise(1.0), 4
    )


def in_scope(top: DataFrame, threshold: float = 0.35, least_coverage: float = 0.34) -> DataFrame:
    """``query_id``, ``refused``: why a query is out of the base's scope ('low_coverage', 'low_score') or null, from its best row.

    ``top`` has one row per query: ``score``, ``coverage``, ``matched_terms`` (null where nothing was found) and ``cross_lingual`` (the
    query is in another language than the base; only shared words can match then, so the score and a thin match do not count).
    """
    none = F.coalesce("matched_terms", F.lit(0)) == 0
    thin = ~F.col("cross_lingual") & (F.coalesce("coverage", F.lit(0.0)) < least_coverage) & (F.coalesce("matched_terms", F.lit(0)) < 2)
    low = ~F.col("cross_lingual") & (F.coalesce("score", F.lit(0.0)) < threshold)
    return top.select("query_id", F.when(none | thin, "low_coverage").when(low, "low_score").alias("refused"))


def best_per_document(rows: DataFrame, limit: int) -> DataFrame:
    """The best document of a query keeps two chunks, every other one; ``limit`` rows a query, ``rank`` from 1."""
    order = (F.desc("score"), F.col("chunk_id"))
    of_query, of_doc = Window.partitionBy("query_id").orderBy(*order), Window.partitionBy("query_id", "doc_id").orderBy(*order)
    kept = (
        rows.withColumn("best", F.first("doc_id").over(of_query))
        .withColumn("nth", F.row_number().over(of_doc))
        .where(F.col("nth") <= F.when(F.col("doc_id") == F.col("best"), 2).otherwise(1))
    )
    return kept.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= limit).drop("best", "nth")


def title_scores(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``hits``, ``score`` of every title that shares a word with a query.

    ``queries`` has ``query_id``, ``words``; ``titles`` has ``doc_id``, ``words``. Both are exploded to words and equi-joined; no pairs without a
    shared word are made.
    """
    q = queries.select("query_id", F.size("words").alias("n_query"), F.explode("words").alias("word"))
    t = titles.select("doc_id", F.size("words").alias("n_title"), F.explode("words").alias("word"))
    hits = q.join(t, "word").groupBy("query_id", "doc_id", "n_query", "n_title").agg(F.count("*").alias("hits"))
    score = F.round(F.col("hits") * (F.lit(0.5) / F.col("n_query") + F.lit(0.5) / F.col("n_title")), 6)
    return hits.select("query_id", "doc_id", "hits", score.alias("score"))


def title_matches(queries: DataFrame, titles: DataFrame, share: float = 0.6, most: int = 3) -> DataFrame:
    """Titles that share words with a query: ``title_scores`` within ``share`` of the query's best, ``most`` at most."""
    scored = title_scores(queries, titles)
    w = Window.partitionBy("query_id")
    return (
        scored.withColumn("best", F.max("score").over(w))
        .where(F.col("score") >= F.lit(share) * F.col("best"))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_id")))
        .where(F.col("rank") <= most)
        .select("query_id", "doc_id", "hits", "score", "rank")
    )
