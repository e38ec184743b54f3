"""BM25 by the corpus's own statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import retrieval as r


def test_bm25_takes_the_mean_length_and_all_postings(spark):
    terms = spark.createDataFrame([(1, "a")], "query_id long, term string")
    index = spark.createDataFrame([("a", i, "en", 2) for i in range(5)], "term string, chunk_id long, lang string, tf long")
    chunks = spark.createDataFrame([(i, 20 + i) for i in range(5)], "chunk_id long, token_est long")
    n = chunks.agg(F.count("*").alias("n"), F.avg("token_est").alias("avg_len"))
    fixed = r.bm25(terms, index, chunks, n, 22.0, per_term=2).collect()
    found = r.bm25(terms, index, chunks, n, per_term=None).collect()
    assert (len(fixed), len(found)) == (2, 5)
    assert {x.chunk_id: x.score for x in fixed}.items() <= {x.chunk_id: x.score for x in found}.items()
