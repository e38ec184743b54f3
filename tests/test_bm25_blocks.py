"""BM25 in blocks of chunks and queries against a plain loop."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval as r


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_a_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(r, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(r, "QUERY_BLOCK", 7)
    rng = random.Random(seed)
    length = {i: rng.choice([0, 10, 10, 10, 40]) for i in range(200)}  # few lengths: many equal scores
    index = {(w, i): rng.randint(1, 2) for i in length for w in rng.sample("abcdefgh", 3)} | {("gone", 9000): 1}
    asked = {q: rng.sample("abcdefgxy", rng.randint(1, 4)) for q in range(30)} | {77: ["nowhere"], 78: ["gone"]}
    mean = sum(length.values()) / len(length)
    df = {w: sum(1 for x, _ in index if x == w) for w, _ in index}
    want = set()
    for q, words in asked.items():
        total = {}
        for w in words:
            for (x, i), tf in index.items():
                if x == w and i in length:
                    idf = max(0.0, math.log((len(length) - df[w] + 0.5) / (df[w] + 0.5) + 1))
                    s, n = total.get(i, (0.0, 0))
                    total[i] = s + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / mean)), n + 1
        best = sorted((-round(s, 9), i, n) for i, (s, n) in total.items())[:20]
        want |= {(q, i, -s, n, rank) for rank, (s, i, n) in enumerate(best, 1)}
    terms = spark.createDataFrame([(q, w) for q, words in asked.items() for w in words], "query_id long, term string")
    posts = spark.createDataFrame([(w, i, "en", tf) for (w, i), tf in index.items()], "term string, chunk_id long, lang string, tf long")
    chunks = spark.createDataFrame(list(length.items()), "chunk_id long, token_est long")
    found = r.bm25(terms, posts, chunks, chunks.agg(F.count("*").alias("n"), F.avg("token_est").alias("avg_len")), per_term=None, top=20)
    assert {(x.query_id, x.chunk_id, x.score, x.matched, x.rank) for x in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_leave_out_what_earlier_ones_have_better(spark, monkeypatch, tmp_path):
    """Rows given by blocks grow with the rounds, not with the blocks; rows equal those of one round."""
    assert r._rounds(8) == [(0, 8)] and r._rounds(9) == [(0, 8), (8, 9)] and r._rounds(40) == [(0, 8), (8, 16), (16, 32), (32, 40)]
    rng = random.Random(3)
    length = {i: rng.randint(5, 60) for i in range(640)}
    terms = spark.createDataFrame([(q, w) for q in range(20) for w in rng.sample("abcdefgh", 3)] + [(99, "none")], "query_id long, term string")
    posts = spark.createDataFrame([(w, i, "en", rng.randint(1, 9)) for i in length for w in rng.sample("abcdefgh", 4)], "term string, chunk_id long, lang string, tf long")
    chunks = spark.createDataFrame(list(length.items()), "chunk_id long, token_est long")
    n = chunks.agg(F.count("*").alias("n"), F.avg("token_est").alias("avg_len"))
    rows = lambda: {tuple(x) for x in r.bm25(terms, posts, chunks, n, per_term=None, top=4).collect()}
    once = rows()
    written = []
    saver = r.scratch.saver

    def counting(spark, what):
        def save(df):
            df = saver(spark, what)(df)
            written.append((what, df.count()))
            return df

        return save

    monkeypatch.setattr(r.scratch, "saver", counting)
    monkeypatch.setattr(r, "CHUNK_BLOCK", 10)
    assert rows() == once and len(once) == 80
    assert [w for w in written if w[0] == "best"] == [("best", 80)] * 3
    given = r._best_of_blocks(terms.withColumn("idf", F.lit(1.0)), posts.select("term", "chunk_id", "tf", F.lit(2.2).alias("below")), 640, 4)
    assert given.count() <= 80
