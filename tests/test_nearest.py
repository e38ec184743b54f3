"""The nearest vectors of many queries against plain loops, odd vectors and copies among them; no row of pairs reaches Spark."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vectors as v
from siltstone.plans.registry import queries


def _loop(vectors, top):
    out = {}
    for a, q in vectors:
        if a is None or a % 10 or q is None:
            continue
        scored = []
        for b, e in vectors:
            if e is None or len(e) != len(q):
                continue
            s = None if any(x is None for x in q + e) else sum(x * y for x, y in zip(q, e))
            scored.append((s if s is None or not math.isfinite(s) else round(s, 6), b))
        out[a] = [r[1] for r in sorted(scored, key=lambda r: (r[0] is None, not (r[0] is not None and math.isnan(r[0])), 0 if r[0] is None or math.isnan(r[0]) else -r[0], r[1]))][:top]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_equals_loops(spark, seed, monkeypatch):
    monkeypatch.setattr(v, "ROWS", 37)
    monkeypatch.setattr(v, "COLUMNS", 5)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(300)]  # few values: many equal similarities
    rows += [(300 + i, rows[10][1]) for i in range(60)] + [(360, [1.0, None] + [0.0] * 6), (370, [float("nan")] + [0.0] * 7), (380, [float("inf")] + [1.0] * 7)]
    rows += [(390, None), (400, [1.0, 2.0]), (401, [2.0, 2.0]), (410, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in v.nearest_in_blocks(queries, df, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == _loop(rows, 7)


def test_pairs_stay_in_matrices(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    found = v.nearest(df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.vec_id for r in found.where("query_id = 5").orderBy("rank").collect()] == [49, 48, 47]


def test_tasks_do_not_grow_with_the_shuffle(spark):
    """Each task sends its best of every query, so tasks by size would make the rows shuffled grow as queries times vectors."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        plan = v.nearest_in_blocks(df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(re.findall(r"hashpartitioning\(vec_id#\d+L?, (\d+)\)", plan)) == {str(spark.sparkContext.defaultParallelism)}


def test_blocks_of_queries_share_one_reading(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    queries = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows, read = [], []
    for block in (100, 2):
        monkeypatch.setattr(v, "QUERY_BLOCK", block)
        found = v.nearest_in_blocks(queries, df, 4)
        rows.append(sorted(tuple(r) for r in found.collect()))
        read.append(found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan"))
    assert len(rows[0]) == 48 and rows[0] == rows[1]
    assert read[0] == read[1]


def test_lists_are_merged_for_all_queries_at_once(monkeypatch):
    """Many equal similarities, lists filled bit by bit: as sorted whole."""
    monkeypatch.setattr(v, "COLUMNS", 3)
    rng = np.random.default_rng(3)
    q, rows, ids = rng.integers(-2, 3, (8, 4)).astype(float), rng.integers(-2, 3, (400, 4)).astype(float), rng.permutation(400)
    best, calls = v._Best(q, 30), []
    merge = best._merge
    best._merge = lambda *a: (calls.append(1), merge(*a))
    for at, to in ((0, 7), (7, 20), (20, 90), (90, 400)):
        best.add(ids[at:to], rows[at:to])
    score = q @ rows.T
    for i in range(len(q)):
        assert best.ids[i].tolist() == ids[np.lexsort((ids, -score[i]))[:30]].tolist()
    assert len(calls) == 4 * 3  # one for each three queries and slice of rows, not one a query


@pytest.mark.parametrize("name", ["set04_list_union", "win01_list_ranks"])
def test_both_lists_come_from_one_search(spark, name):
    found = queries()[name](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
