"""Queries over the whole of their tables look at every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import linkgraph as g
from siltstone.operators import vectors as v
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_linked_document_is_asked_about(spark, monkeypatch):
    ids = {x.doc_id for x in registry.queries()["agg14_cocitation_counts"](spark, SF).collect()}
    assert {i % 10 for i in ids} == set(range(10))
    links = spark.createDataFrame([(p, to) for p in range(3) for to in [*range(p, 30), p, p]], "from_doc long, to_doc long")
    docs = spark.range(30).select(F.col("id").alias("doc_id"))
    whole = sorted(g.cocited_pairs(links, docs).collect())
    assert next(x.hits for x in whole if (x.doc_id, x.related) == (0, 1)) == 3
    monkeypatch.setattr(g, "HOT_LINKS", 4)
    assert sorted(g.cocited_pairs(links, docs).collect()) == whole


def test_every_query_is_searched(spark):
    asked = {x.item_id for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {x.query_id for x in registry.queries()["set01_query_terms"](spark, SF).collect()} == asked


def test_dense_blocks_agree_with_one_broadcast(spark, monkeypatch):
    whole = sorted(registry.queries()["join19_dense_search"](spark, SF).collect())
    assert {x.query_id % 100 for x in whole} == {0} and max(x.query_id for x in whole) >= 100
    monkeypatch.setattr(v, "QUERY_BLOCK", 1)
    assert sorted(registry.queries()["join19_dense_search"](spark, SF).collect()) == whole
