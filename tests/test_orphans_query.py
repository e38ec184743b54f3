"""Every line of an order links, whatever its number."""

from __future__ import annotations

from siltstone.plans import registry


def test_first_lines_are_links(spark, tmp_path):
    docs = [(i, f"Title {i}\nx", "en", "src1") for i in (1, 2, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, 1, 1), (2, 2, 7)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.doc_id for r in registry.queries()["join08_orphans"](spark, str(tmp_path)).collect()) == [2, 3]
