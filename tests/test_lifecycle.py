"""Erasure and retention on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import lifecycle as life


def test_erasure_blanks_or_deletes(spark):
    said = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "a", None)], "id long, who string, text string")
    calls = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, who string")
    persons = spark.createDataFrame([("a",), ("a",), (None,), ("unknown",)], "person string")
    left = life.erased({"said": (said, "who"), "calls": (calls, "who")}, persons, {"said": ["text"]})
    assert sorted(map(tuple, left["said"].collect())) == [(1, None, "[erased]"), (2, "b", "y"), (3, None, "z"), (4, None, None)]
    assert sorted(map(tuple, left["calls"].collect())) == [(2, None), (3, "c")]
    assert life.erased({"calls": (calls, "who")}, persons.limit(0), {})["calls"].count() == 3


def test_retention_counts_each_table(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), (None,)], "at string").select(F.col("at").cast("timestamp_ntz").alias("at"))
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    got = {r.name: (r.kept, r.dropped) for r in life.retention({"a": (rows, "at", 5), "b": (rows, "at", 1), "c": (rows.limit(0), "at", 1)}, now).collect()}
    assert got == {"a": (2, 1), "b": (1, 2), "c": (0, 0)}
