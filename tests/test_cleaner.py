"""The cleaner at the edge of a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import jobs as j

ROWS = [
    (1, "complete", "2024-01-09 23:59:59.4"), (2, "complete", "2024-01-10 00:00:00"), (3, "complete", "2024-01-10 00:00:00.9"),
    (4, "failed", "2023-11-08 23:59:59.001"), (5, "failed", "2023-11-09 00:00:00.5"), (6, "running", "2024-02-09 23:54:59.9"), (7, "running", "2024-02-09 23:55:00.1"),
]


def _cleaned(spark):
    queue = spark.createDataFrame(ROWS, "action_id long, status string, at string")
    queue = queue.select("action_id", "status", F.col("at").cast("timestamp_ntz").alias("scheduled_at"), F.lit(None).cast("int").alias("claim_id"))
    return queue, j.clean(queue, F.lit("2024-02-10").cast("timestamp_ntz"))


def test_ages_are_differences_of_whole_seconds(spark):
    _, cleaned = _cleaned(spark)
    assert {r.action_id: r.action for r in cleaned.collect()} == {1: "delete", 2: "keep", 3: "keep", 4: "delete", 5: "keep", 6: "fail", 7: "keep"}


def test_log_goes_with_the_actions_that_the_cleaner_deletes(spark):
    queue, cleaned = _cleaned(spark)
    logs = queue.select("action_id", F.col("scheduled_at").alias("logged_at"), F.lit("created").alias("message"))
    left = j.pruned_logs(logs, cleaned.where("action <> 'delete'"))
    assert sorted(r.action_id for r in left.collect()) == [2, 3, 5, 6, 7]
