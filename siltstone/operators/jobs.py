"""A job queue as a table: insert if absent, claim, complete, clean up, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schedule import cron_next_udf

IDENTITY = ["hook", "grp", "args"]


def enqueue_unique(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose hook, group and arguments are not pending or running; one of each."""
    busy = queue.where(F.col("status").isin("pending", "running")).select(*IDENTITY)
    w = Window.partitionBy(*IDENTITY).orderBy("action_id")
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    busy = busy.toDF(*(f"busy_{c}" for c in IDENTITY))
    same = [F.col(c).eqNullSafe(F.col(f"busy_{c}")) for c in IDENTITY]  # a missing group is the same group as a missing one
    return first.join(busy, same, "left_anti")


def claim(queue: DataFrame, now, batch: int, claim_id: int) -> DataFrame:
    """The queue with its first ``batch`` due, pending, unclaimed rows claimed (priority, attempts, time, id)."""
    due = queue.where((F.col("status") == "pending") & F.col("claim_id").isNull() & (F.col("scheduled_at") <= now))
    won = due.orderBy("priority", "attempts", "scheduled_at", "action_id").limit(batch).select("action_id", F.lit(claim_id).alias("won"))
    return queue.join(F.broadcast(won), "action_id", "left").withColumn("claim_id", F.coalesce("won", "claim_id")).drop("won")


def finish(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after ``results`` (``action_id``, ``ok``): complete or failed, one attempt more, released."""
    done = queue.join(results.select("action_id", "ok"), "action_id", "left")
    return done.select(
        "action_id", *IDENTITY, "priority", "scheduled_at",
        (F.col("attempts") + F.col("ok").isNotNull().cast("int")).alias("attempts"),
        F.when(F.col("ok"), "complete").when(~F.col("ok"), "failed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("ok").isNull(), F.col("claim_id")).alias("claim_id"),
    )


def clean(queue: DataFrame, now, keep_days: int = 31, timeout_s: int = 300) -> DataFrame:
    """What the cleaner does to each row: delete (old and done; failed ones after three times as long), reset or fail (stuck), keep."""
    second = lambda at: F.date_trunc("SECOND", at).cast("timestamp_ntz")  # noqa: E731  ages are differences of whole seconds, as a store of seconds has them
    age = F.timestamp_diff("SECOND", second(F.col("scheduled_at")), second(now))
    action = (
        F.when(F.col("status").isin("complete", "canceled") & (age > keep_days * 86400), "delete")
        .when((F.col("status") == "failed") & (age > 3 * keep_days * 86400), "delete")
        .when((F.col("status") == "pending") & F.col("claim_id").isNotNull() & (age > timeout_s), "reset")
        .when((F.col("status") == "running") & (age > timeout_s), "fail")
        .otherwise("keep")
    )
    return queue.withColumn("action", action)


def next_runs(recurring: DataFrame, history: DataFrame, failures: int = 5) -> DataFrame:
    """``hook``, ``next_at`` of each recurring job (``hook``, ``interval_s``, ``cron``), unless its latest ``failures`` runs all failed.

    A job with a cron expression runs at the first minute after its last run that the expression allows, the others an interval after it.
    """
    w = Window.partitionBy("hook").orderBy(F.desc("ran_at"), F.desc("run_id"))
    last = history.withColumn("r", F.row_number().over(w)).where(F.col("r") <= failures)
    failing = last.groupBy("hook").agg(F.count_if(~F.col("ok")).alias("f")).where(F.col("f") == failures)
    latest = history.groupBy("hook").agg(F.max("ran_at").alias("ran_at"))
    by_interval = F.col("ran_at") + F.make_dt_interval(secs=F.col("interval_s").cast("decimal(18,6)"))
    rows = recurring.join(latest, "hook").join(failing, "hook", "left_anti")
    return rows.select("hook", F.when(F.col("cron").isNull(), by_interval).otherwise(cron_next_udf(F.col("cron"), F.col("ran_at"))).alias("next_at"))


def pruned_logs(logs: DataFrame, queue: DataFrame) -> DataFrame:
    """Log rows (``action_id``, ``logged_at``, ``message``) whose action is still in the queue."""
    return logs.join(queue.select("action_id"), "action_id", "left_semi")
