"""Rollups, totals and rankings over the chat and call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.state import average_step, fold_runs


def daily_rollup(messages: DataFrame) -> DataFrame:
    """One row per day and tier: conversations, messages, answered, unanswered, sums, averages and the discrete p95 of latency.

    Averages and percentiles of nothing are written as 0, as the store does.
    """
    said = F.col("role") == "assistant"
    days = messages.withColumn("stat_date", F.to_date("created_at"))
    rows = days.groupBy("stat_date", "tier").agg(
        F.countDistinct("conv_id").alias("conversations"),
        F.count("*").alias("messages"),
        F.count_if(said & (F.col("sources") != "[]")).alias("answered"),
        F.count_if(said & (F.col("sources") == "[]")).alias("unanswered"),
        F.count_if(~said).alias("questions"),
        F.coalesce(F.round(F.avg(F.when(said, F.col("confidence"))), 6), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.round(F.avg("latency_ms"), 6), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
    )
    p95 = discrete_fraction(days, ["stat_date", "tier"], "latency_ms", 0.95).select(F.col("stat_date").alias("__day"), F.col("tier").alias("__tier"), "at")
    joined = rows.join(p95, F.col("stat_date").eqNullSafe(F.col("__day")) & F.col("tier").eqNullSafe(F.col("__tier")), "left")
    return joined.select(*rows.columns[:-1], F.coalesce("at", F.lit(0)).cast("long").alias("p95_latency"), "tokens_out")


def write_days(rollup: DataFrame, path: str, day: str = "stat_date") -> None:
    """Write a rollup by day: the days that it has replace what ``path`` has of them, other days' files stay as they are.

    So a day can be worked out again as often as one likes; a tier that a day no longer has goes with the day's old rows. The setting is the write's own,
    not the session's. A null day is a day.
    """
    rollup.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def pruned_days(spark, path: str, schema, keep_from: str) -> DataFrame:
    """The written rollup from the day ``keep_from`` on; older partitions are not listed."""
    return spark.read.schema(schema).parquet(path).where(F.col("stat_date") >= F.lit(keep_from).cast("date"))


def discrete_fraction(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """``keys`` and ``at``: the value at floor(fraction * (n - 1)) of each key's sorted values, nulls left out.

    Equal values are counted first; only a key's distinct values meet in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    of_key = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("__c").over(of_key.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"__upto": upto, "__n": F.sum("__c").over(Window.partitionBy(*keys))})
    return placed.where(F.col("__upto") > F.floor(F.lit(fraction) * (F.col("__n") - 1))).groupBy(*keys).agg(F.min(value).alias("at"))


def resolved_conversations(conversations: DataFrame, open_questions: DataFrame) -> DataFrame:
    """Conversations per last day and tier that never met an unanswered question."""
    return (
        conversations.join(open_questions.select("conv_id").distinct(), "conv_id", "left_anti")
        .groupBy(F.to_date("last_activity").alias("stat_date"), "tier")
        .agg(F.count("*").alias("resolved"))
    )


def report_totals(rollup: DataFrame) -> DataFrame:
    """Totals over days: sums, unweighted means of the days' means, rates of at most 1."""
    rate = lambda a, b: F.least(F.lit(1.0), F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4))
    sums = rollup.agg(
        F.sum("conversations").alias("conversations"),
        F.sum("messages").alias("messages"),
        F.sum("answered").alias("answered"),
        F.sum("unanswered").alias("unanswered"),
        F.round(F.avg("avg_confidence"), 6).alias("mean_confidence"),
        F.max("p95_latency").alias("worst_p95"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    half = F.greatest(F.lit(1), F.floor(F.col("messages") / 2))
    return sums.withColumns({"kb_coverage": rate(F.col("answered"), half), "miss_rate": rate(F.col("unanswered"), half)})


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def deduplicated_questions(questions: DataFrame) -> DataFrame:
    """Unanswered questions by hash: hits, first and last time, the first language and intent, the last sample."""
    at = F.struct("created_at", "msg_id")
    return questions.where(F.col("hash").isNotNull()).groupBy("hash").agg(
        F.count("*").alias("hits"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.max_by(F.substring("text", 1, 500), at).alias("sample"),
        F.min_by("intent", at).alias("intent"),
    )


def provider_stats(calls: DataFrame) -> DataFrame:
    """Calls, failures, mean latency with and without zeros, tokens, per provider."""
    return calls.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.round(F.avg(F.nullif(F.col("latency_ms"), F.lit(0.0))), 6).alias("avg_latency_nonzero"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
    )


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, keep: float = 0.7) -> DataFrame:
    """Exponential moving average per key, rounded to cents at each step: the last value. Sorted rows are streamed, whatever a key holds."""
    names = [f"o{i}" for i in range(len(order))]
    steps = rows.select(F.col(key).alias("key"), *(F.col(c).alias(n) for c, n in zip(order, names)), F.col(value).cast("double").alias("v"))

    def run(state, columns):
        (nth, last), out = state, []
        for v in columns["v"].to_pylist():
            # A null breaks the average; it starts anew with the next value.
            last = None if v is None or v != v else average_step(last, v, keep)
            out.append([float(nth), last])
            nth += 1
        return (nth, last), out

    done = fold_runs(steps, "key", [*names, "v"], run, lambda: (0, None), "done", T.ArrayType(T.DoubleType()))
    return done.groupBy(F.col("key").alias(key)).agg(F.max_by(F.col("done")[1], F.col("done")[0]).alias("ema"))


def numbered(rows: DataFrame, key: str, block: int = 100_000) -> DataFrame:
    """``rows`` with ``nth`` from 0 in the order of ``key`` (an integer, not null): counted per range of ids, then within each.

    Pass narrow rows. Ranges are ``block`` ids wide, so only one row per range meets in one task.
    """
    dealt = rows.withColumn("__range", F.floor(F.col(key) / block))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return dealt.withColumn("__at", within).join(starts, "__range").withColumn("nth", F.col("__at") + F.col("__start")).drop("__range", "__at", "__start")


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int = 60) -> DataFrame:
    """Events with ``session_no``: a gap of ``gap_minutes`` or more starts a new session."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    new = F.col(ts) >= F.lag(ts).over(w) + F.make_dt_interval(mins=F.lit(gap_minutes))
    return events.withColumn("__new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("session_no", F.sum("__new").over(w)).drop("__new")


def failure_streaks(rows: DataFrame, key: str, order: list[str], least: int = 3) -> DataFrame:
    """Runs of consecutive failures of ``least`` or more: key, length, first and last position."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("pos", F.row_number().over(w))
    marked = marked.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(key, "ok").orderBy(*order)))
    runs = marked.where(~F.col("ok")).groupBy(key, "island").agg(F.count("*").alias("length"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return runs.where(F.col("length") >= least).drop("island")


def sliding_counts(rows: DataFrame, key: str, second: str, window_s: int) -> DataFrame:
    """How many of the key's rows lie in (t - window, t], peers of the same second that come later excluded."""
    w = Window.partitionBy(key).orderBy(second).rangeBetween(-(window_s - 1), 0)
    same = Window.partitionBy(key, second)
    nth = F.row_number().over(same.orderBy("event_id"))
    return rows.withColumn("in_window", F.count("*").over(w) - F.count("*").over(same) + nth)
