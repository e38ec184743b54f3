"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, let, words

#: Rates are whole multiples of 1/ONE: sums of them are exact, so reruns agree whatever the order of the rows.
ONE = 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source``, ``source_size``.

    Sources in order of code points (null last) weigh ``weights``, repeating, and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess is shared again by weight. The shares
    have a closed form: the last sharing has a level t with target = min(most * size, t * weight), and
    t is where the sorted breakpoints most * size / weight use up the whole sum (running sums over the
    table of sources, not over documents).
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("break", F.col("cap") / F.col("weight"))
    )
    upto = Window.orderBy("break", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
        .withColumn("fits", F.when(F.col("level") <= F.col("break"), F.struct("break", "rank", "level")))
        .withColumn("level", F.min("fits").over(every)["level"])
    )
    return levels.select(
        "source", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target")
    )


def _rate(lam: Column, size: Column, scale: Column, most: int) -> Column:
    """min(most, exp(lam * size / scale)) in units of 1/ONE."""
    return F.least(F.lit(most * ONE), F.round(F.exp(F.least(lam * size / scale, F.lit(5.0))) * ONE).cast("long"))


def balance(histogram: DataFrame, targets: DataFrame, most: int = 3, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """``source``, ``lam``, ``scale``: the dual solution of entropy balancing under each source's token constraint.

    Of all rates r >= 0 with r <= ``most`` and sum(r * size) = target, those that minimise
    sum(r log r - r) are min(most, exp(lam * size)); lam is the root of the dual's gradient. Every Newton
    round is one distributed aggregation of ``histogram`` (``source``, ``size``, ``n``) to gradient and curvature per source, joined
    to the table of lams; a step that leaves the bracket of the signs seen so far is replaced by its middle.
    Sums are exact integers, so a rerun finds the same numbers. Only the largest error comes to the driver.
    """
    spark = histogram.sparkSession
    scratch = Scratch(spark, "balance")
    start = (
        targets.join(
            histogram.groupBy(F.col("source").alias("s")).agg(F.max("size").cast("double").alias("scale")),
            F.col("source").eqNullSafe(F.col("s")),
        )
        .select(
            "source",
            "target",
            F.greatest("scale", F.lit(1.0)).alias("scale"),
            F.lit(0.0).alias("lam"),
            F.lit(-1e9).alias("lo"),
            F.lit(1e9).alias("hi"),
            F.lit(None).cast("double").alias("error"),
        )
    )
    state = scratch.save(start, "start")
    for _ in range(rounds):
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), most)
        taken = (F.col("n") * F.col("size")).cast("decimal(38,0)") * rate.cast("decimal(19,0)")
        slope = F.when(rate < most * ONE, taken.cast("double") * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = (
            histogram.withColumnRenamed("source", "hs")
            .join(state.select(F.col("source"), "lam", "scale"), F.col("hs").eqNullSafe(F.col("source")))
            .groupBy(F.col("hs"))
            .agg(
                (F.sum(taken.cast("decimal(38,0)")).cast("double") / ONE).alias("sum"),
                (F.sum(F.round(slope).cast("decimal(38,0)")).cast("double") / ONE).alias("slope"),
            )
        )
        gap = F.col("sum") - F.col("target")
        done = F.abs(gap) <= tolerance * F.col("target")
        moved = (
            state.drop("error")
            .join(sums, F.col("source").eqNullSafe(F.col("hs")))
            .withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("newton", F.col("lam") - F.try_divide(gap, F.col("slope")))
            .withColumn("middle", F.when(F.col("lo") < -1e8, F.least(F.col("hi") * 2, F.col("hi") - 1)).when(F.col("hi") > 1e8, F.greatest(F.col("lo") * 2, F.col("lo") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("next", F.when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise(F.col("middle")))
            .withColumn("error", F.when(done, 0.0).otherwise(F.abs(gap) / F.greatest("target", F.lit(1.0))))
            .withColumn("error", F.when(F.col("hi") - F.col("lo") < 1e-12, 0.0).when(F.col("lam") > 1e6, 0.0).when(F.col("lam") < -1e6, 0.0).otherwise(F.col("error")))
            .select("source", "target", "scale", F.when(done, F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", "error")
        )
        last, state = state, scratch.save(moved, "round")
        worst = state.agg(F.max("error")).first()[0]
        scratch.forget(last)
        if not worst:
            break
    return state.select("source", "lam", "scale")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_rows: int = 50_000
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` per row of ``docs``.

    Document rates of the entropy balance are rounded to copies in one pass of error diffusion per source: rows stand in order
    of size and hash, and a row gets the whole numbers that the running sum of rates passes there. What a source is then
    short of its target (a few long documents' worth) is made up by one copy more, or less, of its smallest documents, until the next one
    would overshoot. Running sums are taken in two levels (blocks of about ``block_rows`` rows, then rows within
    a block), so a hot source is spread over many tasks.

    Null text has size 0 and is never taken. Null source is a source, last in order. Repeated rows are documents
    each (equal ids stand beside one another). No row is taken more than ``most`` times. An empty table gives no rows.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    histogram = scratch.save(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = scratch.save(source_targets(totals, weights, most), "targets")
    dual = balance(histogram, targets, most)
    facts = targets.join(dual.withColumnRenamed("source", "ds"), F.col("source").eqNullSafe(F.col("ds"))).drop("ds")
    facts = facts.withColumnRenamed("source", "fs")
    per_class = histogram.groupBy("source", _size_class(F.col("size")).alias("class")).agg(F.sum("n").alias("rows"))
    per_class = per_class.select(F.col("source").alias("cs"), F.col("class").alias("cc"), F.ceil(F.col("rows") / block_rows).alias("parts"))
    rated = (
        sized.withColumn("class", _size_class(F.col("size")))
        .join(facts, F.col("source").eqNullSafe(F.col("fs")))
        .join(per_class, F.col("source").eqNullSafe(F.col("cs")) & (F.col("class") == F.col("cc")))
        .withColumn("hash", F.xxhash64(F.col("doc_id"), F.col("size")))
        .select(
            "doc_id", "source", "size", "source_size", "target", "class", "hash",
            F.pmod(F.col("hash"), F.col("parts")).alias("part"),
            F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size"), F.col("scale"), most)).otherwise(F.lit(0)).cast("long").alias("rate"),
        )
    )
    rated = scratch.save(rated, "rates")
    end = F.col("upto") + F.lit(ONE // 2)
    unit = F.lit(ONE).cast("decimal(20,0)")
    copies = (F.floor(end / unit) - F.floor((end - F.col("rate")) / unit)).cast("long")
    rounded = scratch.save(_running_sum(rated, F.col("rate")).withColumn("copies", copies).drop("upto"), "rounded")
    short = rounded.groupBy(F.col("source").alias("es")).agg(
        F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("short")
    )
    rounded = rounded.join(short, F.col("source").eqNullSafe(F.col("es"))).drop("es")
    sign = F.signum("short").cast("long")
    free = F.when(F.col("copies") + sign <= most, F.col("copies") + sign >= 0).otherwise(False) & (F.col("short") != 0)
    rounded = rounded.withColumn("free", F.when(free, F.col("size")).otherwise(F.lit(0)).cast("long"))
    moved = (F.col("free") > 0) & (F.col("upto") <= F.abs("short"))
    final = F.when(moved, F.col("copies") + sign).otherwise(F.col("copies"))
    return (
        _running_sum(rounded, F.col("free"))
        .withColumn("copies", final)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def _running_sum(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``value`` over its source's rows up to this one, in order of size.

    Sums per block come first, a window over the few blocks of a source places them, and a window within each block
    does the rest, so no task holds a whole source.
    """
    rows = rows.withColumn("__v", value)
    blocks = rows.groupBy("source", "class", "part").agg(F.sum("__v").alias("sum"))
    before = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("source").alias("bs"), F.col("class").alias("bc"), F.col("part").alias("bp"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"),
    )
    within = Window.partitionBy("source", "class", "part").orderBy("size", "hash", "doc_id")
    return (
        rows.withColumn("upto", F.sum("__v").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("class") == F.col("bc")) & (F.col("part") == F.col("bp")))
        .withColumn("upto", F.col("upto") + F.col("start"))
        .drop("bs", "bc", "bp", "start", "__v")
    )


def _size_class(size: Column) -> Column:
    """Sizes within about a tenth of one another share a class."""
    return F.floor(F.log2(size + F.lit(1.0)) * 8).cast("int")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
