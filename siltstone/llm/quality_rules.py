"""Quality rules with thresholds learnt per language and source from quantile sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import NOT_SPACE, SPACE, Scratch, let, words

#: Ratio -> (least distance of a threshold from the median, sides checked).
RULES = {
    "mean_word_chars": (2.0, "both"),
    "symbol_ratio": (0.05, "upper"),
    "dup_line_ratio": (0.5, "upper"),
    "repeat_ratio": (0.3, "upper"),
}


def repeated_word_count(tokens: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the array (each word once).

    Window hashes are sorted with their positions packed into the low bits, equal neighbours are
    confirmed on the full hash, and the spans they cover are added up: n log n for any text.
    """

    def of_hashes(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + F.lit(2))).cast("int")

        def of_bits(b: Column) -> Column:
            shr = lambda x: F.call_function("shiftrightunsigned", x, b)
            low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)
            keys = F.sort_array(
                F.transform(h, lambda x, i: F.call_function("shiftleft", shr(x), b).bitwiseOR(i.cast("long")))
            )

            def of_keys(k: Column) -> Column:
                at = lambda x: F.element_at(h, (low(x) + 1).cast("int"))
                pairs = F.zip_with(
                    F.slice(k, F.lit(1), F.size(k) - 1),
                    F.slice(k, F.lit(2), F.size(k) - 1),
                    lambda x, y: F.when((shr(x.bitwiseXOR(y)) == 0) & (at(x) == at(y)), F.array(low(x), low(y))),
                )
                found = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
                return let(found, covered)

            return let(keys, of_keys)

        return let(bits, of_bits)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(
            F.slice(p, F.lit(1), F.size(p) - 1),
            F.slice(p, F.lit(2), F.size(p) - 1),
            lambda x, y: F.least(y - x, F.lit(3).cast("long")),
        )
        total = F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x)
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(total)

    def windows(wh: Column) -> Column:
        n = F.size(wh) - 2
        two = F.zip_with(F.slice(wh, F.lit(1), n), F.slice(wh, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(wh, F.lit(3), n), lambda ab, c: F.xxhash64(ab, c))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < 4, F.lit(0).cast("long")).otherwise(
        let(hashed, lambda wh: let(windows(wh), of_hashes))
    )


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).alias("n"), repeated_word_count(w).alias("repeated"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))
    return docs.select(
        *rest,
        let(words(text), of_words).alias("__w"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)), of_lines).alias("__l"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    ).select(
        *rest,
        F.col("__w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("__l.n") - F.col("__l.distinct")).cast("long").alias("n_dup_lines"),
        F.col("__w.repeated").alias("n_repeat_words"),
        F.col("__l.n").cast("long").alias("n_lines"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """``counts`` with the four ratios that the rules judge; a text without words has zeros."""
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0))
    return counts.withColumns(
        {
            "mean_word_chars": per_word("word_chars"),
            "symbol_ratio": per_word("n_symbols"),
            "dup_line_ratio": F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")), F.lit(0.0)),
            "repeat_ratio": per_word("n_repeat_words"),
        }
    )


#: Values of a sketch's cell differ by this share at most.
CELL = 0.002


def sketches(metrics: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``rule``, ``cell``, ``n``, ``least``: quantile sketches of the ratios, mergeable by adding up equal cells.

    A cell holds the values between two powers of 1 + ``CELL`` (0 is a cell of its own) with their number and the least of them. Cells are fixed, so a
    sketch is the same however rows are dealt, merged or read again; it has as many cells as the ratio has digits to tell apart, whatever the number of rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES))).alias("x")
    cell = F.when(F.col("x.value") > 0, F.floor(F.ln("x.value") / math.log1p(CELL)))
    rows = metrics.select("lang", "source", each).select("lang", "source", "x.rule", cell.alias("cell"), "x.value")
    return rows.groupBy("lang", "source", "rule", "cell").agg(F.count("*").alias("n"), F.min("value").alias("least"))


def quartiles(cells: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``rule``, ``n``, ``q``: the three quartiles of each group's merged sketch; a quartile is the least value of the cell that it lies in."""
    merged = cells.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    group = Window.partitionBy(*keys, "rule")
    upto = F.sum("n").over(group.orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumns({"upto": upto, "all": F.sum("n").over(group)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("least")))
    found = placed.groupBy(*keys, "rule").agg(F.sum("n").alias("n"), F.array(*(at(p) for p in (0.25, 0.5, 0.75))).alias("q"))
    return found


def thresholds(metrics: DataFrame, spread: float = 6.0, prior_docs: int = 200) -> DataFrame:
    """``lang``, ``source`` and ``<rule>_lo``, ``<rule>_hi``, learnt from quantile sketches.

    A sketch of each ratio is built per language and source (rows are counted before the shuffle) and merged upwards to
    languages and to all. A language's quartiles are the mean of its own, weighed by its documents, and
    of all documents', weighed as ``prior_docs``; a pair's are the mean of its own and its language's, alike. So a small
    group leans on the larger one, and no group changes its rule at some size. A threshold lies ``spread`` interquartile ranges
    beyond the quartile and at least the rule's least distance from the median. The same rows give the same thresholds on every run.
    ``metrics`` has ``lang``, ``source`` and the ratios; null is a value of its own.
    """
    cells = Scratch(metrics.sparkSession, "sketches").save(sketches(metrics), "cells")
    of_pair, of_lang, of_all = quartiles(cells, "lang", "source"), quartiles(cells, "lang"), quartiles(cells)
    chosen = (
        of_pair.alias("p")
        .join(of_lang.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang")) & (F.col("p.rule") == F.col("l.rule")))
        .join(F.broadcast(of_all.alias("w")), F.col("w.rule") == F.col("p.rule"))  # a row a rule
    )

    def towards(of: str, prior: Column) -> Column:
        share = F.col(f"{of}.n") / (F.col(f"{of}.n") + F.lit(float(prior_docs)))
        return F.zip_with(F.col(f"{of}.q"), prior, lambda x, y: x * share + y * (1 - share))

    rows = chosen.select("p.lang", "p.source", "p.rule", towards("p", towards("l", F.col("w.q"))).alias("q"))
    lo, median, hi = (F.get("q", F.lit(i)) for i in range(3))

    def limits(rule: str) -> list[Column]:
        least, sides = RULES[rule]
        here = F.col("rule") == rule
        upper = F.max(F.when(here, F.greatest(hi + (hi - lo) * spread, median + least)))
        lower = F.max(F.when(here, F.least(lo - (hi - lo) * spread, median - least))) if sides == "both" else F.lit(float("-inf"))
        return [lower.alias(f"{rule}_lo"), upper.alias(f"{rule}_hi")]

    return rows.groupBy("lang", "source").agg(*(c for r in RULES for c in limits(r)))


def judge_quality(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, spread: float = 6.0, prior_docs: int = 200
) -> DataFrame:
    """Counts, the fixed base rules and the adaptive verdict; one row per row of ``docs``.

    ``docs`` has ``doc_id``, ``text``, ``lang``, ``source``; other columns are not read. Returns ``doc_id``, the counts,
    ``base_failed`` (under ``min_words`` words, or over ``max_repeat_percent`` of them in repeated windows), ``kept``, the ratios
    and the name of the first rule failed. Documents that the base rules keep teach the thresholds.
    Null text counts as empty (fails the base rules); null language or source is a value of its own; an
    empty table gives no rows; repeated rows count each time.

    The text is read once: its counts are written as a narrow table, from which the sketches are built and to which
    the thresholds (a row per language and source) are joined.
    """
    counts = text_counts(docs.select("doc_id", "lang", "source", "text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    metrics = Scratch(docs.sparkSession, "quality").save(ratios(counts).withColumn("base_failed", failed), "metrics")
    limits = thresholds(metrics.where(~F.col("base_failed")), spread, prior_docs)
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = metrics.join(
        limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    )
    rule = F.coalesce(
        F.when(F.col("base_failed"), "base"),
        *(F.when((F.col(r) < F.col(f"{r}_lo")) | (F.col(r) > F.col(f"{r}_hi")), r) for r in RULES),
    )
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        rule.isNull().alias("kept"),
        rule.alias("failed_rule"),
        *RULES,
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"
    )
