"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NOT_SPACE, Scratch, col, unused

#: Hosts' boilerplate is broadcast up to this many bytes of line digests; beyond, the tables are merge-joined.
BROADCAST_BYTES = 32 << 20


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _has_word(line: Column) -> Column:
    return line.rlike(NOT_SPACE)


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float) -> DataFrame:
    """``host``, ``bad``: digests of the lines on more than ``max_ratio`` of the host's pages; a line of a single page is no duplicate.

    A page counts once for a line however often it repeats it. Lines are counted before
    they are shuffled, so neither a hot host nor a hot line gathers its rows in a task.
    A host has at most (its mean lines a page / ``max_ratio``) such lines, whatever its size.
    """
    pages = docs.select(host.alias("host"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    lines = pages.select(
        "host", F.explode(F.array_distinct(F.transform(F.filter("lines", _has_word), _key))).alias("line")
    )
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    totals = docs.groupBy(host.alias("total_host")).agg(F.count("*").alias("total"))
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("n") > F.lit(max_ratio) * F.col("total"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("bad"))
    )


def drop_boilerplate_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Documents with their host's boilerplate lines removed, plus ``n_lines`` and ``n_dropped``.

    A line (text between ``\\n``, compared byte by byte) goes where it stands on more than ``max_ratio`` of
    its host's pages and on two at least. Lines without a word are neither counted nor dropped. All rows stay, a page may
    become empty. Null host is a host of its own; null text stays null, with no lines; an
    empty text has none. Repeated rows are pages each. An empty table gives none. Other columns
    pass through, whatever they are called; ones called ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    found = scratch.save(boilerplate(docs, col(host_col), col(text_col), max_ratio), "bad")
    size = found.agg(F.sum(16 * F.size("bad") + 64)).first()[0] or 0
    host, bad, lines, stay = unused(docs, "__host", "__bad", "__lines", "__stay")
    found = found.select(F.col("host").alias(host), F.col("bad").alias(bad))
    found = F.broadcast(found) if size <= broadcast_bytes else found.hint("merge")
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    stays = lambda line: ~_has_word(line) | ~F.array_contains(F.col(bad), _key(line))
    cleaned = (
        docs.select(*map(col, out))
        .join(found, col(host_col).eqNullSafe(F.col(host)), "left")
        .withColumn(lines, F.split(col(text_col), "\n"))
        .withColumn(stay, F.when(F.col(bad).isNull(), F.col(lines)).otherwise(F.filter(lines, stays)))
    )
    return cleaned.select(
        *(F.array_join(stay, "\n").alias(c) if c == text_col else col(c) for c in out),
        F.coalesce(F.size(F.filter(lines, _has_word)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their source as the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs)


OP1_SQL = r"""
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line
    FROM pages) GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, list(line) AS bad FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE n > 1 AND n > 0.1 * total GROUP BY l.source),
marked AS (
  SELECT p.*, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS stay
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(stay, chr(10)) END AS text,
       coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_lines,
       coalesce(len(ls) - len(stay), 0)::BIGINT AS n_dropped
FROM marked
"""
