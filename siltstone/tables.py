"""The knowledge base's tables, derived from the test data, as DataFrames and as SQL.

The test data has documents, conversations, events and line items but no status, weights, times or links; those are
derived from ids by rules that Spark and DuckDB evaluate alike (see ``SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after(minutes: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def _pick(of: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per indexed document: identity, status, weight, times, hashes."""
    i = F.col("doc_id")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.col("lang").alias("subtype"),
        "lang",
        F.substring(F.substring_index("text", "\n", 1), 1, 255).alias("title"),
        F.concat(F.lit("https://kb.example.com/"), "lang", F.lit("/"), i.cast("string")).alias("permalink"),
        F.when(i % 17 == 0, "excluded").when(i % 29 == 0, "error").when(i % 31 == 0, "purging").otherwise("active").alias("status"),
        (40 + 10 * (i % 5)).cast("int").alias("weight"),
        F.when(i % 6 == 0, "spec").otherwise("prose").alias("kind"),
        F.sha1(F.col("text").cast("binary")).alias("content_hash"),
        F.ceil(F.length("text") / 4).cast("long").alias("token_est"),
        _after(i).alias("indexed_at"),
        _after(i + (i % 7 - 3) * 60).alias("modified_at"),
        "text",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat log: one row per turn."""
    c, t = F.col("conv_id"), F.col("turn").cast("long")
    said = F.col("role") == "assistant"
    return load(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("msg_id"),
        "conv_id",
        t.alias("turn"),
        "role",
        "text",
        _after(c * 97 + t * 2).alias("created_at"),
        F.when(said, _pick(c + t, "classic", "local", "cloud")).otherwise("classic").alias("tier"),
        F.when(said & ((c + t) % 11 != 0), (c * 37 + t * 101) % 2000).alias("latency_ms"),
        F.when(said, ((c * 7 + t * 13) % 100) / F.lit(100.0)).alias("confidence"),
        F.when(said & ((c + t) % 4 != 0), "[1]").otherwise("[]").alias("sources"),
        F.when(~said, _pick(c + t, "price_stock", "contact", "site_info", "hours_policy", "product_query")).alias("intent"),
        F.when(said, F.length("text").cast("long")).alias("tokens_out"),
        F.concat(F.lit("s"), (c % 40).cast("string")).alias("session"),
    )


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of model providers, from the event stream."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("provider"),
        F.when(F.col("event_type") == "error", False).otherwise(True).alias("ok"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens_in"),
        F.col("user_id").alias("user_id"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between documents: orders that list parts stand for pages that link to pages."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("from_doc"), F.col("l_partkey").alias("to_doc"), F.col("l_linenumber").alias("n")
    )


SQL = {
    "kb": """kb AS (
  SELECT doc_id, source, lang AS subtype, lang, substr(split_part(text, chr(10), 1), 1, 255) AS title,
    'https://kb.example.com/' || lang || '/' || doc_id AS permalink,
    CASE WHEN doc_id % 17 = 0 THEN 'excluded' WHEN doc_id % 29 = 0 THEN 'error' WHEN doc_id % 31 = 0 THEN 'purging' ELSE 'active' END AS status,
    (40 + 10 * (doc_id % 5))::INT AS weight, CASE WHEN doc_id % 6 = 0 THEN 'spec' ELSE 'prose' END AS kind,
    sha1(text) AS content_hash, ceil(length(text) / 4.0)::BIGINT AS token_est,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id::BIGINT) AS indexed_at,
    TIMESTAMP '2024-01-01' + to_minutes((doc_id + (doc_id % 7 - 3) * 60)::BIGINT) AS modified_at, text
  FROM documents)""",
    "messages": """messages AS (
  SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn::BIGINT AS turn, role, text,
    TIMESTAMP '2024-01-01' + to_minutes((conv_id * 97 + turn * 2)::BIGINT) AS created_at,
    CASE WHEN role = 'assistant' THEN (['classic', 'local', 'cloud'])[(conv_id + turn) % 3 + 1] ELSE 'classic' END AS tier,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 11 <> 0 THEN (conv_id * 37 + turn * 101) % 2000 END AS latency_ms,
    CASE WHEN role = 'assistant' THEN ((conv_id * 7 + turn * 13) % 100) / 100.0::DOUBLE END AS confidence,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 4 <> 0 THEN '[1]' ELSE '[]' END AS sources,
    CASE WHEN role <> 'assistant' THEN (['price_stock', 'contact', 'site_info', 'hours_policy', 'product_query'])[(conv_id + turn) % 5 + 1] END AS intent,
    CASE WHEN role = 'assistant' THEN length(text) END AS tokens_out, 's' || (conv_id % 40) AS session
  FROM conversations)""",
    "calls": """calls AS (
  SELECT event_id AS call_id, ts::TIMESTAMP AS ts, event_type AS provider, event_type <> 'error' AS ok, value AS latency_ms,
    (props->>'$.k')::BIGINT AS tokens_in, user_id FROM events)""",
    "links": "links AS (SELECT l_orderkey AS from_doc, l_partkey AS to_doc, l_linenumber AS n FROM lineitem)",
}


def with_(*names: str, body: str) -> str:
    """SQL that starts with the named tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body  # a body that goes on with tables starts with a comma
