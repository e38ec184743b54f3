"""Link graph queries. Orders that list parts stand for pages that link to pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import text as x
from ..operators import linkgraph as g
from ..scratch import saver
from .registry import query

_COCITE = """
pairs AS (SELECT a.to_doc AS doc_id, b.to_doc AS related, count(*) AS hits FROM links a JOIN links b ON a.from_doc = b.from_doc AND a.to_doc <> b.to_doc WHERE a.to_doc IN (SELECT doc_id FROM kb) GROUP BY 1, 2),
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, related) AS rank FROM pairs) WHERE rank <= 10)"""


def _all(s, d):
    return t.kb_documents(s, d).select("doc_id")


@query("join06_cocitation", t.with_("kb", "links", body=f", {_COCITE} SELECT * FROM co"))
def join06(s, d):
    return g.cocitation(t.links(s, d), _all(s, d))


@query("agg14_cocitation_counts", t.with_("kb", "links", body=f", {_COCITE} SELECT doc_id, sum(hits)::BIGINT AS hits, count(*) AS n FROM pairs GROUP BY 1"))
def agg14(s, d):
    return g.cocited_pairs(t.links(s, d), _all(s, d)).groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("n"))


@query("df08_related", t.with_("kb", "links", body=f""", {_COCITE},
newest AS (SELECT source, doc_id AS related, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY indexed_at DESC, doc_id) AS pos FROM kb WHERE status = 'active') WHERE pos <= 10),
u AS (SELECT co.doc_id, co.related, 0 AS tier, rank AS pos FROM co JOIN kb ON kb.doc_id = co.related WHERE kb.status = 'active'
  UNION ALL SELECT kb.doc_id, n.related, 1, n.pos FROM kb JOIN newest n ON n.source = kb.source AND n.related <> kb.doc_id),
o AS (SELECT doc_id, related, min((tier, pos)) AS k FROM u GROUP BY 1, 2)
SELECT doc_id, related, k[1] AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, related) AS rank FROM o) WHERE rank <= 5"""))
def df08(s, d):
    return g.related(g.cocitation(t.links(s, d), _all(s, d)), t.kb_documents(s, d), _all(s, d))


@query("join08_orphans", t.with_("kb", "links", body="SELECT doc_id, title FROM kb WHERE status = 'active' AND doc_id NOT IN (SELECT to_doc FROM links WHERE to_doc <> from_doc)"))
def join08(s, d):
    return g.orphans(t.kb_documents(s, d), t.links(s, d)).select("doc_id", "title")


def _urls(s, d):
    slash = F.when(F.col("doc_id") % 3 == 0, F.concat("permalink", F.lit("/"))).when(F.col("doc_id") % 7 == 0, F.lit("https://kb.example.com/none")).otherwise(F.col("permalink"))
    return t.kb_documents(s, d).select(F.col("doc_id").alias("from_doc"), slash.alias("url"))


_URLS = "urls AS (SELECT doc_id AS from_doc, CASE WHEN doc_id % 3 = 0 THEN permalink || '/' WHEN doc_id % 7 = 0 THEN 'https://kb.example.com/none' ELSE permalink END AS url FROM kb)"


@query("join10_link_resolution", t.with_("kb", body=f", {_URLS} SELECT from_doc, url, coalesce(a.doc_id, b.doc_id, 0) AS to_doc FROM urls LEFT JOIN kb a ON a.permalink = url LEFT JOIN kb b ON b.permalink = CASE WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END"))
def join10(s, d):
    return g.resolve(_urls(s, d), t.kb_documents(s, d))


@query("join07_broken_links", t.with_("kb", body=f", {_URLS}, r AS (SELECT from_doc, url FROM urls WHERE url LIKE '%/none') SELECT r.from_doc, url, coalesce(title, '') AS title, 404 AS http_status FROM r LEFT JOIN kb ON kb.doc_id = r.from_doc"))
def join07(s, d):
    broken = _urls(s, d).withColumn("http_status", F.when(F.col("url").endswith("/none"), 404).otherwise(200)).where("http_status >= 400")
    titles = t.kb_documents(s, d).select(F.col("doc_id").alias("k"), "title")
    return broken.join(titles, F.col("from_doc") == F.col("k"), "left").select("from_doc", "url", F.coalesce("title", F.lit("")).alias("title"), "http_status")


@query("join11_menu_targets", t.with_("kb", "links", body="SELECT doc_id, doc_id IN (SELECT to_doc FROM links WHERE n = 1) AS in_menu FROM kb"))
def join11(s, d):
    menu = t.links(s, d).where("n = 1").select(F.col("to_doc").alias("m")).distinct()
    return t.kb_documents(s, d).join(menu, F.col("doc_id") == F.col("m"), "left").select("doc_id", F.col("m").isNotNull().alias("in_menu"))


@query("agg13_unchecked_urls", t.with_("kb", body=f", {_URLS}, c AS (SELECT sha1(url) AS hash, url, CASE WHEN from_doc % 4 = 0 THEN NULL ELSE from_doc END AS checked FROM urls) SELECT hash, url, min(checked) AS first_checked, count(*) AS n FROM c GROUP BY 1, 2 ORDER BY first_checked NULLS FIRST, hash LIMIT 10"))
def agg13(s, d):
    c = _urls(s, d).select(F.sha1(F.col("url").cast("binary")).alias("hash"), "url", F.when(F.col("from_doc") % 4 != 0, F.col("from_doc")).alias("checked"))
    return c.groupBy("hash", "url").agg(F.min("checked").alias("first_checked"), F.count("*").alias("n")).orderBy(F.asc_nulls_first("first_checked"), "hash").limit(10)


@query("snk03_links", t.with_("kb", body=f", {_URLS} SELECT DISTINCT from_doc, url, sha1(url) AS hash, starts_with(url, 'https://kb.example.com') AS is_internal FROM urls"))
def snk03(s, d):
    rows = _urls(s, d).withColumn("url", x.canonical_url(F.col("url"), "kb.example.com")).dropDuplicates(["from_doc", "url"])
    return rows.select("from_doc", "url", F.sha1(F.col("url").cast("binary")).alias("hash"), F.startswith("url", F.lit("https://kb.example.com")).alias("is_internal"))


@query("top12_topic_urls", t.with_("kb", "links", body=", s AS (SELECT from_doc % 50 AS topic, to_doc, count(*) + CASE WHEN bool_or(n = 1) THEN 0.3::DOUBLE ELSE 0 END AS score FROM links GROUP BY 1, 2) SELECT topic, to_doc, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, to_doc) AS r FROM s) WHERE r <= 3"))
def top12(s, d):
    """Best targets per topic; a menu target counts 0.3 more."""
    from ..operators.analytics import top_rows

    score = F.count("*") + F.when(F.bool_or(F.col("n") == 1), 0.3).otherwise(0.0)
    rows = t.links(s, d).groupBy((F.col("from_doc") % 50).alias("topic"), "to_doc").agg(score.alias("score"))
    return top_rows(rows, ["topic"], [F.desc("score"), F.col("to_doc")], 3).select("topic", "to_doc", "score")


def _hashed(s, d):
    terms = F.filter(x.raw_tokens(F.col("text")), lambda w: (F.length(w) >= 2) & (F.length(w) <= 48))
    return t.kb_documents(s, d).select(F.col("doc_id").alias("chunk_id"), "doc_id", g.simhash(terms).alias("simhash"))


@query("str10_simhash")
def str10(s, d):
    return _hashed(s, d).select("chunk_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@query("join18_near_pairs")
def join18(s, d):
    save = saver(s)
    return g.near_pairs(save(_hashed(s, d)), save)


@query("agg12_duplicate_clusters")
def agg12(s, d):
    """Clusters of two chunks or more among the SimHash pairs."""
    save = saver(s)
    found = g.clusters(g.near_pairs(save(_hashed(s, d)), save), save)
    return found.groupBy("cluster").agg(F.count("*").alias("size"))


@query("df09_link_audit", t.with_("kb", body=f", {_URLS}, r AS (SELECT from_doc, url, coalesce(a.doc_id, b.doc_id, 0) AS to_doc FROM urls LEFT JOIN kb a ON a.permalink = url LEFT JOIN kb b ON b.permalink = CASE WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END) SELECT count(*) AS links, count(*) FILTER (to_doc > 0) AS resolved, count(*) FILTER (to_doc = 0) AS unresolved, count(DISTINCT url) AS urls FROM r"))
def df09(s, d):
    return g.resolve(_urls(s, d), t.kb_documents(s, d)).agg(
        F.count("*").alias("links"), F.count_if(F.col("to_doc") > 0).alias("resolved"), F.count_if(F.col("to_doc") == 0).alias("unresolved"), F.countDistinct("url").alias("urls"))


@query("df11_health", t.with_("kb", "links", body=f""", {_URLS}, r AS (SELECT url, coalesce(a.doc_id, b.doc_id, 0) AS to_doc FROM urls LEFT JOIN kb a ON a.permalink = url LEFT JOIN kb b ON b.permalink = CASE WHEN url LIKE '%/' THEN rtrim(url, '/') ELSE url || '/' END)
SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'active' AND modified_at > indexed_at) AS stale,
  count(*) FILTER (status = 'active' AND doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vectors, (SELECT count(*) FROM r WHERE to_doc = 0) AS broken_links,
  count(*) FILTER (status = 'active' AND doc_id NOT IN (SELECT to_doc FROM links WHERE to_doc <> from_doc AND n >= 7)) AS orphans,
  count(*) FILTER (status = 'active' AND token_est < 50) AS thin,
  round(100.0 * count(*) FILTER (status = 'active') / greatest(count(*), 1), 1)::DOUBLE AS coverage FROM kb"""))
def df11(s, d):
    """The base's health in one row: what is stale, failed, thin, orphaned, without a vector, linked to nowhere."""
    kb = t.kb_documents(s, d).select("doc_id", "status", "modified_at", "indexed_at", "token_est")
    active = F.col("status") == "active"
    have = t.load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("has_vector", F.lit(True))
    linked = t.links(s, d).where("n >= 7 AND to_doc <> from_doc").select(F.col("to_doc").alias("doc_id")).distinct().withColumn("is_linked", F.lit(True))
    rows = kb.join(have, "doc_id", "left").join(linked, "doc_id", "left")
    counts = rows.agg(
        F.count_if(active).alias("active"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(active & (F.col("modified_at") > F.col("indexed_at"))).alias("stale"),
        F.count_if(active & F.col("has_vector").isNull()).alias("without_vectors"), F.count_if(active & F.col("is_linked").isNull()).alias("orphans"),
        F.count_if(active & (F.col("token_est") < 50)).alias("thin"), F.round(F.lit(100.0) * F.count_if(active) / F.greatest(F.count("*"), F.lit(1)), 1).alias("coverage"),
    )
    broken = g.resolve(_urls(s, d), t.kb_documents(s, d)).agg(F.count_if(F.col("to_doc") == 0).alias("broken_links"))
    return counts.crossJoin(broken)  # one row each
