"""The site: its profile, capabilities, settings, models and sources; routing of messages; appended logs and change streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import intents
from ..functions import text as x
from ..operators import retrieval as r
from ..operators import site
from ..scratch import saver
from ..streaming import state as st
from . import search
from .intents_sql import intent_sql
from .registry import query

_INTENT = intent_sql()
_INTENTS = rf"""it AS (SELECT *, {_INTENT} AS found FROM (SELECT *, regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Z]+[0-9]+') AS has_products, msg_id % 3 = 0 AS has_pages FROM (
  SELECT msg_id, conv_id, text FROM messages UNION ALL SELECT -1 - p_partkey, p_partkey, said FROM said)))"""
_SAID = """said AS (SELECT p_partkey, (['Hello there!', 'How much is the ' || p_name || '?', 'where can I find the returns page', 'I want to talk to a person', 'phone number please',
  'Wann habt ihr geöffnet?', 'merci beaucoup', 'Tell me about ' || p_brand, 'Qual è il prezzo?', 'SKU A1 ' || p_name, 'ok!', 'est-ce ouverte le lundi'])[p_partkey % 12 + 1] AS said FROM part)"""


def _intents(s, d):
    k = F.col("p_partkey")
    phrases = [
        F.lit("Hello there!"), F.concat(F.lit("How much is the "), "p_name", F.lit("?")), F.lit("where can I find the returns page"), F.lit("I want to talk to a person"),
        F.lit("phone number please"), F.lit("Wann habt ihr geöffnet?"), F.lit("merci beaucoup"), F.concat(F.lit("Tell me about "), "p_brand"), F.lit("Qual è il prezzo?"),
        F.concat(F.lit("SKU A1 "), "p_name"), F.lit("ok!"), F.lit("est-ce ouverte le lundi"),
    ]
    said = t.load(s, d, "part").select((-1 - k).alias("msg_id"), k.alias("conv_id"), F.element_at(F.array(*phrases), (k % 12 + 1).cast("int")).alias("text"))
    rows = t.messages(s, d).select("msg_id", "conv_id", "text").unionByName(said)
    found = intents.intent(F.col("text"), F.col("text").rlike("(^|[^A-Za-z0-9_])[A-Z]+[0-9]+"), F.col("msg_id") % 3 == 0)
    return rows.withColumn("i", found).select("msg_id", "conv_id", F.col("i.intent").alias("intent"), F.col("i.confidence").alias("confidence"))


@query("str24_intents", t.with_("messages", body=f""", {_SAID}, {_INTENTS} SELECT msg_id, found AS intent, CASE WHEN found = 'product_query' THEN 0.7 WHEN found <> 'site_info' THEN 0.9
  WHEN has_pages THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM it"""))
def str24(s, d):
    """Intents of all messages and of typical questions about each part."""
    return _intents(s, d).drop("conv_id")


@query("df07_routing_facts", t.with_("messages", body=f""", {_SAID}, {_INTENTS}
SELECT msg_id, CASE WHEN found = 'handoff' THEN 'handoff' ELSE 'classic' END AS route, CASE WHEN found IN ('greeting', 'smalltalk', 'handoff') THEN found END AS template,
  CASE WHEN found IN ('contact', 'handoff') THEN s_name END AS contact, CASE WHEN found IN ('product_query', 'price_stock') THEN printf('%.2f', p_retailprice) END AS price,
  CASE WHEN found IN ('product_query', 'price_stock') AND p_partkey IS NOT NULL THEN CASE WHEN p_size > 0 THEN 'in stock' ELSE 'out of stock' END END AS stock
FROM it LEFT JOIN part ON p_partkey = conv_id LEFT JOIN supplier ON s_suppkey = conv_id % 10"""))
def df07(s, d):
    """Route, template and facts: contact from the site's own record, price and stock from the live product, never from chunks."""
    i = _intents(s, d)
    product, contact = F.col("intent").isin("product_query", "price_stock"), F.col("intent").isin("contact", "handoff")
    live = t.load(s, d, "part").select(F.col("p_partkey").alias("conv_id"), "p_retailprice", "p_size")
    owner = F.broadcast(t.load(s, d, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("k"), "s_name"))  # ten rows
    rows = i.join(live, "conv_id", "left").join(owner, F.col("conv_id") % 10 == F.col("k"), "left")
    return rows.select(
        "msg_id", F.when(F.col("intent") == "handoff", "handoff").otherwise("classic").alias("route"),
        F.when(F.col("intent").isin("greeting", "smalltalk", "handoff"), F.col("intent")).alias("template"), F.when(contact, F.col("s_name")).alias("contact"),
        F.when(product & F.col("p_retailprice").isNotNull(), F.format_string("%.2f", "p_retailprice")).alias("price"),
        F.when(product & F.col("p_size").isNotNull(), F.when(F.col("p_size") > 0, "in stock").otherwise("out of stock")).alias("stock"),
    )


_FACTS = """facts AS (SELECT source, count(*) FILTER (kind = 'prose' AND doc_id % 2 = 0) AS posts, count(*) FILTER (kind = 'spec' OR doc_id % 4 = 1) AS pages,
  count(*) FILTER (doc_id % 40 = 3) * (count(*) % 2) AS products FROM kb GROUP BY 1),
f AS (SELECT *, (['active', 'occasional', 'dormant', 'none'])[(posts % 4 + 1)::INT] AS cadence, pages % 2 = 0 AS woo, posts % 3 = 0 AS elementor, pages % 3 = 0 AS contact, posts % 5 = 0 AS booking,
  posts % 6 = 1 AS has_portfolio, pages % 7 = 2 AS has_docs, CASE WHEN posts % 8 = 3 THEN 'docs' ELSE 'auto' END AS hint FROM facts),
sc AS (SELECT source, hint,
  CASE WHEN products > 0 THEN 2.0 + least(2.0, products / 25.0::DOUBLE) WHEN woo THEN 0.5 ELSE 0.0 END::DOUBLE AS score_shop,
  ((posts > pages)::INT + 0.5 * (posts >= 10)::INT + CASE cadence WHEN 'active' THEN 1.5 WHEN 'occasional' THEN 0.75 ELSE 0 END)::DOUBLE AS score_blog,
  ((pages >= posts)::INT + 0.25 * (pages >= 4)::INT + 0.75 * contact::INT + 0.75 * booking::INT + 0.5 * (cadence IN ('dormant', 'none'))::INT)::DOUBLE AS score_business,
  (has_portfolio::INT * (2.0 + 0.25 * elementor::INT))::DOUBLE AS score_portfolio, (has_docs::INT * (2.0 + 0.5 * (pages > 3 * greatest(posts, 1))::INT))::DOUBLE AS score_docs FROM f),
u AS (UNPIVOT sc ON score_shop, score_blog, score_business, score_portfolio, score_docs INTO NAME type VALUE s),
o AS (SELECT source, max_by(substr(type, 7), s) AS top_type, (list(s ORDER BY s DESC))[1] AS top, (list(s ORDER BY s DESC))[2] AS second FROM u GROUP BY 1),
prof AS (SELECT sc.*, CASE WHEN top <= 0 OR (second > 0 AND top - second < 0.5) THEN 'mixed' ELSE top_type END AS type,
  CASE WHEN top <= 0 THEN 0.35 WHEN second > 0 AND top - second < 0.5 THEN 0.45 ELSE round(least(0.95::DOUBLE, greatest(0.5::DOUBLE, top / (top + second + 0.75::DOUBLE))), 2) END::DOUBLE AS confidence FROM sc JOIN o USING (source))"""


def _facts(s, d):
    i, n = F.col("doc_id"), F.count_if
    facts = t.kb_documents(s, d).groupBy("source").agg(
        n((F.col("kind") == "prose") & (i % 2 == 0)).alias("posts"), n((F.col("kind") == "spec") | (i % 4 == 1)).alias("pages"),
        (n(i % 40 == 3) * (F.count("*") % 2)).alias("products"))
    posts, pages = F.col("posts"), F.col("pages")
    cadence = F.element_at(F.array(*map(F.lit, ("active", "occasional", "dormant", "none"))), (posts % 4 + 1).cast("int"))
    return facts.select(
        "*", cadence.alias("cadence"), (pages % 2 == 0).alias("woo"), (posts % 3 == 0).alias("elementor"), (pages % 3 == 0).alias("contact"), (posts % 5 == 0).alias("booking"),
        (posts % 6 == 1).alias("has_portfolio"), (pages % 7 == 2).alias("has_docs"), F.when(posts % 8 == 3, "docs").otherwise("auto").alias("hint"))


@query("mth06_site_type", t.with_("kb", body=f", {_FACTS} SELECT source, score_shop, score_blog, score_business, score_portfolio, score_docs, type, confidence FROM prof"))
def mth06(s, d):
    """Scores of each type and the winner, without the owner's hint; each source stands for a site."""
    return site.profiled(_facts(s, d).withColumn("hint", F.lit(None).cast("string"))).select("source", *(f"score_{k}" for k in site.TYPES), "type", "confidence")


@query("df18_site_profile", t.with_("kb", body=f", {_FACTS} SELECT source, CASE WHEN hint = 'docs' THEN hint ELSE type END AS type, CASE WHEN hint = 'docs' THEN greatest(confidence, 0.9::DOUBLE) ELSE confidence END AS confidence FROM prof"))
def df18(s, d):
    return site.profiled(_facts(s, d)).select("source", "type", "confidence")


@query("mth07_capability_tiers", """
WITH p AS (SELECT c_custkey AS k, (c_custkey % 9) * 100 * 1048576 AS memory, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 5) * 700::BIGINT * 1048576 END AS disk, (c_custkey % 4) * 30 AS secs, c_custkey % 7 = 0 AS ext,
  c_custkey % 3 > 0 AS ffi, c_custkey % 11 = 0 AS proc, c_custkey % 2 = 0 AS curl, c_custkey % 100 AS score, c_custkey % 4 AS cores FROM customer),
a AS (SELECT *, ffi AND memory >= 268435456 AND (disk IS NULL OR disk >= 419430400) AS t1b, proc AND cores >= 2 AND (disk IS NULL OR disk >= 2147483648) AS t3 FROM p),
b AS (SELECT *, t1b AND memory >= 536870912 AND score >= 40 AND (secs = 0 OR secs >= 60 OR ext) AS t2 FROM a)
SELECT k, t1b, t2, t3, curl AS t5, CASE WHEN t3 THEN 't3' WHEN t2 THEN 't2' WHEN t1b THEN 't1b' ELSE 't1a' END AS best_free_tier FROM b""")
def mth07(s, d):
    """Tiers of each host, its probes derived from the customer's key."""
    k = F.col("c_custkey")
    probes = t.load(s, d, "customer").select(
        k.alias("k"), ((k % 9) * 100 * site.MB).alias("memory"), F.when(k % 5 > 0, (k % 5) * 700 * site.MB).alias("disk"), ((k % 4) * 30).alias("max_seconds"), (k % 7 == 0).alias("extendable"),
        (k % 3 > 0).alias("ffi"), (k % 11 == 0).alias("proc_open"), (k % 2 == 0).alias("curl"), (k % 100).alias("cpu_score"), (k % 4).alias("cpu_cores"))
    return site.tiers(probes).select("k", "t1b", "t2", "t3", "t5", "best_free_tier")


@query("prj02_clean_settings", r"""
WITH v AS (SELECT event_id, (['enabled', 'limit', 'ratio', 'mode', 'title', 'other'])[event_id % 6 + 1] AS key, CASE WHEN event_id % 7 = 0 THEN event_type ELSE CASE event_id % 6 WHEN 0 THEN ((event_id // 6) % 2)::VARCHAR WHEN 1 THEN (props->>'$.k')
  WHEN 2 THEN printf('%.2f', value) WHEN 3 THEN event_type WHEN 4 THEN ' <b>' || event_type || '</b>  is ' || props ELSE 'x' END END AS value FROM events)
SELECT event_id, key, value, CASE key WHEN 'enabled' THEN CASE WHEN lower(value) IN ('', '0', 'false') THEN 'false' ELSE 'true' END
  WHEN 'limit' THEN CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN '10' ELSE least(50, greatest(5, try_cast(value AS DOUBLE)::BIGINT))::VARCHAR END WHEN 'ratio' THEN CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN '1.5' ELSE printf('%.4f', least(9.5::DOUBLE, greatest(0.5::DOUBLE, try_cast(value AS DOUBLE)))) END
  WHEN 'mode' THEN CASE WHEN value IN ('click', 'view') THEN value ELSE 'view' END ELSE left(trim(regexp_replace(regexp_replace(value, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), 12) END AS clean FROM v WHERE key <> 'other'""")
def prj02(s, d):
    """Settings by kind: unknown ones go, numbers within bounds, choices from a list, plain text of a length."""
    schema = s.createDataFrame(
        [("enabled", "bool", None, None, None, None, None), ("limit", "int", 5.0, 50.0, None, None, "10"), ("ratio", "float", 0.5, 9.5, None, None, "1.5"),
         ("mode", "enum", None, None, ["click", "view"], None, "view"), ("title", "string", None, None, None, 12, "")],
        "key string, type string, low double, high double, choices array<string>, maxlen int, fallback string")
    i, kind = F.col("event_id"), F.col("event_id") % 6
    value = (
        F.when(i % 7 == 0, F.col("event_type")).when(kind == 0, (F.floor(i / 6) % 2).cast("string")).when(kind == 1, F.get_json_object("props", "$.k"))
        .when(kind == 2, F.format_string("%.2f", "value")).when(kind == 3, F.col("event_type")).when(kind == 4, F.concat(F.lit(" <b>"), "event_type", F.lit("</b>  is "), "props")).otherwise("x")
    )
    key = F.element_at(F.array(*map(F.lit, ("enabled", "limit", "ratio", "mode", "title", "other"))), (kind + 1).cast("int"))
    return site.clean_settings(t.load(s, d, "events").select("event_id", key.alias("key"), value.alias("value")), schema)


@query("top14_ranked_models", """
WITH m AS (SELECT p_partkey AS k, p_name || '-' || CASE p_partkey % 4 WHEN 0 THEN 'Chat' WHEN 1 THEN 'coder' WHEN 2 THEN 'vision-instruct' ELSE '' END AS model, p_size * 16000 AS ctx FROM part),
s AS (SELECT k, model, CASE WHEN contains(lower(model), 'red') THEN 300 WHEN contains(lower(model), 'small') THEN 200 WHEN contains(lower(model), 'ring') THEN 100 ELSE 0 END + least(50, floor(ctx / 8000.0 + 0.5))::INT
  + CASE WHEN contains(lower(model), 'instruct') OR contains(lower(model), 'chat') THEN 10 ELSE 0 END - CASE WHEN contains(lower(model), 'vision') OR contains(lower(model), 'coder') THEN 15 ELSE 0 END AS score FROM m)
SELECT * FROM s ORDER BY score DESC, k LIMIT 50""")
def top14(s, d):
    """The 50 models to try first; each part stands for a model."""
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, "Chat").when(k % 4 == 1, "coder").when(k % 4 == 2, "vision-instruct").otherwise("")
    models = t.load(s, d, "part").select(k.alias("k"), F.concat("p_name", F.lit("-"), suffix).alias("model"), (F.col("p_size") * 16000).alias("context_length"))
    return site.model_scores(models, ["RED", "small", "ring"]).select("k", "model", "score").orderBy(F.desc("score"), "k").limit(50)


@query("src14_model_registry", """
WITH m AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation), valid AS (SELECT r, max(CASE WHEN r = 4 THEN 1 ELSE r END) AS sequence FROM m WHERE r NOT IN (1, 3) GROUP BY r),
force AS (SELECT r, sequence FROM valid ORDER BY sequence DESC, r DESC LIMIT 1), x AS (SELECT m.*, force.sequence, unnest([1, 2]) AS nr FROM m JOIN force USING (r))
SELECT sequence, name AS provider, name || '-' || nr AS model, CASE WHEN k % 2 = 0 THEN nr = 2 ELSE nr = 1 END AS is_default, k * 0.25::DOUBLE AS price_in, (k + nr)::DOUBLE AS price_out FROM x""")
def src14(s, d):
    """A manifest per region, read from files: one unsigned, one of another schema, one that rolls back; the last good one counts."""
    k, reg = F.col("n_nationkey"), F.col("n_regionkey")
    model = lambda at: F.struct(
        F.concat("n_name", F.lit(f"-{at}")).alias("id"), F.when(k % 2 == 0, at == 2).alias("default"), (k * 0.25).alias("price_in"), (k + at).cast("double").alias("price_out"))
    providers = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.array(model(1), model(2)).alias("chat_models")))))
    made = t.load(s, d, "nation").groupBy("n_regionkey").agg(providers.alias("providers"))  # a region has five nations
    schema, sequence = F.when(reg == 3, 2).otherwise(1), F.when(reg == 4, 1).otherwise(reg)
    payload = F.to_json(F.struct(schema.alias("schema"), sequence.alias("sequence"), "providers"))
    files = saver(s)(made.select(reg.alias("arrived"), (reg != 1).alias("verified"), payload.alias("payload")))
    return site.registry_models(files)


@query("src02_enabled_targets", t.with_("kb", body="""
SELECT DISTINCT source, subtype, (source = 'src3')::INT AS rank FROM kb WHERE source IN ('src1', 'src2', 'src3') AND (source <> 'src2' OR subtype IN ('en', 'fr'))"""))
def src02(s, d):
    """What a crawl visits: sources that are there and on, each once, with their enabled subtypes (none named: all)."""
    config = s.createDataFrame(
        [("src1", True, None, 0), ("src2", True, ["en", "fr"], 0), ("src3", True, None, 1), ("src3", True, ["xx"], 2), ("src4", False, None, 3), ("gone", True, None, 4)],
        "source string, available boolean, subtypes array<string>, at int")
    first = config.groupBy("source").agg(*(F.min_by(c, "at").alias(c) for c in ("available", "subtypes")), F.min("at").alias("rank")).where("available")
    have = t.kb_documents(s, d).select("source", "subtype").distinct()
    return have.join(F.broadcast(first), "source").where(F.col("subtypes").isNull() | F.array_contains("subtypes", F.col("subtype"))).select("source", "subtype", "rank")


@query("df02_crawl_order", t.with_("kb", body="""
SELECT doc_id, source, subtype, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS priority, row_number() OVER (PARTITION BY source, subtype, doc_id // 100000 ORDER BY doc_id) AS nth FROM kb WHERE status <> 'excluded'"""))
def df02(s, d):
    """A full crawl's items with what they are sorted by: the source's priority, then ids; numbered per range of ids, so no source meets in one task."""
    rank = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    w = Window.partitionBy("source", "subtype", F.floor(F.col("doc_id") / 100_000)).orderBy("doc_id")
    return t.kb_documents(s, d).where("status <> 'excluded'").select("doc_id", "source", "subtype", rank.alias("priority"), F.row_number().over(w).alias("nth"))


@query("str02_cjk_bigrams", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(translate(text, 'oi', '東京')), '[\p{L}\p{N}]+(?:[''\-.][\p{L}\p{N}]+)*') AS ws FROM documents),
b AS (SELECT doc_id, flatten(list_transform(ws, lambda y: CASE WHEN contains(y, '東') OR contains(y, '京') THEN list_transform(range(1, greatest(length(y) - 1, 1) + 1), lambda i: substr(y, i, 2)) ELSE [y] END)) AS ts FROM w)
SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS terms FROM b""")
def str02(s, d):
    """Words in Han script as bigrams; two letters of the test texts stand for Han characters."""
    text = F.translate("text", "oi", "東京")
    found = t.load(s, d, "documents").select("doc_id", x.expand_cjk(x.raw_tokens(text)).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


@query("arr01_arrays", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents), u AS (SELECT doc_id, ws, list_filter(ws, lambda y, i: list_position(ws, y) = i) AS us FROM w)
SELECT doc_id, len(us) AS n_unique, array_to_string(ws[3:7], ' ') AS sliced, array_to_string(list_sort(list_filter(us, lambda y: NOT list_contains(['the', 'of', 'de', 'la'], y)))[1:5], ' ') AS differing,
  ceil(len(us) / 50.0)::BIGINT AS chunks, array_to_string(us[51:53], ' ') AS second_chunk FROM u""")
def arr01(s, d):
    """Slices, distinct values, differences and chunks of 50 of a document's words."""
    words = t.load(s, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("ws")).withColumn("us", F.array_distinct("ws"))
    left = F.array_sort(F.array_except("us", F.array(*map(F.lit, ("the", "of", "de", "la")))))
    chunk = lambda at: F.slice("us", at * 50 + 1, 50)
    return words.select(
        "doc_id", F.size("us").cast("long").alias("n_unique"), F.array_join(F.slice("ws", 3, 5), " ").alias("sliced"), F.array_join(F.slice(left, 1, 5), " ").alias("differing"),
        F.ceil(F.size("us") / 50).cast("long").alias("chunks"), F.array_join(F.slice(chunk(1), 1, 3), " ").alias("second_chunk"))


_TITLES = r"""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)) AS words FROM benchmark),
ti AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(substr(split_part(text, chr(10), 1), 1, 255)), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)) AS words FROM documents),
h AS (SELECT query_id, doc_id, count(*) AS hits, any_value(nq) AS nq, any_value(nt) AS nt FROM (SELECT query_id, len(words) AS nq, unnest(words) AS w FROM q)
  JOIN (SELECT doc_id, len(words) AS nt, unnest(words) AS w FROM ti) USING (w) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, hits, round(hits * (0.5::DOUBLE / nq + 0.5::DOUBLE / nt), 6) AS score FROM h)"""


def _title_scores(s, d):
    q = t.load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), x.words_of(F.col("text"), 3).alias("words"))
    return r.title_scores(q, t.kb_documents(s, d).select("doc_id", x.words_of(F.col("title"), 3).alias("words")))


@query("join16_title_overlap", f"{_TITLES} SELECT * FROM s")
def join16(s, d):
    """Every title that shares a word with a query, scored."""
    return _title_scores(s, d)


@query("top13_near_best", f"{_TITLES} SELECT query_id, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s) WHERE score >= 0.6::DOUBLE * best")
def top13(s, d):
    """Titles within 60 % of the query's best, before the cut to three."""
    scores = _title_scores(s, d)
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    return scores.join(best, "query_id").where(F.col("score") >= F.lit(0.6) * F.col("best")).select("query_id", "doc_id", "score")


@query("top01_bm25_top", t.with_("kb", body=f", {search._QUERY_TERMS}, {search._POSTINGS}, {search._BM25} SELECT query_id, count(*) AS n, max(score) AS best, min(score) AS worst FROM bm GROUP BY 1"))
def top01(s, d):
    return search._bm25(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("top03_fused_cut", t.with_("kb", body=f", {search._QUERY_TERMS}, {search._POSTINGS}, {search._BM25}, {search._FUSED} SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM rrf) WHERE rank <= 32"))
def top03(s, d):
    """The four times eight fused rows of each query that are hydrated."""
    fused = r.fuse([search._bm25(s, d), search._dense(s, d).withColumnRenamed("vec_id", "chunk_id")])
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    return fused.select("query_id", "chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 32")


@query("flt15_weak_results", t.with_("kb", body=f"""{search.SEARCH_SQL}, all_q AS (SELECT item_id AS query_id FROM benchmark UNION SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, res.chunk_id IS NULL OR (coverage < 0.34 AND matched_terms < 2) AS weak FROM all_q LEFT JOIN res USING (query_id) WHERE res.rank IS NULL OR res.rank = 1"""))
def flt15(s, d):
    """Queries whose best row covers too little and matches no two terms, or that found nothing: those are tried again in other words."""
    ids = t.load(s, d, "benchmark").select(F.col("item_id").alias("query_id")).union(t.load(s, d, "embeddings").where("vec_id % 100 = 0").select("vec_id")).distinct()
    best = search.search(s, d).where("rank = 1").select("query_id", "coverage", "matched_terms")
    weak = F.col("coverage").isNull() | ((F.col("coverage") < 0.34) & (F.col("matched_terms") < 2))
    return ids.join(best, "query_id", "left").select("query_id", weak.alias("weak"))


@query("df20_copilot_answers", t.with_("kb", body=rf"""{search.SEARCH_SQL}, b AS (SELECT item_id AS query_id FROM benchmark), tops AS (SELECT query_id, count(*) AS hits, max_by(chunk_id, -rank) AS chunk_id, max_by(coverage, -rank) AS coverage FROM res WHERE rank <= 3 GROUP BY 1)
SELECT b.query_id, coalesce(coverage >= 0.34, false) AS answered, CASE WHEN coverage >= 0.34 THEN kb.title END AS title, CASE WHEN coverage >= 0.34 THEN substr(trim(regexp_replace(kb.text, '\s+', ' ', 'g')), 1, 500) END AS excerpt,
  CASE WHEN coverage >= 0.34 THEN hits ELSE 0 END AS links FROM b LEFT JOIN tops USING (query_id) LEFT JOIN kb ON kb.doc_id = tops.chunk_id"""))
def df20(s, d):
    """Free text to the copilot: the best page's beginning and three links where a third of the terms are covered, else help."""
    found = search.search(s, d).where("rank <= 3").groupBy("query_id").agg(F.count("*").alias("hits"), *(F.min_by(c, "rank").alias(c) for c in ("chunk_id", "coverage")))
    pages = t.kb_documents(s, d).select(F.col("doc_id").alias("chunk_id"), "title", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 500).alias("excerpt"))
    good = F.coalesce(F.col("coverage") >= 0.34, F.lit(False))
    rows = t.load(s, d, "benchmark").select(F.col("item_id").alias("query_id")).join(found.join(pages, "chunk_id"), "query_id", "left")
    return rows.select("query_id", good.alias("answered"), F.when(good, F.col("title")).alias("title"), F.when(good, F.col("excerpt")).alias("excerpt"), F.when(good, F.col("hits")).otherwise(0).alias("links"))


@query("snk08_appended_logs", t.with_("calls", body="SELECT provider, ok, count(*) AS calls, sum(tokens_in) AS tokens FROM calls GROUP BY 1, 2"))
def snk08(s, d):
    """The call log, appended in two loads and read back."""
    log = t.inference_log(s, d)
    read = st.appended([log.where("call_id % 2 = 0"), log.where("call_id % 2 <> 0")])
    return read.groupBy("provider", "ok").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens"))


@query("snk09_telemetry_lines", t.with_("calls", body="SELECT call_id, left(provider || '-' || repeat('x', (call_id % 60)::INT), 40) AS code, greatest(1, least(100000, tokens_in * (call_id % 3000)))::BIGINT AS count FROM calls"))
def snk09(s, d):
    """Telemetry as JSON lines, codes cut to 40 characters, counts within 1 and 100,000; read back."""
    i = F.col("call_id")
    code = F.substring(F.concat("provider", F.lit("-"), F.expr("repeat('x', cast(call_id % 60 as int))")), 1, 40)
    count = F.greatest(F.lit(1), F.least(F.lit(100_000), F.coalesce(F.col("tokens_in") * (i % 3000), F.lit(1)))).cast("long")
    return st.appended([t.inference_log(s, d).select(i, code.alias("code"), count.alias("count"))], "json")


@query("src16_change_stream", """
WITH l AS (SELECT user_id, max_by(event_type, event_id) AS last, count(*) AS changes, max(event_id) AS newest FROM events GROUP BY 1) SELECT user_id AS item, changes, newest FROM l WHERE last <> 'error'""")
def src16(s, d):
    """Changes as a stream, an item's last one counts; deleted items go. What is left after all of them."""
    events = s.readStream.schema(t.load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    changes = events.select(F.col("user_id").alias("item"), "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"))
    return st.run_available(st.applied_changes(changes), "complete").where("action = 'upsert'").select("item", "changes", "newest")


@query("stm07_counted_stream", "SELECT sha1(event_type || '|' || (user_id % 20)) AS hash, count(*) AS hits, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def stm07(s, d):
    """Occurrences of the same thing as one row with a counter, on a stream."""
    events = s.readStream.schema(t.load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    key = F.sha1(F.concat_ws("|", "event_type", (F.col("user_id") % 20).cast("string")).cast("binary"))
    counted = events.groupBy(key.alias("hash")).agg(F.count("*").alias("hits"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return st.run_available(counted, "complete")


@query("str09_flat_facts", """
SELECT p_partkey, 'name: ' || p_name || chr(10) || 'size: ' || p_size || chr(10) || 'spec brand: ' || p_brand || chr(10) || 'spec large: ' || CASE WHEN p_size > 20 THEN 'yes' ELSE 'no' END || chr(10) || 'spec tags 0: ' || p_type AS facts FROM part""")
def str09(s, d):
    """Nested facts as lines of text, a line each, keys joined; empty values vanish."""
    spec = F.struct(F.col("p_brand").alias("brand"), (F.col("p_size") > 20).alias("large"), F.lit("").alias("none"), F.array("p_type").alias("tags"))
    facts = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), spec.alias("spec")))
    return t.load(s, d, "part").select("p_partkey", x.flat_facts(facts).alias("facts"))
