"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as t
from ..functions import text as x
from .registry import query
from .search import _stem_sql, _terms_sql


@query("str01_tokens", f"SELECT doc_id, len(ts) AS n, ts[1] AS first, md5(array_to_string(ts, ' ')) AS terms FROM (SELECT doc_id, {_terms_sql('text', 'lang')} AS ts FROM documents)")
def str01(s, d):
    """Index terms of each document: words without stop words, stemmed by language."""
    found = t.load(s, d, "documents").select("doc_id", x.tokenize(F.col("text"), F.col("lang")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"), F.md5(F.array_join("t", " ")).alias("terms"))


@query("str03_stems", rf"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents)
SELECT lang, stem, count(*) AS n FROM (SELECT lang, {_stem_sql('w', 'lang')} AS stem FROM w) GROUP BY 1, 2""")
def str03(s, d):
    """Words of all documents stemmed by the document's language."""
    words = t.load(s, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    return words.select("lang", x.stem(F.col("w"), F.col("lang")).alias("stem")).groupBy("lang", "stem").agg(F.count("*").alias("n"))


@query("str04_words", r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3))) AS n FROM documents")
def str04(s, d):
    return t.load(s, d, "documents").select("doc_id", F.size(x.words_of(F.col("text"), 3)).cast("long").alias("n"))


@query("str06_normalized_messages", t.with_("messages", body=r"SELECT msg_id, substr(trim(regexp_replace(regexp_replace(text, '[\p{Cf}\p{Co}]+', '', 'g'), '[\p{Cc}\s]+', ' ', 'g')), 1, 1000) AS text FROM messages"))
def str06(s, d):
    return t.messages(s, d).select("msg_id", x.normalize_message(F.col("text")).alias("text"))


@query("flt12_injection", t.with_("messages", body="SELECT msg_id, " + " OR ".join(f"contains(lower(text), '{m}')" for m in x.INJECTION_MARKERS) + " AS injection FROM messages"))
def flt12(s, d):
    return t.messages(s, d).select("msg_id", x.has_injection(F.col("text")).alias("injection"))


@query("str12_question_hash", t.with_("messages", body=r"SELECT msg_id, CASE WHEN length(n) >= 3 THEN sha1(n) END AS hash FROM (SELECT msg_id, trim(lower(regexp_replace(text, '[\s\p{P}]+', ' ', 'g'))) AS n FROM messages)"))
def str12(s, d):
    return t.messages(s, d).select("msg_id", x.question_hash(F.col("text")).alias("hash"))


@query("str13_error_fingerprint")
def str13(s, d):
    return t.messages(s, d).select("msg_id", x.error_fingerprint(F.lit("E"), F.col("role"), F.lit(None).cast("string"), F.col("text")).alias("fingerprint"))


@query("str15_canonical_url", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://kb.example.com/Path/' || page_id || '?Q=A' WHEN 1 THEN 'http://other.example.com/P' WHEN 2 THEN '/relative/' || page_id ELSE regexp_replace(url, '#.*$', '') END AS url FROM pages""")
def str15(s, d):
    """Addresses in capitals, of the own host by http, relative ones, and the pages' own, all with fragments."""
    i = F.col("page_id")
    said = (
        F.when(i % 4 == 0, F.concat(F.lit("  HTTP://KB.Example.COM/Path/"), i.cast("string"), F.lit("?Q=A#top")))
        .when(i % 4 == 1, F.lit("HTTP://Other.example.com/P#a#b")).when(i % 4 == 2, F.concat(F.lit("/relative/"), i.cast("string"), F.lit("#x"))).otherwise(F.col("url"))
    )
    return t.load(s, d, "pages").select(i, x.canonical_url(said, "kb.example.com").alias("url"))


@query("str16_domain", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages".replace("\\\\", "\\"))
def str16(s, d):
    return t.load(s, d, "pages").select("page_id", x.domain(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("domain"))


def _markers_sql() -> str:
    hits = ", ".join(f"len(list_filter(w, lambda y: y IN ({', '.join(repr(m) for m in ms)}))) AS h_{lang}" for lang, ms in x.MARKERS.items())
    best = "greatest(" + ", ".join(f"h_{lang}" for lang in x.MARKERS) + ")"
    pick = " ".join(f"WHEN h_{lang} = b THEN '{lang}'" for lang in x.MARKERS)
    return rf"""WITH w AS (SELECT doc_id, length(trim(text)) AS n, regexp_extract_all(lower(trim(text)), '\p{{L}}+') AS w FROM documents),
h AS (SELECT *, {hits} FROM w), b AS (SELECT *, {best} AS b FROM h)
SELECT doc_id, CASE WHEN n < 15 OR b = 0 THEN '' ELSE CASE {pick} END END AS lang,
  CASE WHEN n < 15 OR b = 0 THEN 0.0::DOUBLE ELSE round(least(0.95::DOUBLE, b / len(w)::DOUBLE * 2.5, b * 0.3::DOUBLE), 2) END AS confidence FROM b"""


@query("str22_language", _markers_sql())
def str22(s, d):
    return t.load(s, d, "documents").select("doc_id", x.detect_language(F.col("text")).alias("l")).select("doc_id", "l.lang", "l.confidence")


@query("str23_sticky_language", "WITH d AS (" + _markers_sql() + ") SELECT d.doc_id, CASE WHEN confidence >= 0.7 AND length(text) >= 20 AND d.lang <> '' THEN d.lang ELSE o.lang END AS session_lang FROM d JOIN documents o USING (doc_id)")
def str23(s, d):
    """A session changes its language only for a sure and long enough message."""
    docs = t.load(s, d, "documents").withColumn("l", x.detect_language(F.col("text")))
    sure = (F.col("l.confidence") >= 0.7) & (F.length("text") >= 20) & (F.col("l.lang") != "")
    return docs.select("doc_id", F.when(sure, F.col("l.lang")).otherwise(F.col("lang")).alias("session_lang"))


@query("str21_prices_skus", r"""
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text || ' AB-' || doc_id || ' 12-34 ' || doc_id || 'X', '\b[A-Z0-9]{2,}-[A-Z0-9-]{2,}\b'), lambda c: regexp_matches(c, '[A-Z]')))) AS n_skus,
  CASE WHEN doc_id % 3 <> 1 THEN doc_id % 50 + 0.25 END AS least, CASE WHEN doc_id % 3 <> 2 THEN (doc_id % 90)::DOUBLE END AS most
FROM (SELECT doc_id, regexp_replace(text, '[0-9]+', '', 'g') AS text FROM documents)""")
def str21(s, d):
    """Codes in texts, and price bounds in a question that ends them."""
    i = F.col("doc_id")
    bare = F.regexp_replace("text", "[0-9]+", "")
    text = F.concat(bare, F.lit(" AB-"), i.cast("string"), F.lit(" 12-34 "), i.cast("string"), F.lit("X"))
    least = F.when(i % 3 != 1, F.concat(F.lit(" at least € "), (i % 50).cast("string"), F.lit(",25"))).otherwise("")
    most = F.when(i % 3 != 2, F.concat(F.lit(" meno di "), (i % 90).cast("string"), F.lit("€"))).otherwise("")
    bounds = x.price_bounds(F.concat(bare, least, most))
    return t.load(s, d, "documents").select(i, F.size(x.skus(text)).cast("long").alias("n_skus"), bounds["min"].alias("least"), bounds["max"].alias("most"))


@query("str27_citations", r"""
WITH c AS (SELECT doc_id, text || ' [#' || doc_id % 5 || '] [#' || doc_id % 3 || '] [#99999999999]' AS text FROM documents)
SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[#(\d+)\]', 1), lambda n: TRY_CAST(n AS INT)), lambda n: n IS NOT NULL))) AS cited,
  md5(trim(regexp_replace(regexp_replace(text, '[ \t\n\v\f\r]*\[#\d+\]', '', 'g'), '[ \t]{2,}', ' ', 'g'))) AS without FROM c""")
def str27(s, d):
    """Citations of texts that end with three, one of which numbers nothing; and the texts without them."""
    i = F.col("doc_id")
    marked = F.concat("text", F.lit(" [#"), (i % 5).cast("string"), F.lit("] [#"), (i % 3).cast("string"), F.lit("] [#99999999999]"))
    return t.load(s, d, "documents").select(i, F.size(x.citations(marked)).cast("long").alias("cited"), F.md5(x.without_citations(marked)).alias("without"))


@query("str26_slash_commands", r"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'kb.add_entry' WHEN 1 THEN 'kb.re_index' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'memory.teach' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'key=' || user_id || 'b' WHEN 1 THEN '_tail=rest of it,source=a "b" ' || user_id WHEN 4 THEN '_tail=the fact ' || user_id ELSE '' END AS args, event_id % 5 = 2 AS help FROM events""")
def str26(s, d):
    """Commands in every form: repeated keys, both kinds of quotes, hyphens, a tail, help, none that is known."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    said = (
        F.when(i % 5 == 0, F.concat(F.lit(" /kb ADD key:a key:"), u, F.lit("b")))
        .when(i % 5 == 1, F.concat(F.lit("/KB re-index source:'a \"b\" "), u, F.lit("' rest of it")))
        .when(i % 5 == 2, F.lit("/help kb")).when(i % 5 == 3, F.lit("/ nothing")).otherwise(F.concat(F.lit("/memory teach  the fact "), u))
    )
    c = F.col("c")
    pairs = F.array_sort(F.transform(F.map_entries(c["args"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t.load(s, d, "events").select(i, x.slash_command(said).alias("c")).select(i, c["action"].alias("action"), F.array_join(pairs, ",").alias("args"), c["help"].alias("help"))


@query("prj05_excerpt")
def prj05(s, d):
    return t.kb_documents(s, d).select("doc_id", x.excerpt(F.col("text"), F.col("title")).alias("excerpt"))


@query("prj01_search_projection", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS content FROM documents")
def prj01(s, d):
    return t.load(s, d, "documents").select("doc_id", F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("…"))).otherwise(F.col("text")).alias("content"))


@query("str18_luhn_iban", """
WITH n AS (SELECT doc_id, (4000000000000000 + doc_id * 7919)::VARCHAR AS card, 'GB' || lpad((doc_id % 97 + 1)::VARCHAR, 2, '0') || ' WEST ' || lpad((doc_id * 31)::VARCHAR, 14, '1') AS code,
  (32142829::HUGEINT * 100000000000000 + lpad((doc_id * 31)::VARCHAR, 14, '1')::HUGEINT) * 1000000 + 161100 + doc_id % 97 + 1 AS number FROM documents),
d AS (SELECT *, list_transform(range(1, 17), lambda i: card[i]::INT * (1 + i % 2)) AS doubled FROM n)
SELECT doc_id, list_sum(list_transform(doubled, lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)) % 10 = 0 AS card, number % 97 = 1 AS iban FROM d""")
def str18(s, d):
    """Card numbers by their check digit, and account numbers by their remainder: one of ten, and one of 97, is right."""
    i = F.col("doc_id")
    card = (F.lit(4000000000000000) + i * 7919).cast("string")
    code = F.concat(F.lit("GB"), F.lpad((i % 97 + 1).cast("string"), 2, "0"), F.lit(" WEST "), F.lpad((i * 31).cast("string"), 14, "1"))
    return t.load(s, d, "documents").select(i, x.luhn(card).alias("card"), x.iban(code).alias("iban"))


@query("hsh01_hashes", "SELECT doc_id, sha1(lang || '|' || text) AS chunk_hash, sha256(text) AS text_hash, md5(text) AS cache_key FROM documents")
def hsh01(s, d):
    return t.load(s, d, "documents").select("doc_id", F.sha1(F.concat_ws("|", "lang", "text").cast("binary")).alias("chunk_hash"), F.sha2("text", 256).alias("text_hash"), F.md5(F.col("text").cast("binary")).alias("cache_key"))


@query("hsh02_ip_hash", """
SELECT event_id, sha256(CASE event_id % 3 WHEN 0 THEN '10.0.' || user_id % 7 || '.0' WHEN 1 THEN '2001:db8:' || user_id % 7 || '::' ELSE '2001:db8:0::' END || '|salt|' || strftime(ts, '%Y-%m-%d')) AS ip_hash FROM events""")
def hsh02(s, d):
    """Addresses cut to /24 or /48 and salted, a salt a day, before they are hashed: IPv4, whole IPv6, short IPv6."""
    i, u = F.col("event_id"), F.col("user_id")
    group = (u % 7).cast("string")
    ip = (
        F.when(i % 3 == 0, F.concat(F.lit("10.0."), group, F.lit("."), (u % 250).cast("string")))
        .when(i % 3 == 1, F.concat(F.lit("2001:0DB8:"), F.lpad(group, 4, "0"), F.lit(":1:2:3:4:"), F.hex(u))).otherwise(F.concat(F.lit("2001:db8::"), F.hex(u)))
    )
    salt = F.concat(F.lit("salt|"), F.date_format("ts", "yyyy-MM-dd"))
    return t.load(s, d, "events").select(i, x.ip_hash(ip, salt).alias("ip_hash"))


@query("mth08_luminance", "SELECT doc_id, round(0.2126 * CASE WHEN r <= 0.03928 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g <= 0.03928 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END + 0.0722 * CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END, 6) AS luminance FROM (SELECT doc_id, (doc_id % 256) / 255.0::DOUBLE AS r, (doc_id * 7 % 256) / 255.0::DOUBLE AS g, (doc_id * 13 % 256) / 255.0::DOUBLE AS b FROM documents)")
def mth08(s, d):
    hex2 = lambda m: F.lpad(F.hex((F.col("doc_id") * m) % 256), 2, "0")
    return t.load(s, d, "documents").select("doc_id", F.round(x.luminance(F.concat(F.lit("#"), hex2(1), hex2(7), hex2(13))), 6).alias("luminance"))


@query("mth09_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def mth09(s, d):
    return t.load(s, d, "documents").select("doc_id", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))


@query("str17a_masked_emails", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}')) AS emails, regexp_replace(text, '[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}', '[email]', 'g') AS text FROM documents")
def str17a(s, d):
    email = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}"
    return t.load(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(email)).cast("long").alias("emails"), F.regexp_replace("text", email, "[email]").alias("text"))
