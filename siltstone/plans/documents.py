"""Sources: pages, files, menus, products, terms; chunks; masking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import redaction, schedule
from ..functions import text as x
from ..operators import chunks, indexing
from ..operators.postings_index import PostingsIndex
from ..scratch import new_folder, saver
from ..sources import builder, crawl, entries, files, html, menus, posts
from ..streaming import state as st
from .registry import query


def _pages(s, d):
    return html.normalize_pages(t.load(s, d, "pages"), "https://kb.example.com")


@query("src12_html_blocks")
def src12(s, d):
    """Blocks of every page, exploded."""
    return _pages(s, d).select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.kind", "b.text", "b.level")


@query("src04_menu_links", r"SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1) AS hrefs FROM pages")
def src04(s, d):
    return _pages(s, d).select("page_id", F.transform("menu", lambda m: m["url"]).alias("hrefs"))


@query("src03_page_documents")
def src03(s, d):
    """Published pages and posts as documents: builder tree or HTML, excerpt, terms, chosen fields; every 13th is a draft, every fourth made by a builder."""
    i = F.col("page_id")
    pages = t.load(s, d, "pages")
    words = F.lit("This page was made by a builder, and it is number ")
    tree = F.when(i % 4 == 0, F.to_json(F.struct(F.array(F.struct(F.concat(words, i.cast("string")).alias("title"))).alias("elements"))))
    rows = pages.select(
        i.alias("doc_id"), F.when(i % 13 == 0, "draft").otherwise("publish").alias("status"), F.when(i % 2 == 0, "page").otherwise("post").alias("kind"), F.concat(F.lit("Page "), i.cast("string")).alias("title"),
        F.when(i % 3 == 0, F.concat(F.lit("In short: "), i.cast("string"))).alias("excerpt"), "html", tree.alias("tree"), F.lit(0).alias("thumbnail_id"))
    terms = pages.where(i % 5 != 0).select(i.alias("doc_id"), F.lit("site").alias("taxonomy"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("name"))
    meta = pages.select(i.alias("doc_id"), F.lit("price").alias("field"), (i % 100).cast("string").alias("value")).unionByName(pages.select(i.alias("doc_id"), F.lit("secret").alias("field"), F.lit("x").alias("value")))
    no_templates = s.createDataFrame([], "tree_id long, tree string")
    made = posts.post_documents(rows, terms, meta, no_templates, fields=("price",), home="https://kb.example.com")
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return made.select("doc_id", "subtype", "title", text.alias("text"), F.size("blocks").alias("blocks"), F.size("links").alias("n_links"), "structured", "thumbnail_id", "weight")


def _chunks(s, d):
    first = F.filter("blocks", lambda b: b["kind"] == "heading")
    docs = _pages(s, d).select(F.col("page_id").alias("doc_id"), F.coalesce(F.get(F.transform(first, lambda b: b["text"]), F.lit(0)), F.lit("")).alias("title"), "blocks", F.lit("").alias("structured"))
    return chunks.chunk_documents(docs)


@query("str08_chunks")
def str08(s, d):
    return _chunks(s, d)


@query("str07_split_texts")
def str07(s, d):
    """Documents' texts as chunks of sentences."""
    paragraph = F.array(F.struct(F.lit("paragraph").alias("kind"), F.col("text").alias("text"), F.lit(0).alias("level")))
    docs = t.kb_documents(s, d).select("doc_id", "title", paragraph.alias("blocks"), F.lit("").alias("structured"))
    return chunks.chunk_documents(docs).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


@query("df01_index_items")
def df01(s, d):
    """Pages indexed in two runs: all of them, and then with a fifth changed, some gone and a kind switched off. What the second run did with each, and its chunks."""
    save, i = saver(s, "indexing"), F.col("doc_id")
    heading = F.get(F.transform(F.filter("blocks", lambda b: b["kind"] == "heading"), lambda b: b["text"]), F.lit(0))
    prints = t.load(s, d, "pages").select(F.col("page_id").alias("of"), F.sha1(F.col("html").cast("binary")).alias("fingerprint"))
    pages = _pages(s, d).join(prints, F.col("page_id") == F.col("of")).select(
        F.col("page_id").alias("doc_id"), F.concat(F.lit("kind"), (F.col("page_id") % 3).cast("string")).alias("subtype"), F.lit("en").alias("lang"), "fingerprint",
        F.coalesce(heading, F.lit("")).alias("title"), "blocks", F.lit(None).cast("string").alias("structured"))
    pages = save(pages)
    kinds = pages.select("subtype").distinct()
    index = PostingsIndex(s, new_folder(s, "pages-index"), x.index_words, x.stem, buckets=16, stored=("heading_path", "kind"), counts=x.TermCounts)
    _, stored, _ = indexing.index_items(index, pages, s.createDataFrame([], indexing.STORED), kinds, save)
    changed = F.when(i % 5 == 0, F.concat("fingerprint", F.lit("+"))).otherwise(F.col("fingerprint"))
    done, _, _ = indexing.index_items(index, pages.where(i % 11 != 0).withColumn("fingerprint", changed), stored, kinds.where("subtype <> 'kind2'"), save)
    return done.select("doc_id", "action", "chunks")


_MENU_SQL = """
WITH RECURSIVE i AS (SELECT lang AS menu_id, doc_id AS item_id, CASE WHEN doc_id = 3 THEN 24 ELSE doc_id // 2 END AS parent_id, 'Item ' || doc_id AS label,
    CASE WHEN doc_id % 5 = 0 THEN '#' WHEN doc_id % 7 = 0 THEN '' ELSE 'https://kb.example.com/' || doc_id END AS url FROM documents),
up AS (SELECT menu_id, item_id, parent_id AS next, []::VARCHAR[] AS path FROM i
  UNION ALL SELECT up.menu_id, up.item_id, i.parent_id, list_prepend(i.label, path) FROM up JOIN i ON i.menu_id = up.menu_id AND i.item_id = up.next AND up.next > 0 WHERE len(path) < 10),
full_path AS (SELECT menu_id, item_id, arg_max(path, len(path)) AS path FROM up GROUP BY 1, 2)
SELECT menu_id, item_id, '• ' || label || CASE WHEN url NOT IN ('', '#') THEN ' → ' || url ELSE '' END || CASE WHEN len(path) > 0 THEN ' (' || array_to_string(path, ' › ') || ')' ELSE '' END AS line,
  CASE WHEN url NOT IN ('', '#') THEN url END AS link FROM i JOIN full_path USING (menu_id, item_id)"""


@query("src04b_menu_tree", _MENU_SQL)
def src04b(s, d):
    """Menus of documents by language, every item below another; some stand below one of another menu, some in a circle."""
    i = F.col("doc_id")
    parent = F.when(i == 3, 24).otherwise(F.floor(i / 2))
    url = F.when(i % 5 == 0, "#").when(i % 7 == 0, "").otherwise(F.concat(F.lit("https://kb.example.com/"), i.cast("string")))
    label = F.concat(F.lit(" <b>Item "), i.cast("string"), F.lit("</b>"))
    items = t.load(s, d, "documents").select(F.col("lang").alias("menu_id"), i.alias("item_id"), parent.alias("parent_id"), label.alias("title"), url.alias("url"))
    return menus.menu_lines(items)


_PAGES_SQL = r"""
SELECT page_id::VARCHAR AS external_id, url, replace(replace(trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&amp;', '&') AS title,
  sha1(html) AS fingerprint FROM pages WHERE html IS NOT NULL"""


@query("src01_site_pages", _PAGES_SQL)
def src01(s, d):
    """The site's pages by the data source, 100 a partition."""
    return crawl.pages(s, f"{d}/pages.parquet", batch=100).drop("html")


@query("src01s_site_stream", _PAGES_SQL)
def src01s(s, d):
    """The same as a stream that follows the site."""
    return st.run_available(crawl.pages(s, f"{d}/pages.parquet", batch=100, stream=True).drop("html"))


@query("src05_terms", "SELECT source AS term, 'Contains ' || count(*) || ' item(s)' AS text, count(*) AS items FROM documents GROUP BY 1")
def src05(s, d):
    n = F.count("*")
    return t.load(s, d, "documents").groupBy(F.col("source").alias("term")).agg(F.concat(F.lit("Contains "), n.cast("string"), F.lit(" item(s)")).alias("text"), n.alias("items"))


_PRODUCT_SQL = """
WITH li AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS review_id, l_linenumber % 5 + 1 AS rating, 'took ' || l_quantity::INT AS said, l_returnflag FROM lineitem),
v AS (SELECT l_partkey, l_returnflag AS label, max(p_retailprice + ascii(l_returnflag)) AS price, l_returnflag <> 'R' AS in_stock FROM li JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 4),
vs AS (SELECT l_partkey, string_agg(label || ': ' || printf('%.2f', price) || CASE WHEN in_stock THEN '' ELSE ' (out of stock)' END, '; ' ORDER BY price, label) AS variations, min(price) AS low, max(price) AS high FROM v GROUP BY 1),
rs AS (SELECT l_partkey, round(avg(rating), 2) AS rating, count(*) AS n FROM li GROUP BY 1),
five AS (SELECT l_partkey, string_agg('Review: ' || said, chr(10) ORDER BY review_id DESC, said) AS said FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY review_id DESC, said) AS r FROM li) WHERE r <= 5 GROUP BY 1)
SELECT p_partkey::VARCHAR AS external_id, p_name AS title, printf('%.2f', CASE WHEN p_size % 4 = 0 THEN p_retailprice - 10 ELSE p_retailprice END) AS price, p_size % 4 = 0 AS on_sale,
  CASE WHEN p_size > 5 THEN 'instock' ELSE 'outofstock' END AS stock, CASE WHEN p_size > 5 THEN p_size ELSE 0 END::BIGINT AS quantity, p_brand AS brand, p_type || ', ' || p_brand AS categories,
  CASE WHEN low < high THEN printf('%.2f', low) || ' - ' || printf('%.2f', high) END AS price_range, variations, rating, n AS reviews,
  'A ' || p_name || CASE WHEN said IS NULL THEN '' ELSE chr(10) || said END AS text
FROM part LEFT JOIN vs ON vs.l_partkey = p_partkey LEFT JOIN rs ON rs.l_partkey = p_partkey LEFT JOIN five f ON f.l_partkey = p_partkey"""


def _products(s, d, shown=entries.MASKS):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    part, lines = t.load(s, d, "part"), t.load(s, d, "lineitem")
    products = part.select(
        k.alias("product_id"), F.col("p_name").alias("name"), F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"), F.lit("variable").alias("kind"), price.alias("regular_price"),
        F.when(F.col("p_size") % 4 == 0, price - 10).alias("sale_price"), F.lit("EUR").alias("currency"), F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).cast("long").alias("quantity"),
        F.create_map(F.lit("brand"), "p_brand").alias("attributes"), F.array("p_type", "p_brand").alias("categories"), F.array().cast("array<string>").alias("tags"),
        F.concat(F.lit("A "), "p_name").alias("description"),
    )
    kinds = lines.groupBy("l_partkey", "l_returnflag").count().join(part, k == F.col("l_partkey")).select(
        k.alias("product_id"), F.col("l_returnflag").alias("label"), (price + F.ascii("l_returnflag")).alias("price"), (F.col("l_returnflag") != "R").alias("in_stock"))
    reviews = lines.select(
        F.col("l_partkey").alias("product_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), (F.col("l_linenumber") % 5 + 1).alias("rating"),
        F.concat(F.lit("took "), F.col("l_quantity").cast("int").cast("string")).alias("text"))
    return entries.product_documents(products, kinds, reviews, shown)


@query("src06_products", _PRODUCT_SQL)
def src06(s, d):
    """Products with price, stock, attributes, categories, variations, rating and their five newest reviews, read back from their facts."""
    fact = lambda path: F.get_json_object("structured", f"$.{path}")
    lines = F.from_json(fact("variations"), "array<string>")
    return _products(s, d).select(
        "external_id", "title", fact("price").alias("price"), fact("is_on_sale").cast("boolean").alias("on_sale"), fact("stock_status").alias("stock"), fact("stock_quantity").cast("long").alias("quantity"),
        fact("attributes.brand").alias("brand"), fact("categories").alias("categories"), fact("price_range").alias("price_range"), F.array_join(lines, "; ").alias("variations"),
        fact("average_rating").cast("double").alias("rating"), fact("review_count").cast("long").alias("reviews"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))


@query("src07_site_identity", """
WITH n AS (SELECT max(n_name) AS city, max(n_nationkey) AS code FROM nation), c AS (SELECT min(r_name) AS country FROM region)
SELECT city || ' shop' AS title, 'Everything of ' || country AS tagline, 'Street ' || code || ', ' || (10000 + code) || ' ' || city || ', S1, ' || country AS address, 2 AS blocks FROM n, c""")
def src07(s, d):
    """The site's document from its options, which are made of the names of nations and regions: the address is joined, country:state split."""
    n = t.load(s, d, "nation").agg(F.max("n_name").alias("city"), F.max("n_nationkey").alias("code"))
    one = n.crossJoin(t.load(s, d, "region").agg(F.min("r_name").alias("country")))  # one row each
    said = {"name": F.concat("city", F.lit(" shop")), "tagline": F.concat(F.lit("Everything of "), "country"), "email": F.lit(" "), "address_1": F.concat(F.lit("Street "), F.col("code").cast("string")),
            "postcode": (F.col("code") + 10000).cast("string"), "city": F.col("city"), "default_country": F.concat("country", F.lit(":S1"))}
    options = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in said.items()))).alias("o")).select("o.*")
    fact = lambda path: F.get_json_object("structured", f"$.{path}")
    return entries.site_document(options).select("title", fact("site.tagline").alias("tagline"), fact("store.address").alias("address"), F.size("blocks").alias("blocks"))


@query("src08_manual_entries", """
WITH o AS (SELECT user_id AS entry_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT *, CASE WHEN n = 1 THEN 'create' WHEN event_type = 'view' THEN 'update' WHEN event_type = 'click' THEN 'trash' WHEN event_type = 'signup' THEN 'restore' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'purge' ELSE 'none' END AS op FROM o),
t AS (SELECT *, last_value(CASE WHEN op IN ('create', 'update', 'restore') THEN false WHEN op = 'trash' THEN true END IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY n) AS trashed FROM r),
g AS (SELECT entry_id FROM t WHERE op = 'purge' AND trashed)
SELECT entry_id, 'Entry ' || entry_id || ' of ' || arg_max(event_id, n) FILTER (op = 'create' OR (op = 'update' AND event_id % 2 = 0)) AS title,
  CASE WHEN arg_max(trashed, n) THEN 'trashed' ELSE 'active' END AS status, (CASE WHEN entry_id % 3 = 0 THEN 1 ELSE 3 END)::INT AS blocks FROM t WHERE entry_id NOT IN (SELECT entry_id FROM g) GROUP BY 1""")
def src08(s, d):
    """Entries after a log of creates, updates (of title or content), trashes, restores and purges; their blocks with headings, or question and answer."""
    w = Window.partitionBy("entry_id").orderBy("event_id")
    rows = t.load(s, d, "events").select(F.col("user_id").alias("entry_id"), "event_id", "event_type").withColumn("nth", F.row_number().over(w))
    kind, i = F.col("event_type"), F.col("event_id")
    op = F.when(F.col("nth") == 1, "create").when(kind == "view", "update").when(kind == "click", "trash").when(kind == "signup", "restore").when((kind == "purchase") & (i % 7 == 0), "purge").otherwise("none")
    titled = F.when((op == "create") | (i % 2 == 0), F.concat(F.lit("Entry "), F.col("entry_id").cast("string"), F.lit(" of "), i.cast("string")))
    content = F.concat(F.lit("## Head\nfirst line\nsecond "), i.cast("string"), F.lit("\n\nlast"))
    log = rows.select("entry_id", "nth", op.alias("op"), titled.alias("title"), content.alias("content"), F.when(F.col("entry_id") % 3 == 0, "faq").otherwise("note").alias("subtype"))
    blocks = entries.entry_blocks(F.col("content"), F.col("subtype"), F.col("title"))
    return entries.entries_after(log).select("entry_id", "title", "status", F.size(blocks).alias("blocks"))


@query("src09_manual_scan", t.with_("kb", body="SELECT doc_id, content_hash AS fingerprint FROM kb WHERE status = 'active' AND source = 'src3' ORDER BY doc_id LIMIT 25 OFFSET 5"))
def src09(s, d):
    return t.kb_documents(s, d).where("status = 'active' AND source = 'src3'").select("doc_id", F.col("content_hash").alias("fingerprint")).orderBy("doc_id").offset(5).limit(25)


@query("src10_builder_trees", r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', ' ', 'g')) AS text FROM documents),
own AS (SELECT doc_id, text FROM x WHERE length(text) > 25 AND NOT regexp_matches(text, '^(?:https?://|\[[\p{L}\p{N}_]+|[.#]?[\p{L}\p{N}_\-]+\s*\{)')),
part AS (SELECT p_partkey, 'This template speaks of ' || p_name || ' at length.' AS text FROM part),
has AS (SELECT doc_id, doc_id % 50 + 1 AS a, (doc_id % 50 + 1) % 60 + 1 AS b, ((doc_id % 50 + 1) % 60 + 1) % 60 + 1 AS c FROM documents)
SELECT doc_id, 0 AS nth, text FROM own UNION ALL SELECT doc_id, n + (SELECT count(*) FROM own o WHERE o.doc_id = h.doc_id), p.text FROM (
  SELECT doc_id, 0 AS n, a AS t FROM has UNION ALL SELECT doc_id, 1, b FROM has UNION ALL SELECT doc_id, 2, c FROM has) h JOIN part p ON p.p_partkey = h.t""")
def src10(s, d):
    """Texts of page-builder trees (documents in nested widgets) with their templates in place: each names the next, three within each other, and itself."""
    i = F.col("doc_id")
    ref = lambda of: F.struct(F.lit("template").alias("elType"), F.struct(of.cast("string").alias("template_id")).alias("settings"))
    title = F.struct(F.lit("string").alias("$$type"), F.col("text").alias("value"))
    widget = F.struct(F.lit("widget").alias("elType"), F.struct(title.alias("title"), F.lit("https://x.example/a/long/address").alias("link")).alias("settings"))
    tree = lambda *nodes: F.concat(F.lit("["), F.concat_ws(",", *map(F.to_json, nodes)), F.lit("]"))
    pages = t.load(s, d, "documents").select(i.alias("tree_id"), tree(F.struct(F.array(widget).alias("elements")), ref(i % 50 + 1), ref(i % 50 + 1)).alias("tree"))
    k = F.col("p_partkey")
    text = F.struct(F.concat(F.lit("This template speaks of "), "p_name", F.lit(" at length.")).alias("editor"))
    made = F.when(k <= 60, tree(text, ref(k % 60 + 1), ref(k))).otherwise(tree(text))
    return builder.inlined(pages, t.load(s, d, "part").select(k.alias("tree_id"), made.alias("tree"))).select(F.col("tree_id").alias("doc_id"), "nth", "text")


@query("src11_text_files")
def src11(s, d):
    """Texts as pieces of about 4,000 characters, or sections where there are headings."""
    pieces = files.split_text(F.regexp_replace("text", "\n", "\n\n"))
    return t.load(s, d, "documents").select("doc_id", F.size(pieces).alias("pieces"))


@query("src11b_csv_entries", """
SELECT 'part' AS load, p_partkey AS row, substr(p_name, 1, 120) AS title, substr(p_type, 1, 4000) AS content, 'file' AS type FROM part
UNION ALL SELECT 'nation', n_nationkey, substr(trim(n_name), 1, 120), 'Q: ' || trim(n_name) || chr(10) || 'A: ' || n_regionkey, 'faq' FROM nation
UNION ALL SELECT 'supplier', s_suppkey, substr(trim(s_name), 1, 120), 'S_name: ' || trim(s_name) || chr(10) || 'S_nationkey: ' || s_nationkey, 'file' FROM supplier""")
def src11b(s, d):
    """Tables as entries: by a title and a content column, by question and answer, and by lines of header and value where there are none."""
    part = t.load(s, d, "part").select(F.col("p_partkey").alias("row"), F.lit("part").alias("load"), F.col("p_name").alias("Titolo "), F.col("p_type").alias("TEXT"))
    nation = t.load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.lit("nation").alias("load"), F.col("n_name").alias("Domanda"), F.col("n_regionkey").alias("a"))
    supplier = t.load(s, d, "supplier").select(F.col("s_suppkey").alias("row"), F.lit("supplier").alias("load"), "s_name", "s_nationkey")
    made = [files.table_entries(rows, also=("row", "load")) for rows in (part, nation, supplier)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("src15_sse_events", r"""
SELECT conv_id, turn::BIGINT AS event, md5(role || chr(10) || regexp_replace(text, '[\r\n]+', ' ', 'g')) AS data FROM conversations""")
def src15(s, d):
    """Turns as a server-sent stream (two data lines, one of them ended by a carriage return, a comment and a blank line each), read back."""
    turn = F.col("turn").cast("long") * 4
    line = F.explode(F.array(
        F.struct((turn).alias("n"), F.concat(F.lit("data: "), "role").alias("line")), F.struct((turn + 1).alias("n"), F.concat(F.lit("data:"), F.regexp_replace("text", r"[\r\n]+", " "), F.lit("\r")).alias("line")),
        F.struct((turn + 2).alias("n"), F.lit(": keep-alive").alias("line")), F.struct((turn + 3).alias("n"), F.lit("").alias("line"))))
    lines = t.load(s, d, "conversations").select("conv_id", line.alias("l")).select(F.col("conv_id").alias("stream_id"), F.col("l.n").alias("line_no"), "l.line")
    return files.sse_events(lines).select(F.col("stream_id").alias("conv_id"), F.col("event").cast("long").alias("event"), F.md5("data").alias("data"))


@query("str17_redacted")
def str17(s, d):
    return t.load(s, d, "documents").select("doc_id", redaction.redact("text").alias("text"))


@query("str19_redaction_modes", """
WITH t AS (SELECT doc_id, 'mail a' || doc_id || '@site.io or call +39 055 ' || (100000 + doc_id) || ' in 2015' AS open, 'mail [email] or call [phone] in 2015' AS masked FROM documents)
SELECT doc_id, open AS off_logs, masked AS logs_logs, open AS logs_before_ai, masked AS before_ai_logs, masked AS before_ai_before_ai FROM t""")
def str19(s, d):
    """What each mode masks where texts are logged and where they go to a model."""
    i = F.col("doc_id")
    text = F.concat(F.lit("mail a"), i.cast("string"), F.lit("@site.io or call +39 055 "), (i + 100000).cast("string"), F.lit(" in 2015"))
    pairs = (("off", "logs"), ("logs", "logs"), ("logs", "before_ai"), ("before_ai", "logs"), ("before_ai", "before_ai"))
    return t.load(s, d, "documents").select(i, *(redaction.redact_for(text, mode, site).alias(f"{mode}_{site}") for mode, site in pairs))


@query("str20_fact_guard")
def str20(s, d):
    """Answers checked against the question's text as their facts."""
    m = t.messages(s, d)
    facts = m.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("facts"))
    priced = F.concat("text", F.lit(" It costs $"), F.col("turn").cast("string"), F.lit(".50."))
    answers = m.where("role = 'assistant'").select("msg_id", "conv_id", priced.alias("answer"))
    return answers.join(facts, "conv_id", "left").select("msg_id", redaction.fact_guard("answer", F.coalesce("facts", F.lit(""))).alias("g")).select("msg_id", "g.ok", "g.text", "g.violations")


@query("dat02_cron_next")
def dat02(s, d):
    expr = F.element_at(F.array(*map(F.lit, ["*/15 * * * *", "0 9 * * 1-5", "30 8 L * *", "0 0 15W * *", "0 12 * * 5#2"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.kb_documents(s, d).select("doc_id", expr.alias("expression"), schedule.cron_next_udf(expr, "indexed_at").alias("next_at"))


@query("dat02b_interval_next", t.with_("kb", body="SELECT doc_id, indexed_at + INTERVAL 90 MINUTE AS next_at FROM kb"))
def dat02b(s, d):
    return t.kb_documents(s, d).select("doc_id", (F.col("indexed_at") + F.make_dt_interval(mins=F.lit(90))).alias("next_at"))


@query("src13_embeddings", "SELECT vec_id, len(embedding) AS dims FROM embeddings")
def src13(s, d):
    return t.load(s, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query("df17_embedding_backlog", t.with_("kb", body="SELECT doc_id AS chunk_id, substr(text, 1, 4000) AS content, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM kb WHERE status = 'active' AND doc_id NOT IN (SELECT vec_id FROM embeddings)"))
def df17(s, d):
    """Chunks without vectors in batches of 32, cut to 4,000 characters."""
    from pyspark.sql import Window

    from ..operators.analytics import numbered

    todo = t.kb_documents(s, d).where("status = 'active'").join(t.load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    # Copies of an id are numbered as a run and dealt to its rows by their own place in it, so narrow rows carry the numbers.
    copies = todo.select("doc_id", F.substring("text", 1, 4000).alias("content"))
    places = numbered(copies.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("content")
    texts = copies.withColumn("copy", F.row_number().over(w).cast("long"))
    return texts.join(places, ["doc_id", "copy"]).select(F.col("doc_id").alias("chunk_id"), "content", F.floor(F.col("nth") / 32).alias("batch"))
