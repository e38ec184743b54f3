"""Posts and pages as documents: builder texts or HTML, with excerpt, terms, chosen meta fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import builder, html

PAGE_WEIGHT, POST_WEIGHT = 60, 50
_BLOCKS = html.BLOCKS


def post_documents(
    posts: DataFrame, terms: DataFrame, meta: DataFrame, templates: DataFrame, kinds: tuple[str, ...] = ("post", "page"), fields: tuple[str, ...] = (), home: str = ""
) -> DataFrame:
    """``doc_id``, ``subtype``, ``title``, ``blocks``, ``links``, ``structured``, ``thumbnail_id``, ``weight`` of published posts of ``kinds``.

    ``posts``: ``doc_id``, ``status``, ``kind``, ``title``, ``excerpt``, ``html``, ``tree`` (a page builder's JSON, or null), ``thumbnail_id``; ``terms``: ``doc_id``, ``taxonomy``,
    ``name``; ``meta``: ``doc_id``, ``field``, ``value``; ``templates``: ``tree_id``, ``tree``. What a builder's tree says comes before the HTML: only a post whose tree has no texts is read as HTML. An
    excerpt is the first paragraph, and a list of terms, a taxonomy a line, the last block. ``structured`` has the scalar meta fields of ``fields`` (of equal ones the
    greatest value). The thumbnail is the post's, else the page's first image. Posts with neither blocks nor fields have no document. Ids must be unique; a post's terms and fields are
    cut to it before they are listed.
    """
    shown = posts.where((F.col("status") == "publish") & F.col("kind").isin(*kinds))
    paragraph = lambda text: F.struct(F.lit("paragraph").alias("kind"), text.alias("text"), F.lit(0).alias("level"))
    built = builder.inlined(shown.where("tree IS NOT NULL").select(F.col("doc_id").alias("tree_id"), "tree"), templates)
    built = built.groupBy(F.col("tree_id").alias("b_id")).agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("b"))
    with_tree = shown.join(built, F.col("doc_id") == F.col("b_id"), "left")
    unread = with_tree.where("b IS NULL").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("html"))
    read = html.normalize_pages(unread, home).select(F.col("page_id").alias("h_id"), F.col("blocks").alias("h"), F.col("links"), "image_ids")
    rows = with_tree.join(read, F.col("doc_id") == F.col("h_id"), "left")

    lines = terms.where(F.trim("name") != "").groupBy("doc_id", "taxonomy").agg(F.array_join(F.array_sort(F.collect_set(F.trim("name"))), ", ").alias("names"))
    line = F.concat("taxonomy", F.lit(": "), "names")
    listed = lines.groupBy(F.col("doc_id").alias("t_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("term_lines"))
    chosen = meta.where(F.col("field").isin(*fields) & (F.trim("value") != "")).groupBy("doc_id", "field").agg(F.max(F.trim("value")).alias("value"))
    kept = chosen.groupBy(F.col("doc_id").alias("m_id")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("structured"))
    rows = rows.join(listed, F.col("doc_id") == F.col("t_id"), "left").join(kept, F.col("doc_id") == F.col("m_id"), "left")

    none = F.array().cast(_BLOCKS)
    excerpt = F.trim(F.regexp_replace(F.coalesce("excerpt", F.lit("")), "<[^>]*>", ""))
    body = F.when(F.col("b").isNotNull(), F.transform("b", lambda x: paragraph(x["text"]))).otherwise(F.coalesce("h", none))
    last = F.struct(F.lit("list").alias("kind"), F.col("term_lines").alias("text"), F.lit(0).alias("level"))
    blocks = F.concat(
        F.when(excerpt != "", F.array(paragraph(excerpt))).otherwise(none), body.cast(_BLOCKS), F.when(F.col("term_lines").isNotNull(), F.array(last)).otherwise(none)
    )
    thumbnail = F.coalesce(F.when(F.col("thumbnail_id") > 0, F.col("thumbnail_id")), F.get("image_ids", F.lit(0)))
    made = rows.select(
        "doc_id", F.col("kind").alias("subtype"), F.coalesce("title", F.lit("")).alias("title"), blocks.alias("blocks"), F.coalesce("links", F.array().cast(html.LINKS)).alias("links"), "structured",
        thumbnail.cast("int").alias("thumbnail_id"), F.when(F.col("kind") == "page", PAGE_WEIGHT).otherwise(POST_WEIGHT).alias("weight"),
    )
    return made.where((F.size("blocks") > 0) | F.col("structured").isNotNull())
