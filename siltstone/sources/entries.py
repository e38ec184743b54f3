"""Sources that are tables: products with their live facts, the site's identity, entries written by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facts of a product that a setting can switch off.
MASKS = ("prices", "stock", "attributes", "variations", "reviews")
REVIEWS, VARIATIONS = 5, 20
PRODUCT_WEIGHT, SITE_WEIGHT = 75, 80


def _money(c: str) -> Column:
    return F.format_string("%.2f", F.col(c).cast("double"))


def product_documents(products: DataFrame, variations: DataFrame, reviews: DataFrame, shown: tuple[str, ...] = MASKS) -> DataFrame:
    """``external_id``, ``title``, ``structured`` (JSON facts), ``blocks``, ``weight`` of each product.

    ``products``: ``product_id``, ``name``, ``sku``, ``kind``, ``regular_price``, ``sale_price``, ``currency``, ``quantity``, ``attributes`` (name to value), ``categories``,
    ``tags`` (lists), ``description``; ``variations``: ``product_id``, ``label``, ``price``, ``in_stock``; ``reviews``: ``product_id``, ``review_id``, ``rating``, ``text``. Facts whose
    mask is not in ``shown`` are neither in the facts nor in the blocks; empty ones are left out. Of a product's variations the cheapest ``VARIATIONS`` and of its reviews the
    newest ``REVIEWS`` are named (that is the reference's page), ratings are averaged over all; both are cut per product before lists are made.
    """
    on = {m: m in shown for m in MASKS}

    def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("product_id").orderBy(*order))).where(F.col("nth") <= most)

    offered = F.concat("label", F.lit(": "), _money("price"), F.when(F.col("in_stock"), "").otherwise(" (out of stock)"))
    kinds = newest(variations, [F.col("price"), F.col("label")], VARIATIONS).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("nth", offered.alias("line")))).alias("v"))
    prices = variations.groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    rated = reviews.groupBy("product_id").agg(F.round(F.avg("rating"), 2).alias("rating"), F.count("*").alias("reviews"))
    said = newest(reviews, [F.desc("review_id"), F.col("text")], REVIEWS).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("r"))
    rows = products
    for more in (kinds, prices, rated, said):
        rows = rows.join(more.withColumnRenamed("product_id", "__of"), F.col("product_id") == F.col("__of"), "left").drop("__of")
    sale = F.col("sale_price").isNotNull() & (F.col("sale_price") < F.col("regular_price"))
    given = lambda mask, c: c if on[mask] else F.lit(None)
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    lines = F.transform("v", lambda x: x["line"])
    facts = F.struct(
        F.when(F.col("sku") != "", F.col("sku")).alias("sku"),
        F.col("kind").alias("type"),
        given("prices", F.when(sale, _money("sale_price")).otherwise(_money("regular_price"))).alias("price"),
        given("prices", _money("regular_price")).alias("regular_price"),
        given("prices", F.when(F.col("sale_price").isNotNull(), _money("sale_price"))).alias("sale_price"),
        given("prices", F.col("currency")).alias("currency"),
        given("prices", F.coalesce(sale, F.lit(False))).alias("is_on_sale"),
        given("stock", F.when(F.coalesce(F.col("quantity") > 0, F.lit(True)), "instock").otherwise("outofstock")).alias("stock_status"),
        given("stock", F.col("quantity")).alias("stock_quantity"),
        given("attributes", F.when(F.size("attributes") > 0, F.col("attributes"))).alias("attributes"),
        some(F.col("categories")).alias("categories"),
        some(F.col("tags")).alias("tags"),
        given("variations", F.when(F.col("low") < F.col("high"), F.concat(_money("low"), F.lit(" - "), _money("high")))).alias("price_range"),
        given("variations", lines).alias("variations"),
        given("reviews", F.col("rating")).alias("average_rating"),
        given("reviews", F.col("reviews")).alias("review_count"),
    )
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(0).alias("level"))
    texts = F.filter(F.array(F.trim("description")), lambda x: F.coalesce(x, F.lit("")) != "")
    blocks = F.transform(texts, lambda x: block("paragraph", x))
    if on["reviews"]:
        blocks = F.concat(blocks, F.transform(F.coalesce("r", F.array().cast("array<struct<nth:int,text:string>>")), lambda x: block("paragraph", F.concat(F.lit("Review: "), x["text"]))))
    return rows.select(F.col("product_id").cast("string").alias("external_id"), F.col("name").alias("title"), F.to_json(facts).alias("structured"), blocks.alias("blocks"), F.lit(PRODUCT_WEIGHT).alias("weight"))


def site_document(options: DataFrame) -> DataFrame:
    """One row (``title``, ``structured``, ``blocks``, ``weight``) of the site's ``options`` (``name``, ``value``): a few dozen rows.

    ``name``, ``tagline``, ``url``, ``language``, ``timezone`` and ``phone``, ``email`` are the site's; the store's address is ``address_1``, ``address_2``, ``postcode``,
    ``city`` and the state and country of ``default_country`` (country:state) on one line. Empty options are left out. Of an option given twice the greatest value counts.
    """
    wanted = ("name", "tagline", "url", "language", "timezone", "phone", "email", "currency", "address_1", "address_2", "postcode", "city", "default_country")
    value = lambda n: F.max(F.when((F.col("name") == n) & (F.trim("value") != ""), F.trim("value"))).alias(n)
    o = options.agg(*(value(n) for n in wanted))
    place = F.split("default_country", ":")
    state, country = F.get(place, F.lit(1)), F.get(place, F.lit(0))
    town = F.concat_ws(" ", "postcode", "city")
    address = F.concat_ws(", ", "address_1", "address_2", F.when(town != "", town), F.when(state != "", state), F.when(country != "", country))
    site = F.struct(*(F.col(n) for n in ("name", "tagline", "url", "language", "timezone", "phone", "email")))
    store = F.struct("currency", F.when(address != "", address).alias("address"))
    title = F.coalesce("name", F.lit("Site identity"))
    head = F.struct(F.lit("heading").alias("kind"), F.coalesce("name", "url", F.lit("")).alias("text"), F.lit(1).alias("level"))
    line = F.struct(F.lit("paragraph").alias("kind"), F.col("tagline").alias("text"), F.lit(0).alias("level"))
    blocks = F.when(F.col("tagline").isNotNull(), F.array(head, line)).otherwise(F.array(head))
    return o.select(title.alias("title"), F.to_json(F.struct(site.alias("site"), store.alias("store"))).alias("structured"), blocks.alias("blocks"), F.lit(SITE_WEIGHT).alias("weight"))


def entry_blocks(content: Column, subtype: Column, title: Column) -> Column:
    """Blocks of an entry: ``#`` lines are headings of their level, other paragraphs end at blank lines; of a question the whole content is one ``faq`` block."""
    apart = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?m)^(#{1,6} [^\n]*)$", "\n\n$1\n\n")
    parts = F.filter(F.transform(F.split(apart, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    level = lambda p: F.length(F.regexp_extract(p, r"^(#{1,6}) ", 1))
    made = F.transform(
        parts,
        lambda p: F.struct(
            F.when(level(p) > 0, "heading").otherwise("paragraph").alias("kind"), F.regexp_replace(p, r"^#{1,6} +", "").alias("text"), level(p).cast("int").alias("level")
        ),
    )
    asked = F.concat(F.lit("Q: "), title, F.lit("\nA: "), F.trim(content))
    faq = F.array(F.struct(F.lit("faq").alias("kind"), asked.alias("text"), F.lit(0).alias("level")))
    return F.when((subtype == "faq") & (F.trim(F.coalesce(content, F.lit(""))) != ""), faq).otherwise(made)


def entries_after(operations: DataFrame) -> DataFrame:
    """``entry_id``, ``title``, ``content``, ``subtype``, ``status`` (active or trashed) after a log of operations; purged entries are gone.

    ``operations``: ``entry_id``, ``nth`` (their order, unique per entry), ``op``, ``title``, ``content``, ``subtype``. ``create`` and ``update`` write (a null field of an update stays as it was) and
    make the entry active, ``trash`` hides it, ``restore`` brings back what is trashed, ``purge`` deletes what is trashed. What comes before an entry's creation or after its purge has no effect.
    """
    order = Window.partitionBy("entry_id").orderBy("nth")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    born = F.min(F.when(F.col("op") == "create", F.col("nth"))).over(Window.partitionBy("entry_id"))
    rows = operations.withColumn("born", born).where(F.col("nth") >= F.col("born"))
    hides = F.last(F.when(F.col("op").isin("create", "update", "restore"), False).when(F.col("op") == "trash", True), ignorenulls=True)
    rows = rows.withColumn("trashed", hides.over(upto))
    gone = F.min(F.when((F.col("op") == "purge") & F.col("trashed"), F.col("nth"))).over(Window.partitionBy("entry_id"))
    rows = rows.withColumn("gone", gone).where(F.col("gone").isNull())
    writes = F.col("op").isin("create", "update")
    last = lambda c: F.max_by(F.when(writes, F.col(c)), F.when(writes & F.col(c).isNotNull(), F.col("nth"))).alias(c)
    return rows.groupBy("entry_id").agg(
        last("title"), last("content"), last("subtype"), F.when(F.max_by("trashed", "nth"), "trashed").otherwise("active").alias("status")
    )
