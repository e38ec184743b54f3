"""Products, the site's document and entries by hand on small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltstone.sources import entries

PRODUCT = (
    "product_id long, name string, sku string, kind string, regular_price double, sale_price double, currency string, quantity long, "
    "attributes map<string,string>, categories array<string>, tags array<string>, description string"
)


def documents(spark, shown=entries.MASKS):
    products = spark.createDataFrame(
        [
            (1, "Shoe", "S-1", "variable", 20.0, 15.0, "EUR", 3, {"colour": "red"}, ["a", "b"], [], " Good. "),
            (2, "Hat", "", "simple", 5.0, 6.0, "EUR", 0, {}, [], ["t"], None),
            (3, "Bag", None, "simple", 7.5, None, None, None, None, None, None, ""),
        ],
        PRODUCT,
    )
    kinds = spark.createDataFrame([(1, "L", 22.0, True), (1, "S", 18.5, False), (2, "one", 5.0, True)], "product_id long, label string, price double, in_stock boolean")
    reviews = spark.createDataFrame([(1, i, i % 5 + 1, f"r{i}") for i in range(7)], "product_id long, review_id long, rating int, text string")
    rows = entries.product_documents(products, kinds, reviews, shown).collect()
    return {r.external_id: (r.title, json.loads(r.structured), [b.text for b in r.blocks]) for r in rows}


def test_products(spark):
    got = documents(spark)
    assert got["1"] == (
        "Shoe",
        {
            "sku": "S-1", "type": "variable", "price": "15.00", "regular_price": "20.00", "sale_price": "15.00", "currency": "EUR", "is_on_sale": True, "stock_status": "instock",
            "stock_quantity": 3, "attributes": {"colour": "red"}, "categories": "a, b", "price_range": "18.50 - 22.00", "variations": ["S: 18.50 (out of stock)", "L: 22.00"],
            "average_rating": 2.57, "review_count": 7,
        },
        ["Good.", "Review: r6", "Review: r5", "Review: r4", "Review: r3", "Review: r2"],
    )
    assert got["2"][1] == {"type": "simple", "price": "5.00", "regular_price": "5.00", "sale_price": "6.00", "currency": "EUR", "is_on_sale": False, "stock_status": "outofstock", "stock_quantity": 0, "tags": "t", "variations": ["one: 5.00"]}
    assert got["3"] == ("Bag", {"type": "simple", "price": "7.50", "regular_price": "7.50", "is_on_sale": False, "stock_status": "instock"}, [])


def test_facts_that_are_switched_off_are_nowhere(spark):
    got = documents(spark, shown=("attributes",))
    assert got["1"] == ("Shoe", {"sku": "S-1", "type": "variable", "attributes": {"colour": "red"}, "categories": "a, b"}, ["Good."])


def test_site_document(spark):
    def made(**options):
        rows = [(k, v) for k, v in options.items()] or [("x", "y")]
        (row,) = entries.site_document(spark.createDataFrame(rows, "name string, value string")).collect()
        return row.title, json.loads(row.structured), [(b.kind, b.text) for b in row.blocks]

    assert made(name=" Shop ", tagline="Best", phone="", city="Verona", postcode="37100", address_1="Via 1", default_country="IT:VR", currency="EUR") == (
        "Shop", {"site": {"name": "Shop", "tagline": "Best"}, "store": {"currency": "EUR", "address": "Via 1, 37100 Verona, VR, IT"}}, [("heading", "Shop"), ("paragraph", "Best")])
    assert made(url="https://a.b", default_country="DE") == ("Site identity", {"site": {"url": "https://a.b"}, "store": {"address": "DE"}}, [("heading", "https://a.b")])
    assert made() == ("Site identity", {"site": {}, "store": {}}, [("heading", "")])


LOGS = {
    1: ([("create", "t", "c"), ("update", None, "c2"), ("trash", None, None), ("restore", None, None)], ("t", "c2", "active")),
    2: ([("create", "t", "c"), ("trash", None, None), ("purge", None, None), ("update", "new", "x")], None),
    3: ([("create", "t", "c"), ("purge", None, None)], ("t", "c", "active")),
    4: ([("update", "early", "x"), ("trash", None, None)], None),
    5: ([("trash", None, None), ("create", "t", "c"), ("trash", None, None), ("update", "t2", None)], ("t2", "c", "active")),
    6: ([("create", "t", "c"), ("restore", None, None), ("trash", None, None)], ("t", "c", "trashed")),
    7: ([("create", "t", "c"), ("trash", None, None), ("restore", None, None), ("purge", None, None)], ("t", "c", "active")),
}


def test_entries_after_their_operations(spark):
    rows = [(i, n, op, title, content, "note" if op == "create" else None) for i, (log, _) in LOGS.items() for n, (op, title, content) in enumerate(log)]
    df = spark.createDataFrame(rows, "entry_id long, nth int, op string, title string, content string, subtype string").repartition(4)
    got = {r.entry_id: (r.title, r.content, r.status) for r in entries.entries_after(df).collect()}
    assert got == {i: want for i, (_, want) in LOGS.items() if want}


def test_blocks_of_entries(spark):
    cases = [("## Head\nfirst\nline\n\nnext\n# Top", "note"), ("why not", "faq"), (" ", "faq"), (None, "note")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, content string, subtype string")
    got = {r.i: [tuple(b) for b in r.b] for r in df.select("i", entries.entry_blocks(F.col("content"), F.col("subtype"), F.lit("T")).alias("b")).collect()}
    assert got == {0: [("heading", "Head", 2), ("paragraph", "first\nline", 0), ("paragraph", "next", 0), ("heading", "Top", 1)], 1: [("faq", "Q: T\nA: why not", 0)], 2: [], 3: []}
