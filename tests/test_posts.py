"""Posts as documents on stated cases."""

from __future__ import annotations

import json

from siltstone.sources import posts

LONG = "A text of the builder that is long enough to count."


def test_post_documents(spark):
    tree = json.dumps([{"elType": "widget", "settings": {"title": LONG}}, {"elType": "template", "settings": {"template_id": 1}}])
    rows = [
        (1, "publish", "page", "Page", " <b>Short</b> version ", "<p>not read</p>", tree, 5),
        (2, "publish", "post", "Post", None, "<h2>Head</h2><p>Body <a href='/x'>x</a></p><img class='wp-image-9'>", None, None),
        (3, "draft", "post", "Draft", "e", "<p>p</p>", None, None),
        (4, "publish", "attachment", "File", "e", "<p>p</p>", None, None),
        (5, "publish", "post", "Empty", " ", "", "[]", 0),
        (6, "publish", "post", None, "", None, None, None),
        (7, "publish", "post", "Short tree", "", "<p>from html</p>", "[\"short\"]", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, status string, kind string, title string, excerpt string, html string, tree string, thumbnail_id int").repartition(3)
    terms = spark.createDataFrame([(2, "tag", "b"), (2, "tag", " a "), (2, "tag", "a"), (2, "category", "News"), (1, "tag", " "), (3, "tag", "x")], "doc_id long, taxonomy string, name string")
    meta = spark.createDataFrame([(6, "price", "12"), (6, "secret", "no"), (2, "price", " "), (6, "price", "11"), (6, "size", " L ")], "doc_id long, field string, value string")
    templates = spark.createDataFrame([(1, json.dumps([LONG + " Twice."]))], "tree_id long, tree string")
    got = {r.doc_id: r for r in posts.post_documents(df, terms, meta, templates, fields=("price", "size"), home="https://h").collect()}
    blocks = {i: [(b.kind, b.text, b.level) for b in r.blocks] for i, r in got.items()}
    assert blocks == {
        1: [("paragraph", "Short version", 0), ("paragraph", LONG, 0), ("paragraph", LONG + " Twice.", 0)],
        2: [("heading", "Head", 2), ("paragraph", "Body x", 0), ("list", "category: News\ntag: a, b", 0)],
        6: [],
        7: [("paragraph", "from html", 0)],
    }
    assert {i: (r.subtype, r.title, r.weight, r.thumbnail_id) for i, r in got.items()} == {1: ("page", "Page", 60, 5), 2: ("post", "Post", 50, 9), 6: ("post", "", 50, None), 7: ("post", "Short tree", 50, None)}
    assert json.loads(got[6].structured) == {"price": "12", "size": "L"} and got[2].structured is None
    assert [tuple(x) for x in got[2].links] == [("https://h/x", "x")] and got[1].links == []
    assert posts.post_documents(df.limit(0), terms, meta, templates).count() == 0
