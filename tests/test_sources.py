"""Menus, builder trees, the site source, cache, rollup by day against plain loops and fixtures."""

from __future__ import annotations

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import analytics
from siltstone.operators import retrieval as r
from siltstone.sources import builder, crawl, menus
from siltstone.streaming import cache

ITEMS = [
    ("m", 1, 0, "Home", "https://a.b/"), ("m", 2, 1, " <b>Shop</b> ", "#"), ("m", 3, 2, "Shoes", "https://a.b/shoes"), ("m", 4, 99, "Lost", "/lost"),
    ("m", 5, None, "", ""), ("m", 6, 2, "", "/only-url"), ("m", 7, 8, "Round", "/7"), ("m", 8, 7, "About", "/8"), ("m", 9, 9, "Self", None),
    ("m", 10, 5, "Below nothing", "/x"), ("n", 3, 2, "Elsewhere", "/n"),
    *(("deep", i, i - 1, f"L{i}", f"/{i}") for i in range(1, 14)),
]


def brute_path(items, menu, item):
    by_id = {(m, i): (p, t) for m, i, p, t, _ in items}
    out, parent = [], by_id[menu, item][0]
    while parent and parent > 0 and (menu, parent) in by_id and len(out) < 10:
        up, title = by_id[menu, parent]
        out.insert(0, title.replace("<b>", "").replace("</b>", "").strip())
        parent = up
    return out


def test_menu_tree(spark):
    df = spark.createDataFrame(ITEMS, "menu_id string, item_id long, parent_id long, title string, url string").repartition(3)
    got = {(x.menu_id, x.item_id): x.path for x in menus.ancestor_paths(df).collect()}
    assert got == {(m, i): brute_path(ITEMS, m, i) for m, i, *_ in ITEMS}
    assert len(got["m", 7]) == len(got["m", 9]) == len(got["deep", 13]) == 10 and got["deep", 13][-1] == "L12"
    lines = {(x.menu_id, x.item_id): (x.line, x.link) for x in menus.menu_lines(df).collect()}
    assert lines["m", 1] == ("• Home → https://a.b/", "https://a.b/")
    assert lines["m", 2] == ("• Shop (Home)", None)
    assert lines["m", 3] == ("• Shoes → https://a.b/shoes (Home › Shop)", "https://a.b/shoes")
    assert lines["m", 4] == ("• Lost → /lost", "/lost") and lines["m", 6] == ("•  → /only-url (Home › Shop)", "/only-url")
    assert ("m", 5) not in lines and lines["m", 10] == ("• Below nothing → /x ()", "/x") and lines["n", 3] == ("• Elsewhere → /n", "/n")
    assert menus.menu_lines(df.limit(0)).count() == 0


def text(i):
    return f"This is the text of number {i}, long enough."


def template(i, key="template_id"):
    return {"elType": "template", "settings": {key: i}}


TEMPLATES = {
    1: [text(1), template(2), text("1b")], 2: [text(2), template(1), template(3)], 3: [text(3), template(4)], 4: [text(4), template(5)], 5: [text(5)],
    6: [template(6), text(6)], 7: "no list", 8: [template(3), text(8)],
}
PAGES = {
    1: [text("a"), template(1), text("b")],  # 1 > 2 > 3; 4 is one level too deep
    2: [template(3), template(1), template(4)],  # 3 and 4 are there already when 1 names them
    3: [{"elType": "widget", "widgetType": "global", "templateID": "6", "elements": [text("inner")]}, template(99), template(0), template("x")],
    4: [{"$$type": "string", "value": text("wrapped")}, {"elType": "template", "settings": {"templateID": {"$$type": "number", "value": 5}}}],
    5: [template(1), template(8), template(4)],
    6: "not json", 7: [], 8: [template(7), "short", "https://long.example/address/that/counts", "[shortcode with many words in it]", ".rule { color: red; and more }"],
    9: [template(5), template(5)],
}


def brute_inlined(page, depth=3):
    seen, out = set(), []

    def walk(tree, level):
        for piece, of in builder.tree_pieces(json.dumps(tree) if tree != "not json" else tree):
            if piece is not None:
                out.append(piece)
            elif level < depth and of not in seen:
                seen.add(of)
                walk(TEMPLATES.get(of, []), level + 1)

    walk(page, 0)
    return out


def test_templates_in_their_place(spark):
    frame = lambda trees: spark.createDataFrame([(i, t if t == "not json" else json.dumps(t)) for i, t in trees.items()], "tree_id long, tree string")
    got = {}
    for x in builder.inlined(frame(PAGES), frame(TEMPLATES)).collect():
        got.setdefault(x.tree_id, []).append((x.nth, x.text))
    got = {k: [t for _, t in sorted(v)] for k, v in got.items()}
    assert got == {i: brute_inlined(t) for i, t in PAGES.items() if brute_inlined(t)}
    assert got[1] == [text("a"), text(1), text(2), text(3), text("1b"), text("b")]
    assert got[3] == [text(6), text("inner")] and got[4] == [text("wrapped"), text(5)] and 6 not in got and 8 not in got


def test_site_source_in_parts_and_as_a_stream(spark, tmp_path):
    path, checkpoint, out = str(tmp_path / "site"), str(tmp_path / "c"), str(tmp_path / "out")
    seen = {}
    for load in range(3):
        rows = [(i, f"u/{i}", None if i % 7 == 3 else f"<TITLE lang='x'> Page &amp;\n {i} </title><p>é") for i in range(load * 40, load * 40 + 40 - load)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(path)
        seen |= {str(i): (u, f"Page & {i}", hashlib.sha1(h.encode()).hexdigest(), h) for i, u, h in rows if h}
        stream = crawl.pages(spark, path, batch=13, stream=True)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        followed = spark.read.parquet(out).collect()
        assert len(followed) == len(seen) and {x.external_id: tuple(x)[1:] for x in followed} == seen
    df = crawl.pages(spark, f"file://{path}", batch=13)
    assert {x.external_id: tuple(x)[1:] for x in df.collect()} == seen
    parts = df.select("external_id", F.spark_partition_id().alias("p")).collect()
    assert len({x.p for x in parts}) == -(-117 // 13)


@pytest.mark.parametrize("seed", [1, 2])
def test_cache_equals_a_loop_over_several_loads(spark, seed):
    rng = random.Random(seed)
    versions = [(n + 1, 3000.0 * n + rng.randrange(2000)) for n in range(8)]
    asked = sorted((rng.randrange(30_000), i, rng.choice(["price?", "Price? ", "hours", None]), rng.choice(["p", "q"])) for i in range(400))
    store, want = {}, {}
    for second, i, question, provider in asked:
        version = max((n for n, since in versions if since <= second), default=0)
        said = "|".join([provider, "m", "v1", str(version), "en", " ".join((question or "").lower().split()), ""])
        key = hashlib.sha1(said.encode()).hexdigest()
        row = store.get(key)
        if row and second < row["stored"] + 2500:
            row["hits"] += 1
            want[i] = True
        else:
            store[key] = {"stored": float(second), "created": row["created"] if row else float(second), "hits": row["hits"] if row else 0}
            want[i] = False
    df = spark.createDataFrame(asked, "second long, event_id long, question string, provider string").repartition(4)
    lit = F.lit
    key = cache.cache_key(F.col("provider"), lit("m"), lit("v1"), F.col("base_version"), lit("en"), F.col("question"), lit(None).cast("string"))
    versioned = cache.as_of(df, spark.createDataFrame(versions, "version int, since double"), bucket_s=1000)
    lookups = versioned.withColumn("key", key)
    held, got = None, {}
    for low, high in ((0, 9000), (9000, 9001), (9001, 20_000), (20_000, 40_000)):
        found = cache.look_up(lookups.where((F.col("second") >= low) & (F.col("second") < high)), held, 2500.0)
        got |= {x.event_id: x.hit for x in found.collect()}
        held = spark.createDataFrame(cache.written_back(found, held).collect(), cache.CACHE)
    assert got == want and 50 < sum(got.values()) < 380
    assert {x.key: {"stored": x.stored, "created": x.created, "hits": x.hits} for x in held.collect()} == store
    kept = {x.key for x in cache.swept(held, 30_000.0, 2500.0).collect()}
    assert kept == {k for k, v in store.items() if v["stored"] + 2500 >= 30_000}


def test_a_day_worked_out_again_leaves_other_days_files(spark, tmp_path):
    path = str(tmp_path / "rollup")
    schema = "stat_date date, tier string, messages long"
    days = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3), ("2024-01-03", "a", 4)], "stat_date string, tier string, messages long")
    days = days.withColumn("stat_date", F.col("stat_date").cast("date"))
    analytics.write_days(days, path)
    files = lambda: {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    again = days.where("stat_date = '2024-01-01' AND tier = 'a'").withColumn("messages", F.lit(10).cast("long"))
    for _ in range(2):  # as often as one likes
        analytics.write_days(again, path)
    after = files()
    assert {f: m for f, m in before.items() if "2024-01-01" not in f} == {f: m for f, m in after.items() if "2024-01-01" not in f}
    rows = sorted(tuple(x) for x in spark.read.schema(schema).parquet(path).select("stat_date", "tier", "messages").collect())
    assert [(str(d), tier, n) for d, tier, n in rows] == [("2024-01-01", "a", 10), ("2024-01-02", "a", 3), ("2024-01-03", "a", 4)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    assert analytics.pruned_days(spark, path, schema, "2024-01-02").count() == 2


def test_fulltext_list_by_hand(spark):
    import math

    terms = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "z")], "query_id long, pos int, term string")
    heads = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 4, 1)], "term string, chunk_id long, tf long")
    body = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 3, 2), ("c", 4, 2), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1), ("x", 1, 9)], "term string, chunk_id long, tf long")
    chunks = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "chunk_id long")
    got = {(x.query_id, x.chunk_id): x.score for x in r.fulltext(terms, [(heads, 2.0), (body, 1.0)], chunks, chunks.agg(F.count("*").alias("n"))).collect()}
    half = math.log10(2) ** 2
    want = {(1, 1): 5 * half, (1, 2): half + 2 * half, (1, 3): 2 * half}  # c is in all four: it weighs nothing
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())
