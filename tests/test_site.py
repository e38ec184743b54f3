"""Intents, site types, settings, registries and logs on small hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import intents
from siltstone.functions import text as x
from siltstone.operators import site
from siltstone.streaming import state as st


def test_intents_in_order(spark):
    said = [
        ("Where can I find the pricing page?", "navigation_find_page", 0.9), ("hi, how much is it?", "price_stock", 0.9), ("Hello there!", "greeting", 0.9),
        ("Can I speak to a human about refunds", "handoff", 0.9), ("", "product_query", 0.7), (None, "product_query", 0.7), ("épréso", "product_query", 0.7),
    ]
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(said)], "i int, text string")
    found = rows.select("i", intents.intent(F.col("text"), F.lit(True), F.lit(None).cast("boolean")).alias("r")).orderBy("i").collect()
    assert [(r.r.intent, r.r.confidence) for r in found] == [(s[1], s[2]) for s in said]
    other = rows.where("i = 4").select(intents.intent(F.col("text"), F.lit(None).cast("boolean"), F.lit(True)).alias("r")).first()
    assert (other.r.intent, other.r.confidence) == ("site_info", 0.7)


def test_site_types(spark):
    schema = "posts int, pages int, products int, cadence string, woo boolean, elementor boolean, contact boolean, booking boolean, has_portfolio boolean, has_docs boolean, hint string"
    rows = [
        (12, 3, 0, "active", None, None, None, None, None, None, None),  # 3.0 for a blog, nothing else
        (2, 5, 0, "none", None, None, True, None, None, True, "auto"),  # business 2.5, docs 2.0: contested by exactly 0.5, so not mixed
        (None,) * 11,  # as many pages as posts and no cadence: business
        (2, 5, 0, "none", None, None, True, None, None, True, "shop"),
        (2, 5, 0, "dormant", None, None, None, None, None, True, None),  # business 1.75, docs 2.0
    ]
    found = [(r.type, r.confidence) for r in site.profiled(spark.createDataFrame(rows, schema)).collect()]
    assert found == [("blog", 0.8), ("business", 0.5), ("business", 0.67), ("shop", 0.9), ("mixed", 0.45)]
    assert site.profiled(spark.createDataFrame([], schema)).count() == 0


def test_settings(spark):
    schema = spark.createDataFrame(
        [("n", "int", 1.0, 9.0, None, None, "5"), ("e", "enum", None, None, ["a"], None, "a"), ("s", "string", None, None, None, 3, "d"), ("b", "bool", None, None, None, None, None)],
        "key string, type string, low double, high double, choices array<string>, maxlen int, fallback string",
    )
    rows = [("n", "12"), ("n", "x"), ("n", None), ("n", "3.9"), ("e", "b"), ("e", None), ("s", " <i>ab</i>  c"), ("s", None), ("b", "FALSE"), ("b", "off"), ("z", "1"), (None, "1")]
    found = site.clean_settings(spark.createDataFrame(rows, "key string, value string"), schema).collect()
    assert sorted((r.key, str(r.value), r.clean) for r in found) == sorted([
        ("n", "12", "9"), ("n", "x", "5"), ("n", "None", "5"), ("n", "3.9", "3"), ("e", "b", "a"), ("e", "None", "a"), ("s", " <i>ab</i>  c", "ab "), ("s", "None", "d"), ("b", "FALSE", "false"), ("b", "off", "true"),
    ])


def test_registry_refuses_and_defaults(spark):
    good = '{"schema": 1, "sequence": %d, "providers": {"p": {"chat_models": [{"id": "a%d"}, {"id": "b", "default": true, "price_in": 1.5}]}, "q": {"chat_models": [{"id": "c"}]}}}'
    rows = [(1, True, good % (3, 3)), (2, True, good % (2, 2)), (3, False, good % (9, 9)), (4, True, "no json"), (5, True, '{"schema": 2, "sequence": 8, "providers": {}}'), (6, True, None), (7, None, good % (7, 7))]
    found = site.registry_models(spark.createDataFrame(rows, "arrived int, verified boolean, payload string")).collect()
    assert sorted((r.sequence, r.provider, r.model, r.is_default) for r in found) == [(3, "p", "a3", False), (3, "p", "b", True), (3, "q", "c", True)]
    assert site.registry_models(spark.createDataFrame([], "arrived int, verified boolean, payload string")).count() == 0


def test_tiers_of_unknown_hosts(spark):
    schema = "memory long, disk long, max_seconds int, extendable boolean, ffi boolean, proc_open boolean, curl boolean, cpu_score int, cpu_cores int"
    rows = [(None,) * 9, (512 * site.MB, None, 0, None, True, None, True, 40, None), (512 * site.MB, None, None, None, True, None, None, 40, None)]
    assert [r.best_free_tier for r in site.tiers(spark.createDataFrame(rows, schema)).collect()] == ["t1a", "t2", "t1b"]


def test_flat_facts_and_logs(spark):
    rows = spark.createDataFrame([('{"a": {"b": true, "c": ["x", ""]}, "d": 1, "e": null}',), (None,), ("no json",), ("3",)], "j string")
    assert [r[0] for r in rows.select(x.flat_facts(F.col("j"))).collect()] == ["a b: yes\na c 0: x\nd: 1", None, "", ""]
    log = st.appended([rows, rows.limit(0), rows])
    assert log.count() == 8
