"""What a site is and may use: its type, capability tiers, clean settings, ranked models, the model registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("blog", "business", "shop", "portfolio", "docs")
MB, GB = 1 << 20, 1 << 30

MANIFEST = "schema int, sequence int, providers map<string, struct<chat_models: array<struct<id: string, `default`: boolean, price_in: double, price_out: double>>>>"


def _points(*rules: tuple[Column, Column | float]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(cond, points).otherwise(0.0) for cond, points in rules))


def profiled(facts: DataFrame) -> DataFrame:
    """``facts`` with ``type``, ``confidence`` and a ``score_*`` per type.

    Facts are ``posts``, ``pages``, ``products`` (counts, null: 0), ``cadence``, ``woo``, ``elementor``, ``contact``, ``booking``, ``has_portfolio``,
    ``has_docs`` (null: false) and ``hint``. A top score of nothing, or one that another comes within 0.5 of, makes a site mixed. A hint
    that is a type wins.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    posts, pages, products, cadence = n("posts"), n("pages"), n("products"), F.coalesce("cadence", F.lit("none"))
    score = {
        "shop": F.when(products > 0, F.lit(2.0) + F.least(F.lit(2.0), products / 25)).when(is_("woo"), 0.5).otherwise(0.0),
        "blog": _points((posts > pages, 1.0), (posts >= 10, 0.5), (cadence == "active", 1.5), (cadence == "occasional", 0.75)),
        "business": _points((pages >= posts, 1.0), (pages >= 4, 0.25), (is_("contact"), 0.75), (is_("booking"), 0.75), (cadence.isin("dormant", "none"), 0.5)),
        "portfolio": _points((is_("has_portfolio"), 2.0), (is_("has_portfolio") & is_("elementor"), 0.25)),
        "docs": _points((is_("has_docs"), 2.0), (is_("has_docs") & (pages > F.greatest(posts, F.lit(1)) * 3), 0.5)),
    }
    scored = facts.select("*", *(score[k].alias(f"score_{k}") for k in TYPES))
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(f"score_{k}").alias("s"), F.lit(k).alias("type")) for k in TYPES))))
    scored = scored.withColumn("__r", ranked)
    top, second = F.col("__r")[0]["s"], F.col("__r")[1]["s"]
    share = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.5), top / (top + second + 0.75))), 2)
    contested = (second > 0) & (top - second < 0.5)
    kind = F.when((top <= 0) | contested, "mixed").otherwise(F.col("__r")[0]["type"])
    confidence = F.when(top <= 0, 0.35).when(contested, 0.45).otherwise(share)
    hinted = F.coalesce(F.col("hint").isin(*TYPES), F.lit(False))
    return scored.select(
        *facts.columns,
        F.when(hinted, F.col("hint")).otherwise(kind).alias("type"),
        F.when(hinted, F.greatest(confidence, F.lit(0.9))).otherwise(confidence).alias("confidence"),
        *(F.round(f"score_{k}", 2).alias(f"score_{k}") for k in TYPES),
    )


def tiers(probes: DataFrame) -> DataFrame:
    """``probes`` with ``t1b``, ``t2``, ``t3``, ``t5`` and ``best_free_tier``.

    Probes are ``memory`` and ``disk`` (bytes; unknown disk suffices), ``max_seconds`` (0: no limit; null: 30), ``extendable``, ``ffi``, ``proc_open``,
    ``curl``, ``cpu_score``, ``cpu_cores``; null flags are false.
    """
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    room = lambda b: F.col("disk").isNull() | (F.col("disk") >= b)
    seconds = n("max_seconds", 30)
    t1b = is_("ffi") & (n("memory", 0) >= 256 * MB) & room(400 * MB)
    t2 = t1b & (n("memory", 0) >= 512 * MB) & (n("cpu_score", 0) >= 40) & ((seconds == 0) | (seconds >= 60) | is_("extendable"))
    t3 = is_("proc_open") & (n("cpu_cores", 1) >= 2) & room(2 * GB)
    found = probes.select("*", t1b.alias("t1b"), t2.alias("t2"), t3.alias("t3"), is_("curl").alias("t5"))
    return found.withColumn("best_free_tier", F.when(F.col("t3"), "t3").when(F.col("t2"), "t2").when(F.col("t1b"), "t1b").otherwise("t1a"))


def clean_settings(values: DataFrame, schema: DataFrame) -> DataFrame:
    """``values`` (``key``, ``value`` string) that ``schema`` knows, as clean strings.

    ``schema`` (a bounded table of fields) has ``key``, ``type`` (bool, int, float, enum, string), ``low``, ``high``, ``choices``, ``maxlen``,
    ``fallback``. Unknown keys go. Numbers are held within bounds, others than numbers and unknown choices become the fallback.
    """
    v, number = F.col("value"), F.expr("try_cast(trim(value) AS double)")
    held = F.greatest(F.least(number, F.coalesce("high", number)), F.coalesce("low", number))
    whole = F.greatest(F.least(F.expr("try_cast(try_cast(trim(value) AS double) AS bigint)"), F.coalesce("high", F.lit(2.0**62)).cast("long")), F.coalesce("low", F.lit(-(2.0**62))).cast("long"))
    text = F.trim(F.regexp_replace(F.regexp_replace(v, "<[^>]*>", ""), r"\s+", " "))
    cut = F.when(F.col("maxlen").isNull(), text).otherwise(F.substring(text, F.lit(1), F.col("maxlen")))
    clean = (
        F.when(F.col("type") == "bool", F.when(F.lower(v).isin("", "0", "false"), "false").otherwise("true"))
        .when(F.col("type") == "int", F.coalesce(F.when(number.isNotNull(), whole).cast("string"), "fallback"))
        .when(F.col("type") == "float", F.coalesce(F.format_string("%.4f", F.round(held, 4)), "fallback"))
        .when(F.col("type") == "enum", F.when(F.array_contains("choices", v), v).otherwise(F.col("fallback")))
        .otherwise(F.coalesce(cut, "fallback"))
    )
    clean = F.when((F.col("type") == "float") & number.isNull(), F.col("fallback")).otherwise(clean)
    return values.join(F.broadcast(schema), "key").withColumn("clean", clean).select(*values.columns, "clean")


def model_scores(models: DataFrame, preferred: list[str]) -> DataFrame:
    """``models`` (``model``, ``context_length``) with ``score``: the first preference in the name, context, chat models before special ones."""
    name = F.lower(F.coalesce("model", F.lit("")))
    liked = F.when(F.lit(False), 0)
    for i, p in enumerate(preferred):
        liked = liked.when(F.contains(name, F.lit(p.lower())), (len(preferred) - i) * 100)
    context = F.least(F.lit(50), F.floor(F.coalesce("context_length", F.lit(0)) / 8000 + 0.5).cast("int"))
    chat = F.when(F.contains(name, F.lit("instruct")) | F.contains(name, F.lit("chat")), 10).otherwise(0)
    special = F.when(F.contains(name, F.lit("vision")) | F.contains(name, F.lit("coder")), 15).otherwise(0)
    return models.withColumn("score", F.coalesce(liked, F.lit(0)) + context + chat - special)


def registry_models(manifests: DataFrame) -> DataFrame:
    """``sequence``, ``provider``, ``model``, ``is_default``, ``price_in``, ``price_out`` of the manifest in force.

    ``manifests`` has ``arrived``, ``verified``, ``payload`` (JSON): few rows, one per sync. Those that are not verified, malformed, of another
    schema or older than one accepted before are refused, so the highest sequence is in force, the later arrival of equal ones. A
    provider's first model is its default where none is marked.
    """
    read = manifests.where("verified").withColumn("m", F.from_json("payload", MANIFEST))
    valid = read.where((F.col("m.schema") == 1) & F.col("m.providers").isNotNull())
    force = valid.agg(F.max_by("m", F.struct(F.coalesce("m.sequence", F.lit(0)), "arrived")).alias("m")).where("m IS NOT NULL")
    each = force.select(F.coalesce("m.sequence", F.lit(0)).alias("sequence"), F.explode("m.providers").alias("provider", "p"))
    marked = F.array_position(F.transform("p.chat_models", lambda x: F.coalesce(x["default"], F.lit(False))), True)
    rows = each.select("sequence", "provider", F.greatest(marked, F.lit(1)).alias("first"), F.posexplode("p.chat_models").alias("at", "x"))
    return rows.select("sequence", "provider", F.col("x.id").alias("model"), (F.col("at") + 1 == F.col("first")).alias("is_default"), "x.price_in", "x.price_out")
