"""A read-through cache of answers: looked up by what was asked of which version of the base, stored where it misses, with a counter of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state as st

#: Seconds that an answer is kept.
TTL = 86_400.0
CACHE = "key string, stored double, created double, hits long"


def cache_key(provider: Column, model: Column, prompt_version: Column, base_version: Column, lang: Column, question: Column, facts_hash: Column) -> Column:
    """SHA-1 of all that an answer depends on; questions that differ in case and white space are one. Null parts are empty, the version 0."""
    asked = F.lower(F.trim(F.regexp_replace(question, r"(?U)\s+", " ")))
    parts = [provider, model, prompt_version, F.coalesce(base_version, F.lit(0)).cast("string"), lang, asked, facts_hash]
    return F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"))


def as_of(rows: DataFrame, versions: DataFrame, second: str = "second", bucket_s: int = 86_400) -> DataFrame:
    """``rows`` with ``base_version``: the greatest ``version`` whose ``since`` is not after ``second``; 0 before the first.

    Versions only grow. Both sides are dealt by day; a day's rows look back within the day, and before its first version the greatest of all earlier days counts. So
    one task holds a day of rows and one a row for each day, whatever the number of either.
    """
    day = lambda c: F.floor(F.col(c) / bucket_s).alias("__day")
    changed = versions.select(F.col("version").cast("long").alias("__version"), F.col("since").cast("double").alias("__at"), day("since"))
    ends = changed.groupBy("__day").agg(F.max("__version").alias("__end"))
    # what holds at the start of a day on which something changed, and at that of all other days
    days = rows.select(day(second)).distinct().join(ends, "__day", "full")
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("__day", F.coalesce(F.max("__end").over(before), F.lit(0)).alias("__start"))
    marked = rows.withColumns({"__day": F.floor(F.col(second) / bucket_s), "__at": F.col(second).cast("double"), "__version": F.lit(None).cast("long"), "__asks": F.lit(1)})
    both = marked.unionByName(changed.withColumn("__asks", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy("__day").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__seen", F.max("__version").over(within)).where("__asks = 1").join(starts, "__day")
    return found.withColumn("base_version", F.coalesce("__seen", "__start")).select(*rows.columns, "base_version")


def look_up(lookups: DataFrame, cache: DataFrame | None = None, ttl: float = TTL) -> DataFrame:
    """``lookups`` (``key``, ``second``, ``event_id``) with ``hit``: whether the cache has an answer that has not expired.

    A miss stores an answer at once, for ``ttl`` seconds; a hit renews nothing. Lookups are taken in order of (second, event_id), after all that ``cache`` holds.
    """
    rows = lookups.select("key", F.col("second").cast("double").alias("second"), F.col("event_id").cast("long").alias("event_id"))
    if cache is not None:
        # what is stored already stands before the lookups, as the miss that stored it
        rows = rows.unionByName(cache.select("key", F.col("stored").alias("second"), F.lit(-1).cast("long").alias("event_id")))
    return st.limited(rows, ttl, 1).where("event_id >= 0").select("key", "second", "event_id", (~F.col("allowed")).alias("hit"))


def written_back(found: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The cache after ``found`` (of ``look_up``): ``key``, ``stored`` (the last store), ``created`` (the first), ``hits`` (all of them)."""
    miss = F.when(~F.col("hit"), F.col("second"))
    new = found.groupBy("key").agg(F.max(miss).alias("stored"), F.min(miss).alias("created"), F.count_if("hit").alias("hits"))
    if cache is not None:
        both = new.unionByName(cache.select("key", "stored", "created", "hits"))
        new = both.groupBy("key").agg(F.max("stored").alias("stored"), F.min("created").alias("created"), F.sum("hits").alias("hits"))
    return new.select("key", "stored", "created", F.col("hits").cast("long").alias("hits"))


def swept(cache: DataFrame, now: float, ttl: float = TTL) -> DataFrame:
    """The cache without what has expired before ``now``."""
    return cache.where(F.col("stored") + ttl >= now)
