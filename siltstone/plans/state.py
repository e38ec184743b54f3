"""Stateful queries: batch folds, and the streams that do the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as t
from ..scratch import new_folder, saver
from ..streaming import cache, processors
from ..streaming import state as st
from ..streaming.merge import MergedTable
from .registry import query


# Errors of calls: what the provider says, for those events that failed.
_ERRORS = ("timeout: no answer", "auth: bad key", "rate_limit: slow down", "refusal: cannot say", "server", "empty: nothing said", "timeout: no answer")
_ERRORS_SQL = "[" + ", ".join(f"'{e}'" for e in _ERRORS) + "]"


def _events(s, d):
    failed = F.col("event_type").isin("error", "view")
    error = F.when(failed, F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int")))
    return t.load(s, d, "events").select(
        F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("second"), "event_id", (~failed).alias("ok"), error.alias("error"),
        "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
    )


def _in_batches(s, d, rows, batches=4):
    """Events as a stream of several batches, a stretch of time each."""
    n = t.load(s, d, "events").agg(F.max("event_id").alias("n")).first().n or 0
    return st.as_stream(rows, F.floor(F.col("event_id") * batches / (n + 1)), batches)


def _run(s, stream):
    with processors.with_rocksdb(s):
        return st.run_available(stream)


@query("stm03_limiter")
def stm03(s, d):
    """Two accepted events a user and day; refused ones do not count."""
    return st.limited(_events(s, d).select("key", "second", "event_id"), 86400.0, 2)


@query("stm03s_limiter_stream")
def stm03s(s, d):
    """The same on a stream of four batches."""
    return _run(s, processors.limited_stream(_in_batches(s, d, _events(s, d).select("key", "ts", "second", "event_id")), 86400.0, 2))


@query("stm04_session_stream")
def stm04(s, d):
    """All sessions of the events, those still open at their end too."""
    stream = s.readStream.schema(t.load(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return st.run_available(st.session_stream(rows), "complete")


def _first_in(rows: str, seconds: int) -> str:
    """SQL: ``acc`` (key, second), the seconds at which a key is taken anew, ``seconds`` after the last time at the earliest."""
    return f"""WITH RECURSIVE e AS ({rows}),
acc AS (SELECT key, min(second) AS second FROM e GROUP BY 1
  UNION ALL SELECT a.key, min(e.second) FROM acc a JOIN e ON e.key = a.key AND e.second >= a.second + {seconds} GROUP BY a.key, a.second),
firsts AS (SELECT e.key, e.second, min(event_id) AS event_id FROM e JOIN acc USING (key, second) GROUP BY 1, 2)"""


_BREAKER = f"""
WITH RECURSIVE e AS (SELECT user_id % 4 AS key, event_id, epoch(date_trunc('second', ts))::DOUBLE AS s, event_type NOT IN ('error', 'view') AS ok,
    CASE WHEN event_type IN ('error', 'view') THEN split_part({_ERRORS_SQL}[event_id % {len(_ERRORS)} + 1], ':', 1) END AS code,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY date_trunc('second', ts), event_id) AS n FROM events),
r AS (SELECT DISTINCT key, 0::BIGINT AS n, -1::BIGINT AS event_id, true AS let_through, 0 AS fails, 0.0::DOUBLE AS until, 0.0::DOUBLE AS expires FROM e
  UNION ALL
  SELECT key, n, event_id, through, CASE WHEN NOT through THEN f WHEN ok THEN 0 WHEN content THEN f ELSE f + 1 END,
    CASE WHEN NOT through THEN u WHEN ok THEN 0.0 WHEN content THEN u WHEN code = 'auth' THEN s + 900 WHEN code = 'rate_limit' THEN s + 60 WHEN f + 1 >= 3 THEN s + 900 ELSE 0.0 END,
    CASE WHEN NOT through THEN x WHEN ok THEN 0.0 WHEN content THEN x ELSE s + 900 END
  FROM (SELECT *, s >= u AS through, code IN ('refusal', 'empty', 'aborted', 'parse', 'no_key', 'no_model') AS content
    FROM (SELECT e.*, CASE WHEN e.s >= r.expires THEN 0 ELSE r.fails END AS f, CASE WHEN e.s >= r.expires THEN 0.0 ELSE r.until END AS u,
        CASE WHEN e.s >= r.expires THEN 0.0 ELSE r.expires END AS x
      FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, event_id, let_through FROM r WHERE n > 0"""


def _calls(s, d):
    """Calls of four providers."""
    return _events(s, d).withColumn("key", F.col("key") % 4).select("key", "second", "event_id", "ok", "error", "ts")


@query("stm05_circuit_breaker", _BREAKER)
def stm05(s, d):
    """Which calls a circuit breaker lets through; failures are forgotten after 15 minutes, errors of content never count."""
    return st.circuit(_calls(s, d).drop("ts")).select("key", "event_id", "let_through")


@query("stm05s_breaker_stream", _BREAKER)
def stm05s(s, d):
    """The same on a stream of four batches, state and timers in the state store."""
    return _run(s, processors.circuit_stream(_in_batches(s, d, _calls(s, d))))


@query("stm06_average_stream")
def stm06(s, d):
    """Moving average of latency by kind of event, on a stream of four batches: what it was after each call."""
    values = _events(s, d).select(F.col("event_type").alias("key"), "second", "event_id", "value")
    return _run(s, processors.average_stream(_in_batches(s, d, values)))


_CHANGES = "SELECT event_id, event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS second FROM events WHERE event_id % 3 <> 0"
_DELETES = "SELECT event_type AS key, event_id, 'delete' AS action, epoch(date_trunc('second', ts))::DOUBLE AS due FROM events WHERE event_id % 3 = 0"


def _changes(s, d):
    action = F.when(F.col("event_id") % 3 == 0, "delete").otherwise("upsert")
    return _events(s, d).select(F.col("event_type").alias("key"), "second", "event_id", action.alias("action"), "ts")


@query("stm01_debounce", _first_in(_CHANGES, st.DEBOUNCE) + f" SELECT key, event_id, 'upsert' AS action, (second + {st.DEBOUNCE})::DOUBLE AS due FROM firsts UNION ALL {_DELETES}")
def stm01(s, d):
    """Upserts of an item wait 30 seconds for others, deletes go at once."""
    return st.debounced(_changes(s, d).drop("ts"))


@query("stm01s_debounce_stream", _first_in(_CHANGES, st.DEBOUNCE) + f""", seen AS (SELECT max(ts) - INTERVAL 1 MINUTE AS upto FROM events)
SELECT key, event_id, 'upsert' AS action, (second + {st.DEBOUNCE})::DOUBLE AS due FROM firsts f, seen
WHERE make_timestamp((second + {st.DEBOUNCE}) * 1000000) <= upto OR EXISTS (SELECT 1 FROM events e WHERE e.event_type = f.key AND epoch(date_trunc('second', ts)) >= f.second + {st.DEBOUNCE})
UNION ALL {_DELETES}""")
def stm01s(s, d):
    """The same on a stream of four batches: what is due comes out by timers; what waits when the stream ends stays in its state."""
    return _run(s, processors.debounced_stream(_in_batches(s, d, _changes(s, d))))


@query("src16b_changes_applied", """
SELECT user_id AS item, max(event_id) AS event_id, max_by(value, event_id) AS value, count(*) AS changes FROM events GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'""")
def src16b(s, d):
    """A stream of changes in four batches merged into a table of items; deleted ones are tombstones."""
    columns = t.load(s, d, "events").select(F.col("user_id").alias("item"), "event_id", "value")
    changes = t.load(s, d, "events").select(F.col("user_id").alias("item"), "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"))
    table = MergedTable(s, new_folder(s, "items"), columns.schema, "item", "event_id")
    table.follow(_in_batches(s, d, changes), new_folder(s, "checkpoint"))
    return table.rows()


@query("stm14_growing_answers")
def stm14(s, d):
    """Answers that arrive in pieces of 40 characters, checked against the question as they grow: what may be shown of them."""
    m = t.messages(s, d)
    asked = m.where("role = 'user'").groupBy("conv_id").agg(F.concat_ws(" ", F.max_by("text", "turn"), F.count("*").cast("string")).alias("facts"))
    said = F.concat("text", F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit(" It costs $"), F.col("turn").cast("string"), F.lit(".50 now."))).otherwise(""))
    answers = m.where("role = 'assistant'").select("msg_id", "conv_id", said.alias("said")).join(asked, "conv_id", "left")
    pieces = F.posexplode(F.filter(F.split("said", r"(?<=\G(?s:.{40}))"), lambda x: x != "")).alias("position", "delta")
    deltas = answers.select(F.col("msg_id").alias("answer_id"), F.coalesce("facts", F.lit("")).alias("facts"), pieces).withColumn("position", F.col("position").cast("long"))
    return _run(s, processors.checked_answers(st.as_stream(deltas, F.floor(F.least(F.col("position"), F.lit(11)) / 4), 3)))


@query("stm02_limiter_logged", """
WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
SELECT a.event_id, count(*) AS attempts, count(*) <= 3 AS allowed FROM e a JOIN e b ON a.user_id = b.user_id AND b.s > a.s - 86400 AND (b.s < a.s OR (b.s = a.s AND b.event_id <= a.event_id)) GROUP BY 1""")
def stm02(s, d):
    """Attempts count even when they are refused."""
    from ..operators.analytics import sliding_counts

    rows = t.load(s, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"))
    return sliding_counts(rows, "user_id", "second", 86400).select("event_id", F.col("in_window").alias("attempts"), (F.col("in_window") <= 3).alias("allowed"))


_MESSAGES = "SELECT event_id, user_id || ':' || event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS second FROM events"


_REPLAYS = _first_in(_MESSAGES, 60) + " SELECT e.event_id, f.event_id IS NULL AS replayed FROM e LEFT JOIN firsts f USING (event_id)"


def _messages(s, d):
    return _events(s, d).withColumn("key", F.concat_ws(":", F.col("key").cast("string"), "event_type")).select("key", "ts", "second", "event_id")


@query("stm08_replays", _REPLAYS)
def stm08(s, d):
    """A message id that comes again within 60 seconds of the time it was answered gets that answer."""
    return st.limited(_messages(s, d).drop("ts"), 60.0, 1).select("event_id", (~F.col("allowed")).alias("replayed"))


@query("stm08s_replay_stream", _REPLAYS)
def stm08s(s, d):
    """The same on a stream of four batches."""
    found = _run(s, processors.limited_stream(_in_batches(s, d, _messages(s, d)), 60.0, 1))
    return found.select("event_id", (~F.col("allowed")).alias("replayed"))


# the base has a new version with every 20th conversation
_VERSIONED = """
v AS (SELECT epoch(TIMESTAMP '2024-01-01' + to_minutes((conv_id * 97)::BIGINT))::DOUBLE AS since, row_number() OVER (ORDER BY conv_id) AS version FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 20 = 0)),
q AS (SELECT event_id, event_type, (props->>'$.k') AS k, epoch(date_trunc('second', ts))::BIGINT AS second FROM events),
e AS (SELECT event_id, sha1(event_type || '|m1|v' || event_id % 2 || '|' || coalesce(version, 0) || '|en|what is ' || k || '?|' ) AS key, second
  FROM q ASOF LEFT JOIN v ON q.second >= v.since),
acc AS (SELECT key, min(second) AS second FROM e GROUP BY 1
  UNION ALL SELECT a.key, min(e.second) FROM acc a JOIN e ON e.key = a.key AND e.second >= a.second + 86400 GROUP BY a.key, a.second),
firsts AS (SELECT e.key, e.second, min(event_id) AS event_id FROM e JOIN acc USING (key, second) GROUP BY 1, 2)"""


def _lookups(s, d):
    """Questions put to providers, with the version of the base that they were put to."""
    said = t.load(s, d, "conversations").where("conv_id % 20 = 0").select("conv_id").distinct()
    since = F.unix_timestamp(F.lit(t.EPOCH).cast("timestamp")) + F.col("conv_id") * 97 * 60
    versions = said.select(F.row_number().over(Window.orderBy("conv_id")).alias("version"), since.alias("since"))
    asked = F.concat(F.lit(" What  IS "), F.get_json_object("props", "$.k"), F.lit("? "))
    rows = t.load(s, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), "event_id", "event_type", asked.alias("asked"))
    prompt = F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string"))
    key = cache.cache_key(F.col("event_type"), F.lit("m1"), prompt, F.col("base_version"), F.lit("en"), F.col("asked"), F.lit(None).cast("string"))
    return cache.as_of(rows, versions).select(key.alias("key"), "second", "event_id")


@query("stm09_response_cache", f"WITH RECURSIVE {_VERSIONED} SELECT e.event_id AS call_id, e.key, f.event_id IS NULL AS hit FROM e LEFT JOIN firsts f USING (event_id)")
def stm09(s, d):
    """A lookup hits within a day of the store; a miss stores anew, a hit renews nothing. A new version of the base misses."""
    return cache.look_up(_lookups(s, d)).select(F.col("event_id").alias("call_id"), "key", "hit")


@query("df16_cache_written", f"""
WITH RECURSIVE {_VERSIONED}, x AS (SELECT e.*, f.event_id IS NOT NULL AS miss FROM e LEFT JOIN firsts f USING (event_id))
SELECT key, max(second) FILTER (miss)::DOUBLE AS stored, min(second) FILTER (miss)::DOUBLE AS created, count(*) FILTER (NOT miss) AS hits FROM x GROUP BY 1""")
def df16(s, d):
    """The cache after two loads of lookups, the second served from what the first one wrote: stores and counters of hits."""
    save = saver(s, "cache")
    lookups = save(_lookups(s, d))
    half = F.lit("2024-01-15").cast("timestamp").cast("long")
    first = save(cache.written_back(cache.look_up(lookups.where(F.col("second") < half))))
    return cache.written_back(cache.look_up(lookups.where(F.col("second") >= half), first), first)


@query("stm10_memory", t.with_("calls", body=", m AS (SELECT user_id % 50 AS key, arg_max(latency_ms, (ts, call_id)) AS value, count(*) AS hits, max(ts) AS updated_at FROM calls GROUP BY 1) SELECT key, value, hits, greatest(0, 90 - 5 * (date_diff('day', updated_at::DATE, DATE '2024-03-01') // 7)) AS importance FROM m WHERE greatest(0, 90 - 5 * (date_diff('day', updated_at::DATE, DATE '2024-03-01') // 7)) > 0"))
def stm10(s, d):
    """Last write wins per key; importance decays by five a week, gone at zero."""
    m = t.inference_log(s, d).groupBy((F.col("user_id") % 50).alias("key")).agg(F.max_by("latency_ms", F.struct("ts", "call_id")).alias("value"), F.count("*").alias("hits"), F.max("ts").alias("updated_at"))
    weeks = F.floor(F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("updated_at")) / 7)
    return m.select("key", "value", "hits", F.greatest(F.lit(0), F.lit(90) - weeks * 5).alias("importance")).where("importance > 0")


@query("flt05_unexpired", t.with_("calls", body="SELECT call_id FROM calls WHERE call_id % 3 = 0 OR ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31'"))
def flt05(s, d):
    expires = F.when(F.col("call_id") % 3 != 0, F.col("ts") + F.make_dt_interval(days=F.lit(10)))
    return t.inference_log(s, d).withColumn("expires_at", expires).where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2024-01-31").cast("timestamp_ntz"))).select("call_id")


@query("top08_memory_top", t.with_("calls", body="SELECT user_id, count(*) AS importance, max(ts) AS updated_at FROM calls GROUP BY 1 ORDER BY importance DESC, updated_at DESC, user_id LIMIT 50"))
def top08(s, d):
    return t.inference_log(s, d).groupBy("user_id").agg(F.count("*").alias("importance"), F.max("ts").alias("updated_at")).orderBy(F.desc("importance"), F.desc("updated_at"), "user_id").limit(50)


@query("df13_learning_loop", t.with_("calls", body="SELECT user_id, count(*) AS n, least(90, 40 + 10 * count(*)) AS importance, CASE WHEN count(*) >= 5 THEN 'skip' ELSE 'note' END AS lesson FROM calls WHERE NOT ok GROUP BY 1 HAVING count(*) >= 3"))
def df13(s, d):
    n = F.count("*")
    return t.inference_log(s, d).where("NOT ok").groupBy("user_id").agg(n.alias("n"), F.least(F.lit(90), 40 + 10 * n).alias("importance"), F.when(n >= 5, "skip").otherwise("note").alias("lesson")).where("n >= 3")


@query("df19_provider_chain", _BREAKER.replace("SELECT key, event_id, let_through FROM r WHERE n > 0", """
, last AS (SELECT key, max_by(let_through, n) AS closed, max(n) AS calls FROM r WHERE n > 0 GROUP BY 1), p AS (SELECT user_id % 4 AS key, sum((props->>'$.k')::BIGINT) AS tokens FROM events GROUP BY 1)
SELECT key, tokens, row_number() OVER (ORDER BY tokens, key) AS position FROM last JOIN p USING (key) WHERE closed AND tokens < 1000000000"""))
def df19(s, d):
    """Providers whose circuit let the last call through and that are under their cap of tokens, the cheapest first: the order to try them in."""
    order = F.struct("second", "event_id")
    last = st.circuit(_calls(s, d).drop("ts")).groupBy("key").agg(F.max_by("let_through", order).alias("closed"))
    used = t.inference_log(s, d).groupBy((F.col("user_id") % 4).alias("key")).agg(F.sum("tokens_in").alias("tokens"))
    chain = last.join(used, "key").where(F.col("closed") & (F.col("tokens") < 1_000_000_000))
    return chain.select("key", "tokens", F.row_number().over(Window.orderBy("tokens", "key")).cast("long").alias("position"))  # a row a provider
