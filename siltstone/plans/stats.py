"""Analytics queries over the chat log, the call log and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import text as x
from ..operators import analytics as a
from ..scratch import new_folder
from .registry import query

_ROLL = """
roll AS (SELECT created_at::DATE AS stat_date, tier, count(DISTINCT conv_id) AS conversations, count(*) AS messages,
  count(*) FILTER (role = 'assistant' AND sources <> '[]') AS answered, count(*) FILTER (role = 'assistant' AND sources = '[]') AS unanswered,
  count(*) FILTER (role <> 'assistant') AS questions, coalesce(round(avg(confidence) FILTER (role = 'assistant'), 6), 0.0) AS avg_confidence,
  coalesce(round(avg(latency_ms), 6), 0.0) AS avg_latency,
  coalesce(list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[floor(0.95 * (count(latency_ms) - 1))::INT + 1], 0)::BIGINT AS p95_latency,
  coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out FROM messages GROUP BY 1, 2)"""
_CONVS = """
convs AS (SELECT conv_id, min(created_at) AS started_at, max(created_at) AS last_activity, count(*) AS n,
  coalesce(arg_max(tier, msg_id) FILTER (role = 'assistant' AND tier <> 'classic'), 'classic') AS tier, conv_id % 13 = 0 AS handoff FROM messages GROUP BY conv_id)"""
_QUESTIONS = r"""
qs AS (SELECT *, trim(lower(regexp_replace(text, '[\s\p{P}]+', ' ', 'g'))) AS norm FROM messages WHERE role = 'user'),
ded AS (SELECT sha1(norm) AS hash, count(*) AS hits, min(created_at) AS first_seen, max(created_at) AS last_seen,
  arg_max(substr(text, 1, 500), (created_at, msg_id)) AS sample, arg_min(intent, (created_at, msg_id)) AS intent FROM qs WHERE length(norm) >= 3 GROUP BY 1)"""


def _rollup(s, d):
    return a.daily_rollup(t.messages(s, d))


def _conversations(s, d):
    """One row per conversation; its tier is that of its last answer by a model."""
    model = (F.col("role") == "assistant") & (F.col("tier") != "classic")
    return t.messages(s, d).groupBy("conv_id").agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_activity"),
        F.count("*").alias("n"),
        F.coalesce(F.max_by(F.when(model, F.col("tier")), F.when(model, F.col("msg_id"))), F.lit("classic")).alias("tier"),
    ).withColumn("handoff", F.col("conv_id") % 13 == 0)


def _questions(s, d):
    return t.messages(s, d).where("role = 'user'").withColumn("hash", x.question_hash(F.col("text")))


@query("agg01_daily_rollup", t.with_("messages", body=f", {_ROLL} SELECT * EXCLUDE (p95_latency) FROM roll"))
def agg01(s, d):
    return _rollup(s, d).drop("p95_latency")


@query("agg02_p95_latency", t.with_("messages", body=f", {_ROLL} SELECT stat_date, tier, p95_latency FROM roll"))
def agg02(s, d):
    return _rollup(s, d).select("stat_date", "tier", "p95_latency")


@query("df10_rollup_written", t.with_("messages", body=f", {_ROLL} SELECT * FROM roll"))
def df10(s, d):
    """The rollup written by day: all days of a log that lacks some answers, then the days again from the whole log, half of them a run."""
    path, whole = new_folder(s, "rollup"), t.messages(s, d)
    a.write_days(a.daily_rollup(whole.where("msg_id % 3 <> 1")), path)
    days = whole.select(F.to_date("created_at").alias("day")).agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    middle = days.first + (days.last - days.first) / 2
    for part in (F.to_date("created_at") <= F.lit(middle), F.to_date("created_at") > F.lit(middle)):
        a.write_days(a.daily_rollup(whole.where(part)), path)
    rollup = _rollup(s, d)
    return s.read.schema(rollup.schema).parquet(path).select(rollup.columns)


@query("agg03_resolved", t.with_("messages", body=f", {_CONVS} SELECT last_activity::DATE AS stat_date, tier, count(*) AS resolved FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM messages WHERE role = 'assistant' AND sources = '[]') GROUP BY 1, 2"))
def agg03(s, d):
    return a.resolved_conversations(_conversations(s, d), t.messages(s, d).where("role = 'assistant' AND sources = '[]'"))


@query("agg04_intents", t.with_("messages", body="""SELECT created_at::DATE AS stat_date, intent, count(*) AS hits, count(*) FILTER (turn % 2 = 0) AS answered FROM messages WHERE intent IS NOT NULL GROUP BY 1, 2"""))
def agg04(s, d):
    return t.messages(s, d).where("intent IS NOT NULL").groupBy(F.to_date("created_at").alias("stat_date"), "intent").agg(
        F.count("*").alias("hits"), F.count_if(F.col("turn") % 2 == 0).alias("answered"))


@query("agg05_report_totals", t.with_("messages", body=f""", {_ROLL}, s AS (SELECT sum(conversations)::BIGINT AS conversations, sum(messages)::BIGINT AS messages, sum(answered)::BIGINT AS answered,
  sum(unanswered)::BIGINT AS unanswered, round(avg(avg_confidence), 6) AS mean_confidence, max(p95_latency) AS worst_p95, sum(tokens_out)::BIGINT AS tokens_out FROM roll)
SELECT *, least(1.0, round(answered / greatest(1, floor(messages / 2))::DOUBLE, 4)) AS kb_coverage, least(1.0, round(unanswered / greatest(1, floor(messages / 2))::DOUBLE, 4)) AS miss_rate FROM s"""))
def agg05(s, d):
    return a.report_totals(_rollup(s, d))


@query("agg05b_tier_totals", t.with_("messages", body=f", {_ROLL} SELECT tier, sum(messages)::BIGINT AS messages, round(avg(avg_latency), 6) AS mean_latency, max(p95_latency) AS worst_p95 FROM roll GROUP BY 1"))
def agg05b(s, d):
    return _rollup(s, d).groupBy("tier").agg(F.sum("messages").alias("messages"), F.round(F.avg("avg_latency"), 6).alias("mean_latency"), F.max("p95_latency").alias("worst_p95"))


@query("agg06_conversation_totals", t.with_("messages", body=f", {_CONVS} SELECT count(*) AS conversations, count(*) FILTER (handoff) AS handoffs, sum(n)::BIGINT AS messages, max(n) AS longest FROM convs WHERE last_activity >= TIMESTAMP '2024-01-02'"))
def agg06(s, d):
    since = F.lit("2024-01-02").cast("timestamp_ntz")
    return _conversations(s, d).where(F.col("last_activity") >= since).agg(
        F.count("*").alias("conversations"), F.count_if("handoff").alias("handoffs"), F.sum("n").alias("messages"), F.max("n").alias("longest"))


@query("agg07_daily_series", t.with_("messages", body=f", {_ROLL} SELECT stat_date, sum(messages)::BIGINT AS messages, sum(answered)::BIGINT AS answered FROM roll GROUP BY 1"))
def agg07(s, d):
    return _rollup(s, d).groupBy("stat_date").agg(F.sum("messages").alias("messages"), F.sum("answered").alias("answered"))


@query("agg15_provider_stats", t.with_("calls", body="SELECT provider, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, round(avg(latency_ms), 6) AS avg_latency, round(avg(nullif(latency_ms, 0)), 6) AS avg_latency_nonzero, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in FROM calls WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1"))
def agg15(s, d):
    return a.provider_stats(t.inference_log(s, d).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")))


@query("agg16_monthly_usage", t.with_("calls", body="SELECT provider, date_trunc('month', ts)::DATE AS month, count(*) AS calls, round(sum(tokens_in) * 0.5 / 1e6, 6) AS cost, sum(tokens_in) * 0.5 / 1e6 >= 0.02 AS capped FROM calls GROUP BY 1, 2"))
def agg16(s, d):
    cost = F.sum("tokens_in") * F.lit(0.5) / 1e6
    return t.inference_log(s, d).groupBy("provider", F.trunc("ts", "month").alias("month")).agg(
        F.count("*").alias("calls"), F.round(cost, 6).alias("cost"), (cost >= 0.02).alias("capped"))


@query("agg17_domain_quota", t.with_("calls", body="SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used, greatest(0, 60 - count(*)) AS remaining FROM calls GROUP BY 1, 2"))
def agg17(s, d):
    return t.inference_log(s, d).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("used"), F.greatest(F.lit(0), F.lit(60) - F.count("*")).alias("remaining"))


@query("agg18_moving_average")
def agg18(s, d):
    """EMA of latency per user (0.7 old + 0.3 new, rounded at each step)."""
    return a.moving_average(t.inference_log(s, d), "user_id", ["ts", "call_id"], "latency_ms")


@query("agg19_unanswered_questions", t.with_("messages", body=f", {_QUESTIONS} SELECT * FROM ded"))
def agg19(s, d):
    return a.deduplicated_questions(_questions(s, d))


@query("top06_unanswered_top", t.with_("messages", body=f", {_QUESTIONS} SELECT hash, hits, last_seen FROM ded ORDER BY hits DESC, last_seen DESC, hash LIMIT 100"))
def top06(s, d):
    return a.deduplicated_questions(_questions(s, d)).select("hash", "hits", "last_seen").orderBy(F.desc("hits"), F.desc("last_seen"), "hash").limit(100)


@query("agg20_recurring_errors", t.with_("calls", body=r""", m AS (SELECT *, (['Timeout after ' || call_id || ' s', 'File  /srv/x/' || call_id || ' is gone', 'Bad user ' || user_id])[call_id % 3 + 1] AS message FROM calls WHERE NOT ok),
f AS (SELECT *, sha1('RuntimeException|' || provider || '|-|' || left(lower(regexp_replace(regexp_replace(regexp_replace(message, '[0-9]+', 'N', 'g'), '/\S+', '/PATH', 'g'), '\s+', ' ', 'g')), 160)) AS fingerprint FROM m)
SELECT fingerprint, user_id % 5 AS grp, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, grp, fingerprint LIMIT 100"""))
def agg20(s, d):
    """Errors by fingerprint, three or more of them: messages that differ in numbers, paths and spaces alone are one."""
    call = F.col("call_id").cast("string")
    said = F.array(F.concat(F.lit("Timeout after "), call, F.lit(" s")), F.concat(F.lit("File  /srv/x/"), call, F.lit(" is gone")), F.concat(F.lit("Bad user "), F.col("user_id").cast("string")))
    message = F.element_at(said, (F.col("call_id") % 3 + 1).cast("int"))
    errors = t.inference_log(s, d).where("NOT ok").withColumn("fingerprint", x.error_fingerprint(F.lit("RuntimeException"), F.col("provider"), F.lit(None).cast("string"), message))
    found = errors.groupBy("fingerprint", (F.col("user_id") % 5).alias("grp")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return found.where("n >= 3").orderBy(F.desc("n"), "grp", "fingerprint").limit(100)


@query("agg21_telemetry", t.with_("calls", body="SELECT fp, n FROM (SELECT substr(sha1(provider || '-' || (user_id % 30)), 1, 12) AS fp, count(*) AS n, min(call_id) AS first FROM calls GROUP BY 1 ORDER BY first LIMIT 50)"))
def agg21(s, d):
    """Counts by short fingerprint; the 50 seen first."""
    fp = F.substring(F.sha1(F.concat_ws("-", "provider", (F.col("user_id") % 30).cast("string")).cast("binary")), 1, 12)
    return t.inference_log(s, d).groupBy(fp.alias("fp")).agg(F.count("*").alias("n"), F.min("call_id").alias("first")).orderBy("first").limit(50).select("fp", "n")


@query("agg22_conversations", t.with_("messages", body=f", {_CONVS} SELECT * FROM convs"))
def agg22(s, d):
    return _conversations(s, d)


@query("agg23_dsar_summary", t.with_("messages", body="SELECT session, count(DISTINCT conv_id) AS conversations, count(*) AS messages, min(created_at) AS first_at, max(created_at) AS last_at FROM messages GROUP BY 1"))
def agg23(s, d):
    return t.messages(s, d).groupBy("session").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("top05_top_intents", t.with_("messages", body="SELECT intent, count(*) AS hits FROM messages WHERE intent IS NOT NULL GROUP BY 1 ORDER BY hits DESC, intent LIMIT 50"))
def top05(s, d):
    return t.messages(s, d).where("intent IS NOT NULL").groupBy("intent").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "intent").limit(50)


@query("top07_conversation_page", t.with_("messages", body=f", {_CONVS} SELECT conv_id, last_activity, n, (SELECT count(*) FROM convs) AS total FROM convs ORDER BY last_activity DESC, conv_id LIMIT 20 OFFSET 20"))
def top07(s, d):
    convs = _conversations(s, d)
    total = convs.agg(F.count("*").alias("total"))
    page = convs.select("conv_id", "last_activity", "n").orderBy(F.desc("last_activity"), "conv_id").offset(20).limit(20)
    return page.join(F.broadcast(total), F.col("n") >= 0)


@query("top10_call_tail", t.with_("calls", body="SELECT call_id, ts, provider, ok FROM calls ORDER BY ts DESC, call_id DESC LIMIT 50"))
def top10(s, d):
    return t.inference_log(s, d).select("call_id", "ts", "provider", "ok").orderBy(F.desc("ts"), F.desc("call_id")).limit(50)


@query("win04_last_turns", t.with_("messages", body="SELECT conv_id, turn, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, msg_id DESC) AS rank FROM messages) WHERE rank <= 6"))
def win04(s, d):
    return a.top_rows(t.messages(s, d), ["conv_id"], [F.desc("turn"), F.desc("msg_id")], 6).select("conv_id", "turn", "role", "rank")


@query("win05_sessions", """
WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM e)
SELECT user_id, session_no::BIGINT AS session_no, count(*) AS events, min(ts)::TIMESTAMP AS started, max(ts)::TIMESTAMP AS ended FROM n GROUP BY 1, 2""")
def win05(s, d):
    e = a.sessions(t.load(s, d, "events"), "user_id", "ts")
    return e.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("ts").cast("timestamp_ntz").alias("started"), F.max("ts").cast("timestamp_ntz").alias("ended"))


@query("win06_rate_limit", """
WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS second FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY user_id, second) + row_number() OVER (PARTITION BY user_id, second ORDER BY event_id) AS in_window FROM e)
SELECT event_id, user_id, in_window, in_window <= 2 AS allowed FROM c""")
def win06(s, d):
    e = t.load(s, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"))
    return a.sliding_counts(e, "user_id", "second", 3600).select("event_id", "user_id", "in_window", (F.col("in_window") <= 2).alias("allowed"))


@query("win07_failure_streaks", t.with_("calls", body=""", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, call_id) AS pos FROM calls),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, call_id) AS island FROM m)
SELECT user_id, count(*) AS length, min(pos) AS first_pos, max(pos) AS last_pos FROM i WHERE NOT ok GROUP BY user_id, island HAVING count(*) >= 3"""))
def win07(s, d):
    return a.failure_streaks(t.inference_log(s, d), "user_id", ["ts", "call_id"])


@query("win08_failing_latest", t.with_("calls", body="SELECT user_id FROM (SELECT *, NOT ok OR latency_ms > 3 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, call_id DESC) AS r FROM calls) WHERE r <= 5 GROUP BY 1 HAVING count(*) FILTER (failed) = 5"))
def win08(s, d):
    """Users whose five latest calls all failed; a slow one counts as failed."""
    last = a.top_rows(t.inference_log(s, d), ["user_id"], [F.desc("ts"), F.desc("call_id")], 5)
    return last.groupBy("user_id").agg(F.count_if(~F.col("ok") | (F.col("latency_ms") > 3)).alias("f")).where("f = 5").select("user_id")


@query("win09_cadence", t.with_("kb", body="""SELECT source, count(*) AS n, max(r) AS ranked, date_diff('minute', min(indexed_at), max(indexed_at)) AS span_minutes FROM (
  SELECT source, indexed_at, row_number() OVER (PARTITION BY source ORDER BY indexed_at DESC, doc_id) AS r FROM kb) WHERE r <= 10 GROUP BY 1"""))
def win09(s, d):
    """The span of the ten newest documents of each source."""
    top = a.top_rows(t.kb_documents(s, d), ["source"], [F.desc("indexed_at"), F.col("doc_id")], 10)
    span = F.timestamp_diff("MINUTE", F.min("indexed_at"), F.max("indexed_at"))
    return top.groupBy("source").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("ranked"), span.alias("span_minutes"))


@query("win11_template_pick")
def win11(s, d):
    """A template per session and hour, the same on every rerun."""
    key = F.concat("session", F.date_format("created_at", "yyyyMMddHH"))
    return t.messages(s, d).select("msg_id", (F.crc32(key.cast("binary")) % 3).alias("pick"))


@query("stm12_strikes", t.with_("messages", body="SELECT msg_id, session, sum(CASE WHEN sources = '[]' AND role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY created_at, msg_id)::BIGINT AS strikes FROM messages"))
def stm12(s, d):
    w = Window.partitionBy("session").orderBy("created_at", "msg_id").rowsBetween(Window.unboundedPreceding, 0)
    out = ((F.col("sources") == "[]") & (F.col("role") == "assistant")).cast("long")
    return t.messages(s, d).select("msg_id", "session", F.sum(out).over(w).alias("strikes"))


@query("stm11_month_counters", t.with_("calls", body="SELECT user_id, date_trunc('month', ts)::DATE AS month, call_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, call_id) AS used FROM calls"))
def stm11(s, d):
    """A counter per user that starts anew with each month."""
    w = Window.partitionBy("user_id", "month").orderBy("ts", "call_id")
    return t.inference_log(s, d).withColumn("month", F.trunc("ts", "month")).select("user_id", "month", "call_id", F.row_number().over(w).cast("long").alias("used"))


@query("agg25_dashboard", t.with_("kb", body="SELECT count(*) AS documents, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'error') AS errors, max(indexed_at) AS last_indexed, count(DISTINCT source) AS sources FROM kb"))
def agg25(s, d):
    return t.kb_documents(s, d).agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "error").alias("errors"),
        F.max("indexed_at").alias("last_indexed"), F.countDistinct("source").alias("sources"))


@query("mth05_cost", t.with_("calls", body="SELECT call_id, round((tokens_in * 0.15 + 100 * 0.6) / 1e6, 6) AS cost, CASE WHEN latency_ms > 0 THEN round(tokens_in / (latency_ms / 1000), 2) END AS tokens_per_s FROM calls"))
def mth05(s, d):
    """Cost of a call in dollars and its tokens a second."""
    speed = F.try_divide(F.col("tokens_in").cast("double"), F.col("latency_ms") / 1000)
    return t.inference_log(s, d).select("call_id", F.round((F.col("tokens_in") * F.lit(0.15) + 60.0) / 1e6, 6).alias("cost"), F.when(F.col("latency_ms") > 0, F.round(speed, 2)).alias("tokens_per_s"))


@query("mth10_time_budget", t.with_("calls", body="SELECT call_id, greatest(6.0, 25.0 - 3.0 - round(latency_ms / 10, 3)) AS budget FROM calls"))
def mth10(s, d):
    return t.inference_log(s, d).select("call_id", F.greatest(F.lit(6.0), F.lit(22.0) - F.round(F.col("latency_ms") / 10, 3)).alias("budget"))


@query("dat01_ages", t.with_("kb", body="SELECT doc_id, date_diff('day', indexed_at::DATE, DATE '2024-03-01') AS age_days, strftime(indexed_at, '%Y-%m') AS month FROM kb"))
def dat01(s, d):
    as_of = F.lit("2024-03-01").cast("date")
    return t.kb_documents(s, d).select("doc_id", F.datediff(as_of, F.to_date("indexed_at")).cast("long").alias("age_days"), F.date_format("indexed_at", "yyyy-MM").alias("month"))
