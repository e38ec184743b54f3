"""Folds and streams against plain loops: null keys, errors that do not count, timers, replayed batches."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.redaction import check_facts
from siltstone.operators import analytics as a
from siltstone.streaming import processors
from siltstone.streaming import state as st
from siltstone.streaming.merge import MergedTable

CODES = ["timeout: x", "auth: no", "rate_limit", "refusal: never", "empty", "aborted: by user", "parse", "no_key", "no_model", "server", None]


def calls(seed, n=400, keys=(None, 1, 2, 9_007_199_254_740_993)):
    rng = random.Random(seed)
    second, rows = 0.0, []
    for i in range(n):
        second += rng.choice([0, 1, 30, 100, 600, 2000])
        ok = rng.choice([True, False, False, False, None])
        rows.append((rng.choice(keys), second, i, ok, None if ok else rng.choice(CODES)))
    return rows


def brute_breaker(rows):
    state, out = {}, {}
    for key, now, i, ok, error in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.get(key)
        if s and now >= s["gone"]:
            s = state.pop(key) and None
        if s and now < s["until"]:
            out[i] = False
            continue
        out[i] = True
        code = (error or "").split(":")[0]
        if ok:
            state.pop(key, None)
        elif code not in ("refusal", "empty", "aborted", "parse", "no_key", "no_model"):
            fails = (s["fails"] if s else 0) + 1
            until = now + 900 if code == "auth" or (fails >= 3 and code != "rate_limit") else now + 60 if code == "rate_limit" else 0
            state[key] = {"fails": fails, "until": until, "gone": now + 900}
    return out


CALLS = "key long, second double, event_id long, ok boolean, error string"


def streamed(spark, rows, schema, batches, make):
    """``rows`` in batches of equal numbers by time, each shuffled."""
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second"))
    nth = {r[2]: i * batches // len(rows) for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    places = spark.createDataFrame(list(nth.items()), "event_id long, batch int")
    stream = st.as_stream(df.join(places, "event_id").orderBy(F.rand(1)), F.col("batch"), batches)
    with processors.with_rocksdb(spark):
        return st.run_available(make(stream)).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_breaker_and_its_stream(spark, seed):
    rows = calls(seed)
    want = brute_breaker(rows)
    assert 20 < sum(not x for x in want.values()) < 350
    assert {r.event_id: r.let_through for r in st.circuit(spark.createDataFrame(rows, CALLS).repartition(5)).collect()} == want
    known = [r for r in rows if r[0] is not None]
    got = streamed(spark, known, CALLS, 3, processors.circuit_stream)
    assert {r.event_id: r.let_through for r in got} == {r[2]: want[r[2]] for r in known}


def test_failures_are_forgotten_after_a_quarter_of_an_hour(spark):
    rows = [(1, s, i, False, "timeout") for i, s in enumerate([0.0, 1.0, 4000.0, 4001.0, 4002.0, 4003.0])]
    assert {r.event_id: r.let_through for r in st.circuit(spark.createDataFrame(rows, CALLS)).collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}


@pytest.mark.parametrize("limit,window", [(1, 60.0), (2, 10.0), (3, 500.0)])
def test_limiter_with_null_keys_and_its_stream(spark, limit, window):
    rows = [r[:3] for r in calls(limit)]
    held, want = defaultdict(list), {}
    for key, now, i in sorted(rows, key=lambda r: (r[1], r[2])):
        held[key] = [x for x in held[key] if now - x < window]
        want[i] = len(held[key]) < limit
        if want[i]:
            held[key].append(now)
    schema = "key long, second double, event_id long"
    assert {r.event_id: r.allowed for r in st.limited(spark.createDataFrame(rows, schema).repartition(3), window, limit).collect()} == want
    known = [r for r in rows if r[0] is not None]
    got = streamed(spark, known, schema, 3, lambda stream: processors.limited_stream(stream, window, limit))
    assert {r.event_id: r.allowed for r in got} == {r[2]: want[r[2]] for r in known}


def test_average_with_null_keys_and_its_stream(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(i // 2), i, round(rng.random() * 50, 3)) for i in range(300)]
    last, want, nth = {}, {}, defaultdict(int)
    for key, _, i, v in rows:
        now = v if key not in last else last[key] * 0.7 + v * (1 - 0.7)
        last[key] = float(Decimal(repr(now)).quantize(Decimal("0.01"), ROUND_HALF_UP))
        want[i] = last[key]
    schema = "key string, second double, event_id long, value double"
    df = spark.createDataFrame(rows, schema)
    assert {r.key: r.ema for r in a.moving_average(df, "key", ["second", "event_id"], "value").collect()} == last
    got = streamed(spark, [r for r in rows if r[0]], schema, 4, processors.average_stream)
    assert {r.event_id: r.ema for r in got} == {r[2]: want[r[2]] for r in rows if r[0]}


@pytest.mark.parametrize("seed", [4, 5])
def test_debounce_and_its_timers(spark, seed):
    rng = random.Random(seed)
    second, rows = 1000.0, []
    for i in range(300):
        second += rng.choice([0, 1, 5, 29, 30, 31, 90])
        rows.append((rng.choice("abc"), second, i, rng.choice(["upsert", "upsert", "delete"])))
    waiting, want = {}, set()
    for key, now, i, action in rows:
        if key in waiting and now >= waiting[key][1]:
            want.add((key, waiting[key][0], "upsert", waiting.pop(key)[1]))
        if action == "delete":
            want.add((key, i, "delete", now))
        elif key not in waiting:
            waiting[key] = (i, now + 30)
    schema = "key string, second double, event_id long, action string"
    whole = want | {(k, i, "upsert", due) for k, (i, due) in waiting.items()}
    null = [(None, 0.0, 900, "upsert"), (None, 1.0, 901, "upsert")]
    got = {tuple(r) for r in st.debounced(spark.createDataFrame(rows + null, schema).repartition(3)).collect()}
    assert got == whole | {(None, 900, "upsert", 30.0)}
    seen = {tuple(r) for r in streamed(spark, rows, schema, 3, processors.debounced_stream)}
    fired = {(k, i, "upsert", due) for k, (i, due) in waiting.items() if due <= second - 60}
    assert seen == want | fired
    # a timer gives out what waits though nothing of its key comes any more
    late = [("lone", 1001.0, 1, "upsert"), ("other", 1300.0, 2, "delete"), ("other", 1400.0, 3, "delete")]
    assert ("lone", 1, "upsert", 1031.0) in {tuple(r) for r in streamed(spark, late, schema, 3, processors.debounced_stream)}


def test_changes_merged_in_any_order_and_twice(spark, tmp_path):
    rng = random.Random(6)
    changes = [(rng.choice([None, *range(20)]), i, f"v{i}", rng.choice(["upsert", "upsert", "delete"])) for i in range(200)]
    rng.shuffle(changes)
    schema = T.StructType.fromDDL("item long, event_id long, value string")
    want, applied = {}, defaultdict(int)
    for item, i, value, action in changes:
        applied[item] += 1
        if item not in want or want[item][0] < i:
            want[item] = (i, value, action)
    want = {k: (i, v, applied[k]) for k, (i, v, action) in want.items() if action != "delete"}
    table = MergedTable(spark, str(tmp_path / "t"), schema, "item", "event_id", buckets=4)
    for batch in range(5):
        df = spark.createDataFrame(changes[batch * 40 : batch * 40 + 40], "item long, event_id long, value string, action string")
        table.merge(df, batch)
        table.merge(df, batch)  # delivered again
    # a batch that died after its data and before its version is done again
    assert {r["item"]: (r.event_id, r.value, r.changes) for r in table.rows().collect()} == want
    assert table.rows(tombstones=True).count() == len(applied)
    table.vacuum()
    again = MergedTable(spark, str(tmp_path / "t"), schema, "item", "event_id", buckets=4)
    assert {r["item"]: (r.event_id, r.value, r.changes) for r in again.rows().collect()} == want
    places = again._places()
    again.merge(spark.createDataFrame([(1, 999, "new", "upsert")], "item long, event_id long, value string, action string"), 5)
    assert sum(again._places()[b] != n for b, n in places.items()) == 1  # only the bucket of item 1 is written anew


def test_merged_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = T.StructType.fromDDL("item long, event_id long")
    src = str(tmp_path / "src")
    table = MergedTable(spark, str(tmp_path / "t"), schema, "item", "event_id", buckets=3)
    for load in range(3):
        spark.range(load * 10, load * 10 + 10).selectExpr("id % 7 AS item", "id AS event_id", "if(id % 5 = 0, 'delete', 'upsert') AS action").write.mode("append").parquet(src)
        stream = spark.readStream.schema("item long, event_id long, action string").option("maxFilesPerTrigger", 1).parquet(src)
        table.follow(stream, str(tmp_path / "checkpoint"))
    assert {r["item"]: r.event_id for r in table.rows().collect()} == {i % 7: i for i in range(23, 30) if i % 5}
    assert sum(r.changes for r in table.rows(tombstones=True).collect()) == 30


def test_growing_answers_equal_checks_of_each_prefix(spark):
    said = {1: "It costs $12.50 and ships to you today, call now", 2: "It costs $99 only and more", 3: "mail us at a@b.de or c@d.de please do", 4: "fine words only"}
    facts = "12,50 EUR, a@b.de"
    rows = [(k, i // 5, text[i : i + 5], facts) for k, text in said.items() for i in range(0, len(text), 5)]
    df = spark.createDataFrame(rows, "answer_id long, position long, delta string, facts string")
    with processors.with_rocksdb(spark):
        got = st.run_available(processors.checked_answers(st.as_stream(df, F.floor(F.least("position", F.lit(8)) / 3), 3))).collect()
    want = set()
    for k, text in said.items():
        for i in range(0, len(text), 5):
            whole = text[: i + 5]
            stable = whole[: max(whole.rfind(" "), whole.rfind("\n"), 0)]
            ok, _, wrong, _ = check_facts(stable, facts)
            want.add((k, i // 5, text[i : i + 5] if ok else "", not ok, wrong[0] if wrong else None))
            if not ok:
                break
    assert {tuple(r) for r in got} == want and {r.answer_id for r in got if r.aborted} == {2, 3}


def test_replays_of_text_keys(spark):
    rows = [("s:1", 100.0, 1), ("s:1", 130.0, 2), ("s:2", 131.0, 3), ("t:1", 131.0, 4), ("s:1", 160.0, 5), ("s:1", 500.0, 6)]
    got = streamed(spark, rows, "key string, second double, event_id long", 2, lambda stream: processors.limited_stream(stream, 60.0, 1))
    assert {r.event_id for r in got if not r.allowed} == {2}


def test_limits_of_many_keys_are_kept_by_group(spark):
    rng, rows, second = random.Random(9), [], 0.0
    for i in range(3000):
        second += rng.choice([0, 0, 1, 2])
        rows.append((rng.choice([None, 9_007_199_254_740_993, *range(700)]), second, i))
    schema = "key long, second double, event_id long"
    plans = []

    def make(stream):
        out = processors.limited_stream(stream, 400.0, 1)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    got = {r.event_id: (r.key, r.allowed) for r in streamed(spark, rows, schema, 3, make)}
    want = {r.event_id: (r.key, r.allowed) for r in st.limited(spark.createDataFrame(rows, schema), 400.0, 1).collect()}
    assert got == want and 100 < sum(not a for _, a in want.values())
    assert "__group" in plans[0]  # calls and reads of the state by group, not by key
