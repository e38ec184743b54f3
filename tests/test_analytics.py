"""Percentiles, averages and numbers that never gather a group in one row, against plain Python."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from siltstone.operators import analytics as a
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_discrete_fraction(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(40)])) for k in ["x", "y", None] for _ in range(rng.randrange(5, 90))] + [("one", 7), ("none", None)]
    found = a.discrete_fraction(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", 0.95).collect()
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        if values:
            want[k] = values[math.floor(0.95 * (len(values) - 1))]
    assert {r.k: r["at"] for r in found} == want


def test_moving_average(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, round(rng.random() * 100, 3), 0.125])) for k in range(4) for i in range(60)]
    found = a.moving_average(spark.createDataFrame(rows, "k long, i long, v double").repartition(7), "k", ["i"], "v").collect()
    want = {}
    for k, _, v in rows:
        last = want.get(k)
        now = v if last is None else None if v is None else last * 0.7 + v * (1 - 0.7)
        want[k] = now if now is None else float(Decimal(repr(now)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert {r.k: r.ema for r in found} == want


def test_numbered(spark):
    ids = random.Random(3).sample(range(-500, 5000), 300)
    found = a.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", block=70).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.nth)] == sorted(ids)
    assert sorted(r.nth for r in found) == list(range(300))


def test_no_group_is_gathered(spark):
    for name in ("agg02_p95_latency", "agg18_moving_average"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
