"""The registered streams give every row, from files."""

from __future__ import annotations

from collections import defaultdict
from datetime import timedelta

from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_session_stream_has_open_sessions(spark):
    by_user, want = defaultdict(list), set()
    for e in spark.read.parquet(f"{SF}/events.parquet").collect():
        by_user[e.user_id].append(e.ts)
    for user, times in by_user.items():
        run = []
        for t in sorted(times):
            if run and t - run[-1] >= timedelta(hours=1):
                want.add((user, run[0], run[-1] + timedelta(hours=1), len(run)))
                run = []
            run.append(t)
        want.add((user, run[0], run[-1] + timedelta(hours=1), len(run)))
    found = [tuple(r) for r in registry.queries()["stm04_session_stream"](spark, SF).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_limiter_stream_is_read_from_files(spark):
    df = registry.queries()["stm03s_limiter_stream"](spark, SF)
    assert df.inputFiles()
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").count()
