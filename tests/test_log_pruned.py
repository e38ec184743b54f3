"""The pruned log against its SQL: seconds at the limit, repeated, negative and missing ids, missing times."""

from __future__ import annotations

import duckdb

from siltstone.plans import registry


def test_log_equals_its_sql_at_the_limit_and_without_times(spark, tmp_path):
    at = f"{tmp_path}/events.parquet"
    duckdb.sql(f"""COPY (SELECT CASE WHEN i % 101 <> 0 THEN i % 1500 - 300 END AS event_id,
      CASE WHEN i % 7 <> 0 THEN TIMESTAMP '2024-01-10' + to_milliseconds(i % 41 * 100 - 2000) END AS ts, i % 9 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{"k":1}}' AS props
      FROM range(2000) t(i)) TO '{at}' (FORMAT parquet)""")
    got = registry.queries()["job07_log_pruned"](spark, str(tmp_path)).collect()
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW events AS SELECT * FROM '{at}'")
        want = base.execute(registry.oracle_sql()["job07_log_pruned"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want
