"""Titles of pages and digests of what an erasure leaves, against SQL on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from siltstone.plans import registry

TITLES = ["Cut &&&amp;&amp;&amp", "a &lt;b&gt; &amp;lt; &copy 3", "\n two\t lines \x0b and more ", "", "plain", "&nbsp;x &quot;y&quot;"]


@pytest.mark.parametrize("name", ["src01_site_pages", "src01s_site_stream"])
def test_titles_equal_sql(spark, tmp_path, name):
    rows = [(i, f"u/{i}", f"<html><TITLE>{t}</title><p>x") for i, t in enumerate(TITLES)] + [(90, "u/90", None), (91, "u/91", "<p>none")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(tmp_path)).select("external_id", "url", "title", "fingerprint").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("conversations", [3, 130])  # of 130 conversations all forty persons ask, and nothing of two tables is left
def test_erasure_equals_sql(spark, tmp_path, conversations):
    said = [(c, n, "user" if n % 2 == 0 else "assistant", None if (c + n) % 5 == 0 else f"said {c} {n}") for c in range(conversations) for n in range(2)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{\"k\":1}' AS props FROM range(50)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for table in ("conversations", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = registry.queries()["df12b_dsar_erase"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["df12b_dsar_erase"]).fetchall())
