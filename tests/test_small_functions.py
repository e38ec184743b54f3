"""Fingerprints, excerpts and picks on stated cases."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, values, column):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string, c string, d string")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_error_fingerprints(spark):
    made = x.error_fingerprint(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = rows(spark, [
        ("E", "agent", "t", "Failed 12 times at /a/b/c.txt  now"), ("E", "agent", "t", "failed 9 times at /x now"), ("F", "agent", "t", "failed 9 times at /x now"),
        ("E", "other", "t", "failed 9 times at /x now"), ("E", "agent", None, "failed 9 times at /x now"), ("E", "agent", "u", "failed 9 times at /x now"),
    ], made)
    assert got[0] == got[1] == hashlib.sha1(b"E|agent|t|failed n times at /path now").hexdigest()
    assert len(set(got)) == 5 and got[4] == hashlib.sha1(b"E|agent|-|failed n times at /path now").hexdigest()


def test_excerpts(spark):
    made = x.excerpt(F.col("a"), F.col("b"), limit=20, least=5)
    got = rows(spark, [("Title  and a short text", "Title", "", ""), ("one two three four five six", "x", "", ""), ("abcdefghijklmnopqrstuvwxyz", "", "", ""), ("ab cdefghijklmnopqrstuvwxyz", "", "", "")], made)
    assert got == ["and a short text", "one two three four…", "abcdefghijklmnopqrst…", "ab cdefghijklmnopqrs…"]


def test_networks_of_addresses(spark):
    got = rows(spark, [(a, "", "", "") for a in ("10.1.2.3", "2001:0DB8:00a0:1::9", "2001:db8::1", "::1", "fe80::", "no address", None, "1.2.3")], x.ip_network(F.col("a")))
    assert got == ["10.1.2.0", "2001:db8:a0::", "2001:db8:0::", "0:0:0::", "fe80:0:0::", None, None, None]


def test_template_picks_are_those_of_the_session_and_hour(spark):
    got = registry.queries()["win11_template_pick"](spark, SF).collect()
    from siltstone import tables as t

    log = {r.msg_id: r for r in t.messages(spark, SF).collect()}
    assert {r.msg_id: r.pick for r in got} == {i: zlib.crc32(f"{r.session}{r.created_at:%Y%m%d%H}".encode()) % 3 for i, r in log.items()}
