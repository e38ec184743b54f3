"""Fill-in-middle against plain string slices, exact round trips, DuckDB."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from siltstone.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "a b c", "x<P>y z", "< P> <S", "<S <M <", "é 配送  word", "w" * 30_000, "w " * 30_000, "\x00 \x1c b"]


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed):
    rng = random.Random(seed)
    some = ["".join(rng.choices(" \n\tab<é>PSM　", k=rng.randrange(200))) for _ in range(60)]
    return ODD + some + ["".join(rng.choices([" ", "  \n", "word", "é", "<"], k=rng.randrange(9000))) for _ in range(8)]


@pytest.mark.parametrize("leaf", [1, 3, 50, 4096])
def test_ropes_split_and_join_as_strings_do(monkeypatch, leaf):
    monkeypatch.setattr(fim, "LEAF_CHARS", leaf)
    rng = random.Random(leaf)
    for text in (t or "" for t in texts(leaf)[: -8 if leaf < 50 else None]):
        units, tree = UNIT.findall(text), fim.rope(text)
        assert (fim.flat(tree), tree.chars, tree.units) == (text, len(text), len(units))
        for k in {0, len(units), rng.randrange(len(units) + 1)}:
            left, right = fim.split(tree, k)
            assert fim.flat(left) == "".join(units[:k]) and fim.flat(right) == "".join(units[k:])
            assert (left.units, right.units, left.chars + right.chars) == (k, len(units) - k, len(text))
        for k in {0, len(text), rng.randrange(len(text) + 1)}:
            assert [fim.flat(part) for part in fim.split(tree, k, "chars")] == [text[:k], text[k:]]


def test_transform_matches_slices_and_reads_back(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts(1) * 4)] + [(None, "a b c d", "", ""), (7, "again and again", "", ""), (7, "again and again", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)
    for rate, spm in ((100, 80), (50, 0), (100, 100)):
        got = fim.restore(fim.fill_in_middle(docs, rate=rate, spm_rate=spm)).collect()
        want = sorted((brute(r[0], r[1], rate=rate, spm=spm) + (r[1] or "", r[0]) for r in rows), key=repr)
        assert sorted(((*r[1:], r[0]) for r in got), key=repr) == want
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_bytes_that_are_no_utf8_have_a_defined_result(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "cast(x'61ff2062206320c3' AS string) AS text")
    got = fim.restore(fim.fill_in_middle(docs, rate=100)).collect()
    assert {r.restored for r in got} == {"a� b c �"} and {r.n for r in got} == {4}


def test_query_matches_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(2) * 3) if t is None or "\x00" not in t]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fim.op13_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(fim.OP13_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
