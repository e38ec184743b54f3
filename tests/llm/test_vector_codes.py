"""Vector codes against plain loops over Python integers, and against DuckDB."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from siltstone.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by loops; rows of (vec_id, vector, label)."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(4096 * x) if abs(x) < 2**53 else int(x) * 4096 for x in v] for _, v, _ in kept]
    dims = len(whole[0])
    cuts = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
    books = [[w[a:b] for w in whole[:entries]] for a, b in cuts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for w in whole:
                groups.setdefault(nearest(books[p], w[a:b])[1], []).append(w[a:b])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for (i, _, lab), w in zip(kept, whole):
        found = [nearest(books[p], w[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def some_rows(seed, dims=16, n=200):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.choice([rng.gauss(0, 1), 0.0, -0.0, 0.5]) for _ in range(dims)], rng.choice([None, 0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(r[0] + 1, r[1], 9) for r in rows[:30]]  # copies, among the seeds too
    rows += [(r[0], r[1], r[2]) for r in rows[40:44]]  # repeated rows
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1.0] * (dims + 1), [1.0] * (dims - 1)]
    return rows + [(1000 + i, v, 5) for i, v in enumerate(odd)] + [(None, [0.25] * dims, None), (None, [0.25] * dims, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest_entry_of_the_lowest_index(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (16, seed + 1))  # ties and equal entries
    x = rng.integers(-5, 6, (3000, seed + 1))
    all_of = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        which, best = vc.KdTree(entries.tolist()).nearest(x.astype(kind))
        assert (which == all_of.argmin(1)).all() and (best == all_of.min(1)).all()


@pytest.mark.parametrize("dims", [16, 19, 5])
def test_codes_match_plain_loops(spark, dims):
    rows = some_rows(dims, dims)
    df = frame(spark, rows)
    books = vc.train(df)
    want, digest = brute(rows)
    assert books.sha256 == digest
    assert sorted(map(tuple, vc.encode(df, books, keep=["label"]).collect()), key=repr) == sorted(want, key=repr)


def test_huge_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e300, -1e300, 1e9, 3.5, 2.0**60]) * rng.random() for _ in range(8)], 0) for i in range(60)]
    df = frame(spark, rows)
    books = vc.train(df)
    want, digest = brute(rows)
    assert books.sha256 == digest and sorted(map(tuple, vc.encode(df, books, keep=["label"]).collect())) == sorted(want)


def test_decoded_vectors_have_the_stated_error(spark):
    rows = some_rows(2)
    df = frame(spark, rows)
    books = vc.train(df)
    known = {r[0]: [math.floor(4096 * x) for x in r[1]] for r in rows if r[0] is not None and r[0] < 1000}
    got = vc.decode(vc.encode(df, books), books).collect()
    assert len(got) == len(known) + 6
    for r in got:
        if r.vec_id is not None:
            assert sum((round(4096 * a) - b) ** 2 for a, b in zip(r.vector, known[r.vec_id])) == r.error


def test_few_rows_and_none(spark):
    assert vc.encode(frame(spark, []), vc.train(frame(spark, []))).count() == 0
    rows = [(4, [1.0] * 8, 1), (2, None, 1), (3, [0.0] * 8, None)]
    df = frame(spark, rows)
    books = vc.train(df)
    assert [len(p) for p in books.entries] == [2] * 8 and books.sha256 == brute(rows)[1]
    assert {r.code for r in vc.encode(df, books).collect()} == {"00" * 8, "01" * 8}


def test_query_matches_sql_and_reruns(spark, tmp_path):
    rows = [r for r in some_rows(3) if r[0] is not None and (r[1] is None or len(r[1]) in (0, 16))]
    rows = list({r[0]: r for r in rows if r[1] != []}.values())
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vc.op11_vector_codes(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(vc.OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    first = sorted(map(tuple, got.collect()))
    assert first == sorted(want.fetchall()) == sorted(map(tuple, vc.op11_vector_codes(spark, str(tmp_path)).collect()))
