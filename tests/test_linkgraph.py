"""SimHash pairs and clusters against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from siltstone.operators import linkgraph as g
from siltstone.scratch import saver


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _hashes():
    rng = random.Random(3)
    rows = []
    for _ in range(40):  # a hash, and others up to five bits away, at any position
        base = rng.getrandbits(64)
        rows.append(base)
        for bits in rng.choices(range(1, 6), k=3):
            rows.append(base ^ sum(1 << i for i in rng.sample(range(64), bits)))
    rows += [rows[0]] * 30
    return [(i, i // 2 if i % 5 == 0 else i, _signed(h)) for i, h in enumerate(rows)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_near_pairs_lose_no_link_and_do_not_square_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(g, "HOT_CLASSES", hot)
    rows = _hashes()
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, simhash long")
    save = saver(spark)
    found = g.near_pairs(chunks, save).collect()
    members = {}
    for c, doc, h in rows:
        members.setdefault(h, []).append((c, doc))
    rep = {h: min(m)[0] for h, m in members.items()}
    want = set()
    for x, y in combinations(members, 2):
        bits = ((x ^ y) & (1 << 64) - 1).bit_count()
        if bits <= 3 and len({d for _, d in members[x] + members[y]}) > 1:
            want.add((*sorted((rep[x], rep[y])), bits))
    assert any(((rows[a][2] ^ rows[b][2]) >> 48) & 0xFFFF for a, b, _ in want)
    assert sorted((r.a, r.b, r.distance) for r in found if r.distance) == sorted(want)
    copies = members[rows[0][2]]
    assert sorted(r.b for r in found if r.distance == 0 and r.a == 0) == sorted(c for c, _ in copies)[1:]
    parent = {c: c for c, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for (a, da, ha), (b, db, hb) in combinations(rows, 2):
        if da != db and ((ha ^ hb) & (1 << 64) - 1).bit_count() <= 3:
            linked |= {a, b}
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert {r.node: r.cluster for r in g.clusters(g.near_pairs(chunks, save), save).collect()} == {c: find(c) for c in linked}
