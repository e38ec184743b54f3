"""Rounds of indexing against what a rebuild of the same documents holds."""

from __future__ import annotations

import random

from siltstone.functions import text as x
from siltstone.operators import indexing
from siltstone.operators.postings_index import PostingsIndex
from siltstone.scratch import saver

SCHEMA = "doc_id long, subtype string, lang string, fingerprint string, title string, blocks array<struct<kind:string,text:string,level:int>>, structured string"


def opened(spark, path):
    return PostingsIndex(spark, str(path), x.index_words, x.stem, buckets=4, stored=("heading_path", "kind"))


def document(rng, i, version):
    blocks = [("heading", f"Head {i}", 2)] + [("paragraph", " ".join(rng.choices(["zebra", "lion", "tiger", "river", "tree"], k=rng.randrange(1, 400))), 0) for _ in range(rng.randrange(1, 3))]
    return (i, "ab"[i % 2], "en", f"f{i}.{version}", f"Title {i}", blocks if i % 9 else [], None)


def content(index):
    return sorted((c.doc_id, c.chunk_id, c.heading_path) for c in index.chunks().collect()), sorted(map(tuple, index.postings().collect()))


def test_rounds_of_indexing(spark, tmp_path):
    rng, save = random.Random(1), saver(spark)
    frame = lambda docs: spark.createDataFrame(docs, SCHEMA).repartition(3)
    on = lambda *s: spark.createDataFrame([(v,) for v in s], "subtype string")
    index = opened(spark, tmp_path / "index")
    first = {i: document(rng, i, 0) for i in range(1, 31)}
    stored = spark.createDataFrame([(4, "old", "excluded"), (99, "old", "active"), (98, "old", "excluded")], indexing.STORED)
    done, stored, version = indexing.index_items(index, frame(list(first.values())), stored, on("a", "b"), save)
    got = {r.doc_id: r.action for r in done.collect()}
    assert version == 1 and got == {i: "excluded" if i == 4 else "empty" if i % 9 == 0 else "index" for i in first} | {99: "delete", 98: "excluded"}
    assert all((r.chunks > 0) == (r.action == "index") for r in done.collect())
    # nothing changed: nothing is written
    done, stored, version = indexing.index_items(index, frame([d for i, d in first.items() if i % 9]), stored, on("a", "b"), save)
    assert version == 1 and {r.action for r in done.collect()} == {"unchanged", "excluded"}
    # some change, some are gone, a subtype is switched off, new ones come
    second = {i: document(rng, i, 1) if i % 5 == 0 else first[i] for i in first if i % 7} | {i: document(rng, i, 0) for i in (40, 41)}
    done, stored, version = indexing.index_items(index, frame(list(second.values())), stored, on("a"), save)
    want = {}
    for i in {*first, *second, 98}:
        known = i in first and i % 9
        if i in (4, 98):
            want[i] = "excluded"
        elif i not in second:
            want[i] = "delete" if known else None
        elif i % 2:
            want[i] = "delete" if known else "disabled"
        elif i % 9 == 0:
            want[i] = "empty"
        else:
            want[i] = "unchanged" if known and second[i] == first.get(i) else "index"
    assert version == 2 and {r.doc_id: r.action for r in done.collect()} == {i: a for i, a in want.items() if a}
    held = [second[i] for i, a in want.items() if a in ("index", "unchanged")]
    rebuilt = opened(spark, tmp_path / "rebuilt")
    indexing.index_items(rebuilt, frame(held), spark.createDataFrame([], indexing.STORED), on("a"), save)
    assert content(index) == content(rebuilt) and content(index)[0]
    assert {(r.doc_id, r.fingerprint, r.status) for r in stored.collect()} == {(d[0], d[3], "active") for d in held} | {(4, second[4][3], "excluded"), (98, None, "excluded")}
