"""Line, exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from siltstone.llm import exact_dedup, line_dedup, minhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def frame(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def near_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    base = rng.choices(vocabulary, k=120)
    texts = [None, "", "one", "ONE", "one two three", " \n ", "é one two three four five", "x " * 30_000]
    for i in range(n):
        if i % 3 == 0:  # copies with 0 to 12 words changed
            words = list(base)
            for _ in range(rng.randrange(13)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif i % 3 == 1:
            texts.append(passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60))))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))))
    return texts + texts[8:12]


def brute_components(texts, width, percent=80):
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, width):
    texts = near_texts(width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), width=width).collect()}
    assert got == brute_components(texts, width)


def test_members_that_counts_do_not_rule_out_match_brute_force(spark, monkeypatch):
    rng, asked = random.Random(5), []
    plausible = minhash._plausible
    monkeypatch.setattr(minhash, "_plausible", lambda percent: asked.append(percent) or plausible(percent))
    texts = []
    for _ in range(150):  # the same two words may stand in each place, so changed shingles are shared
        changed = set(rng.sample(range(120), rng.randrange(2, 12)))
        texts.append(" ".join(f"{'v' if i in changed else 'w'}{i}" for i in range(120)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), width=4).collect()}
    assert got == brute_components(texts, 4) and len({c for _, c in got.values()}) > 1
    assert asked == [80]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    long = [" ".join(f"w{j}" for j in range(a, a + 40)) for a in (0, 100, 200)]
    rows = [(1, long[0]), (2, long[0] + " more"), (7, long[1]), (7, long[2]), (7, long[1]), (8, long[1]), (9, long[2]), (None, long[0]), (None, "alone in its set"), (2**60 + 1, "far off id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df, width=4).collect()}
    again = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df.repartition(3), width=4).collect()}
    assert got == again and len(got) == 8
    assert got[1, 37] == (1, True) and got[2, 38] == (1, False) and got[None, 37] == (1, False)
    assert got[7, 37] == (7, True) and {got[8, 37][0], got[9, 37][0]} in ({7, 9}, {7, 8})  # 7 counts with one of its texts
    assert got[None, 1] == (None, True) and got[2**60 + 1, 1] == (2**60 + 1, True)


def test_near_duplicates_of_no_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_line_dedup_drops_what_many_pages_of_the_host_share(spark):
    texts = [f"menu\nown line {i}\nmenu" for i in range(20)] + [None, "", "menu"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate_lines(frame(spark, texts)).collect()}
    assert got[3] == ("own line 3", 3, 2)
    assert got[20] == (None, 0, 0) and got[21] == ("", 0, 0) and got[22] == ("", 1, 1)
    joined = line_dedup.drop_boilerplate_lines(frame(spark, texts), broadcast_bytes=0)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in joined.collect()} == got


def test_line_dedup_goes_by_the_ratio_alone(spark):
    texts = [f"menu\nown line {i}" for i in range(4)]
    assert [r.n_dropped for r in line_dedup.drop_boilerplate_lines(frame(spark, texts)).collect()] == [1] * 4
    once = line_dedup.drop_boilerplate_lines(frame(spark, ["only page\nof its host"])).first()
    assert (once.text, once.n_dropped) == ("only page\nof its host", 0)
    rare = [f"own {i}\nshared" if i < 2 else f"own {i}" for i in range(20)]
    assert sum(r.n_dropped for r in line_dedup.drop_boilerplate_lines(frame(spark, rare)).collect()) == 0


def test_line_dedup_passes_columns_of_any_name(spark):
    odd = "text string, source string, __lines string, __host string, __bad string, __stay string, `a.b` string, `c``d` long"
    df = spark.createDataFrame([(f"menu\nown {i}", "s", "l", "h", "b", "t", "dot", i) for i in range(5)], odd)
    got = sorted(line_dedup.drop_boilerplate_lines(df).collect(), key=lambda r: r["c`d"])
    assert [tuple(r) for r in got] == [(f"own {i}", "s", "l", "h", "b", "t", "dot", i, 2, 1) for i in range(5)]


def test_line_dedup_of_a_null_host_and_no_rows(spark):
    texts = [f"menu\nown {i}" for i in range(9)]
    assert {r.text for r in line_dedup.drop_boilerplate_lines(frame(spark, texts, None)).collect()} == {f"own {i}" for i in range(9)}
    assert line_dedup.drop_boilerplate_lines(frame(spark, [])).count() == 0


def brute_windows(texts, width):
    split = [(t or "").split() for t in texts]
    seen: dict = {}
    for words in split:
        for i in range(len(words) - width + 1):
            seen[tuple(words[i : i + width])] = seen.get(tuple(words[i : i + width]), 0) + 1
    out = {}
    for d, words in enumerate(split):
        gone = set()
        for i in range(len(words) - width + 1):
            if seen[tuple(words[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out[d] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_repeated_windows_match_brute_force(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    texts = [None, "", "a", "a " * 200, " ".join(passage[:34]), " ".join(passage[:35])]
    for _ in range(40):
        words = rng.choices([f"w{i}" for i in range(9)], k=rng.randrange(90))
        if rng.random() < 0.5:
            at, a = rng.randrange(len(words) + 1), rng.randrange(10)
            words[at:at] = passage[a : a + rng.randrange(30, 41)]
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.drop_repeated_windows(frame(spark, texts)).collect()}
    assert got == brute_windows(texts, 35)
    assert substring_dedup.drop_repeated_windows(frame(spark, [])).count() == 0


def test_substring_dedup_keeps_large_and_null_ids(spark):
    ids = [None, 2**53 + 1, 2**53 + 2, -1]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in substring_dedup.drop_repeated_windows(df).collect()} == {(i, f"text {i}") for i in ids}


def loads(index, spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in index.add(df).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()[:6]


@pytest.mark.parametrize("buckets", [4, 3])
def test_exact_dedup_over_loads_and_a_reopened_index(spark, tmp_path, buckets):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, buckets)
    assert loads(index, spark, []) == {}
    assert loads(index, spark, [(1, "a"), (2, "a"), (3, "b"), (None, "n"), (None, "n")]) == {
        (1, sha("a")): (2, 2, False), (2, sha("a")): (2, 2, True), (3, sha("b")): (3, 1, True), (None, sha("n")): (None, 2, True),
    }
    second = {(2, sha("b")): (3, 1, False), (9, sha("a")): (2, 2, False), (5, sha("c")): (5, 1, True)}
    assert loads(index, spark, [(2, "b"), (9, "a"), (5, "c")]) == second
    index.close()
    index = exact_dedup.DigestIndex(spark, path, buckets)
    assert index.digests().count() == 4
    assert loads(index, spark, [(7, "c"), (8, "d")]) == {(7, sha("c")): (5, 1, False), (8, sha("d")): (8, 1, True)}
    assert loads(index, spark, []) == {} and index.digests().count() == 5
    index.close()


def test_exact_dedup_reads_the_index_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    loads(index, spark, [(i, str(i)) for i in range(100)])
    groups = spark.createDataFrame([(b"x", 1, 1)], "digest binary, keep_id long, group_size long").groupBy("digest").agg({"keep_id": "max", "group_size": "max"})
    plan = index.matched(groups.toDF("digest", "keep_id", "group_size"))._jdf.queryExecution().executedPlan().toString()
    index.close()
    side = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in side and side.count("Exchange") == 1


def test_exact_dedup_query(spark, tmp_path):
    texts = ["a", "b", "a", None, "", "a ", "x" * 200_000, "x" * 200_000]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op2_exact_dedup(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
