"""Scores, rules, mixing, formatting and packing against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chat_format, lm_score, mixing, packing, quality_model, quality_rules, substring_dedup
from siltstone.llm._chunks import Chunks
from siltstone.llm._common import Scratch
from siltstone.llm._shingles import word_hashes
from siltstone.llm._tokens import WordTokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, "clash") for i, t, lang, source in rows], SCHEMA)


def some_rows(n=60):
    rng = random.Random(2)
    vocabulary = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(80))), "en", "ab"[i % 2]) for i in range(n)]
    return rows + [(n, None, None, None), (n + 1, "", "fr", "c"), (n + 2, "lone", "fr", None), (n + 3, "y " * 9000, "en", "a")]


class BruteModel:
    """The model of ``lm_scores`` on plain dicts."""

    def __init__(self, documents, mu=lm_score.MU):
        self.mu, self.words, self.grams = mu, Counter(), {2: Counter(), 3: Counter()}
        for tokens in documents:
            self.words.update(tokens)
            for i, w in enumerate(tokens):
                before = (tokens[i - 2] if i > 1 else "<s>", tokens[i - 1] if i else "<s>")
                self.grams[2][before[1], w] += 1
                if i:
                    self.grams[3][*before, w] += 1
        self.n, self.often = sum(self.words.values()), sum(c > 1 for c in self.words.values())
        low = [0, 1] + [x for k in range(1, 40) for x in (2**k, 3 * 2 ** (k - 1))]
        down = lambda c: max(x for x in low if x <= c)
        self.q = {g: down(c) for n in (2, 3) for g, c in self.grams[n].items() if c > 1}
        sums = Counter()
        for g, c in self.q.items():
            sums[g[:-1]] += c
        self.z = {g: min(x for x in low if x >= c) for g, c in sums.items()}

    def base(self, w):
        return (self.words[w] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))

    def smooth(self, q, z, total, false, p):
        z = min(z, total)
        return (min(q, z) + (self.mu + total - z) * p) / (total + self.mu + false) if z else p

    def p(self, w, v, u=None):
        c = self.words[v] if v != "<s>" else self.words[None]
        q2 = self.q.get((v, w), 0) if c > 1 and self.words[w] > 1 else 0
        p = self.smooth(q2, self.z.get((v,), 0) if c > 1 else 0, c, lm_score.FALSE_RATE * self.often, self.base(w))
        if u is None:
            return p
        total = self.q.get((u, v), 0)
        z = self.z.get((u, v), 0) if total else 0
        return self.smooth(self.q.get((u, v, w), 0) if q2 else 0, z, max(total, z), lm_score.FALSE_RATE * min(self.often, c), p)

    def score(self, tokens):
        before = ["<s>", *tokens[:-1]]
        return sum(math.log10(self.p(w, v, before[i - 1] if i else None)) for i, (v, w) in enumerate(zip(before, tokens)))


def test_lm_scores_match_brute_force(spark):
    rows = some_rows()
    got = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    tokens = {i: [w.lower() for w in WORDS.findall(t or "")] + [None] for i, t, *_ in rows}
    model = BruteModel([ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10])
    off = [abs(got[i].score - model.score(ws)) for i, ws in tokens.items()]
    lookups = 4 * sum(map(len, tokens.values()))
    # All are equal but for those that hold a false find, of which about lookups * FALSE_RATE (4) are expected; one moves a token by under a decade or so.
    assert sum(x > 1e-6 for x in off) <= 3 * lookups * lm_score.FALSE_RATE and max(off) < 1.5
    for u, v in [("<s>", "w1"), ("w1", "w2"), ("w3", "w9"), ("y", "y"), ("none", "such")]:
        assert sum(model.p(w, v, u) for w in [*model.words, "unseen"]) <= 1 + 1e-9
        assert sum(model.p(w, v) for w in [*model.words, "unseen"]) <= 1 + 1e-9


def test_filter_finds_all_entries_and_few_others():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, 100_000, dtype=np.uint64))
    level = rng.integers(1, 9, len(keys))
    data = lm_score.segment(keys, level)
    assert (lm_score.probe(data, keys) >= level).all()
    absent = rng.integers(1 << 62, 1 << 63, 1_000_000, dtype=np.uint64)
    assert (lm_score.probe(data, absent) > 0).mean() < 1.2 * lm_score.FALSE_RATE


def test_lm_keeps_large_and_null_ids(spark):
    ids = [None, 2**53 + 1, 2**53 + 2, -1]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_lm_counts_and_base_scores_match_brute_force(spark):
    rows = some_rows()
    got = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    tokens = {i: [w.lower() for w in WORDS.findall(t or "")] + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert lm_score.lm_scores(frame(spark, [])).count() == 0


def test_lm_filter_is_probed_where_its_segments_are(spark, monkeypatch):
    rows = some_rows()
    whole = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}

    def never(*_):
        raise AssertionError("the filter grows with the corpus, so it may not pass through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", never)
    monkeypatch.setattr(lm_score, "Chunks", lambda *a: Chunks(*a, chunk_chars=1000))
    got = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    assert got.keys() == whole.keys()
    for i, r in got.items():
        assert r[:5] == whole[i][:5] and r[5:] == pytest.approx(whole[i][5:], rel=1e-9)


def test_lm_tokens_are_words_between_ascii_white_space():
    texts = ["", " ", "a", " a\x0b\x0cB\t\n\r c ", "\xc9 \xe9 \u0130 a", "\x1cA\x1fB \x85", "x x x", "\n\n"]
    distinct, where, lengths = lm_score._tokens(pd.Series(texts))
    each = [t.encode().lower().split() for t in texts]
    assert lengths.tolist() == [len(ws) + 1 for ws in each]
    assert distinct[where].tolist() == [h for ws in each for h in (*word_hashes(ws).tolist(), int(lm_score._END))]
    assert (np.diff(distinct.astype(object)) > 0).all()


def brute_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 3)})


def test_quality_counts_match_brute_force(spark):
    rows = some_rows() + [(99, "# a\n\n# a\n$b|c\n# a", "en", "a"), (100, "same words here " * 40, "en", "a")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        words = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r, repeats = got[i], brute_repeats(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(words) < 50 or 100 * repeats > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(frame(spark, [])).count() == 0


def brute_quality(metrics, prior=200, spread=6.0):
    """Verdicts from exact quartiles (a sketch's differ by 0.2 % at most)."""

    def quartiles(some, rule):
        x = sorted(r[rule] for r in some)
        return np.array([x[max(0, math.ceil(p * len(x)) - 1)] for p in (0.25, 0.5, 0.75)])

    kept, taught = {}, [r for r in metrics if not r.base_failed]
    for r in metrics:
        failed = r.base_failed
        for rule, (least, sides) in quality_rules.RULES.items():
            q = quartiles(taught, rule)
            for of in ([t for t in taught if t.lang == r.lang], [t for t in taught if (t.lang, t.source) == (r.lang, r.source)]):
                share = len(of) / (len(of) + prior)
                q = share * quartiles(of, rule) + (1 - share) * q if of else q
            width = spread * (q[2] - q[0])
            failed |= r[rule] > max(q[2] + width, q[1] + least) + 1e-12
            failed |= sides == "both" and r[rule] < min(q[0] - width, q[1] - least) - 1e-12
        kept[r.doc_id] = not failed
    return kept


@pytest.mark.parametrize("prior", [1, 200])
def test_quality_verdicts_match_exact_quartiles(spark, prior):
    rng, rows = random.Random(8), []
    for i in range(150):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("fr", "a"), (None, "c")])
        marks = rng.choice([0, 0, 0, 3]) if source == "a" else rng.randrange(12, 20) if source == "b" else 0
        marks = 40 if i % 29 == 0 else marks
        text = [f"{'long' * (3 if lang == 'fr' else 1)}{rng.random()}" for _ in range(60)]
        rows.append((i, " ".join(text + ["#"] * marks), lang, source))
    df = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.judge_quality(df, prior_docs=prior).collect()}
    metrics = quality_rules.ratios(quality_rules.text_counts(df.select("doc_id", "lang", "source", "text"))).collect()
    metrics = [Row(**m.asDict(), base_failed=got[m.doc_id].base_failed) for m in metrics]
    assert {i: r.kept for i, r in got.items()} == brute_quality(metrics, prior)
    assert 0 < sum(not r.kept for r in got.values()) < 60


def test_sketches_are_the_same_however_rows_are_dealt(spark):
    """Over a hundred thousand rows: equal thresholds on every run, quartiles within a cell of the exact ones."""
    rules = list(quality_rules.RULES)
    rows = spark.range(120_000).selectExpr("if(id % 3 = 0, 'en', if(id % 3 = 1, 'fr', NULL)) AS lang", "if(id % 2 = 0, 'a', 'b') AS source",
                                           *(f"if(id % 11 = 0, 0, pow(1.0001, (xxhash64(id, {i}) % 40000)) * {i + 1}) AS {r}" for i, r in enumerate(rules)))
    runs = []
    for n in (1, 3, 7):
        found = quality_rules.thresholds(rows.repartition(n, F.rand(n))).collect()
        runs.append(sorted((tuple(r) for r in found), key=repr))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 6
    exact = {r: sorted(x[0] for x in rows.where("lang = 'en' AND source = 'a'").select(r).collect()) for r in rules}
    for r in quality_rules.quartiles(quality_rules.sketches(rows), "lang", "source").where("lang = 'en' AND source = 'a'").collect():
        values = exact[r.rule]
        for q, p in zip(r.q, (0.25, 0.5, 0.75)):
            want = values[math.ceil(p * len(values)) - 1]
            assert want / 1.002 - 1e-12 <= q <= want and r.n == len(values)


def brute_targets(sizes, most=3):
    """Shares by weight; what lies over a cap is shared again by weight among the others until nothing does."""
    sources = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = dict.fromkeys(sources, 0.0), float(sum(sizes.values())), set(sources)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else share * weight[s]
            left -= target[s]
        open_ -= over or open_
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    names = [*"abcdefg", "\ue000", "\U0001f600", None][: 4 + 3 * seed]
    sizes = {s: rng.choice([0, 1, 50, 5000, 100_000]) for s in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)


def test_mix_comes_near_its_targets_and_agrees_on_reruns(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice("aaaab") if i % 7 else "c") for i in range(1500)] + [(1500, None, None, None)]
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(r.size for r in got)
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>", "<\\|end|>", "<\\\\|text|>[\\INST]", "é" * 9000])
def test_turns_read_back(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    rendered, start, end = chat_format.render_turn("assistant", text)
    assert chat_format.parse(rendered) == [("assistant", text)] and chat_format.unescape(rendered[start:end]) == text


def test_chat_query_matches_the_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", None), (2, 0, "system", "x"), (2, 1, "assistant", ""), (2, 2, "assistant", "né")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op7_chat_format(spark, str(tmp_path)).collect()}
    for conv in (1, 2):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        said = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert set(got) == {-1, 1, 2} and got[-1].loss_chars == len("</s>[INST] ok [/INST]")


def check_packing(pieces, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = ids[r.doc_id]
        want = b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length])
        assert (r.doc_tokens, r.ids_crc32) == (len(own), zlib.crc32(want))
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    for runs in (*sequences.values(), *covered.values()):
        at = 0
        for start, length in sorted(runs):
            assert start == at and length > 0
            at += length
    assert all(sum(n for _, n in runs) <= 4096 for runs in sequences.values())
    assert {i: sum(n for _, n in runs) for i, runs in covered.items()} == {i: len(x) for i, x in ids.items()}


def test_packing_covers_each_id_once(spark, tmp_path):
    odd = ["", None, "Straße ÉCOLE don't x2y 配送 İ̀", "word, " * 12_000, "\x00 � é a­b", "İstanbul ǅ ﬁ"]
    texts = dict(enumerate(odd + [" ".join(f"tok{j}!" for j in range(i * 7)) for i in range(40)]))
    frame(spark, [(i, t, "en", "a") for i, t in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(packing.op9_packing(spark, str(tmp_path)).collect(), texts)


def test_packing_pads_little_and_settles_leftovers_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    rng = random.Random(6)
    texts = {i: " ".join(["word"] * rng.choice([3, 40, 300, 900, 2500, 6000])) for i in range(600)}
    df = frame(spark, [(i, t, "en", "a") for i, t in texts.items()]).repartition(7)
    rows = packing.pack(df, packing.default_tokenizer()).collect()
    used, covered = Counter(), Counter()
    for r in rows:
        used[r.sequence_id] += r.length
        covered[r.doc_id] += r.length
    assert all(covered[r.doc_id] == r.doc_tokens for r in rows) and len(covered) == 600 and max(used.values()) <= 4096
    full = [n for n in used.values() if n & (n - 1)]
    assert sum(4096 - n for n in full) < 0.03 * sum(used.values())
    assert {r.sequence_id >> 60 for r in rows} == {0, 1, 2, 3}


def test_packing_of_no_rows_and_of_a_vocabulary_that_looks_across_words(spark, tmp_path):
    assert packing.pack(frame(spark, []), packing.default_tokenizer()).count() == 0
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    other = Tokenizer(models.BPE({c: i + 3 for i, c in enumerate(pre_tokenizers.ByteLevel.alphabet())} | {"a</w>": 400}, []))
    other.pre_tokenizer, other.decoder = pre_tokenizers.ByteLevel(add_prefix_space=True), decoders.ByteLevel()
    other.save(path := str(tmp_path / "other.json"))
    tokens = WordTokens(path)
    assert not tokens.by_words and WordTokens(packing.default_tokenizer()).by_words
    ids, counts = tokens.batch(pa.array([b"ab  cd", None, b"e"], pa.binary()))
    want = [other.encode(x, add_special_tokens=False).ids for x in ("ab  cd", "", "e")]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_classifier_and_pipeline_of_no_rows(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert quality_model.op10_quality_classifier(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    same = " ".join(f"w{j}" for j in range(40))
    rows = [(1, same), (1, same), (None, same), (4, same + " x"), (5, None), (5, None), (6, "alone"), (None, "of null id"), (None, "of null id")]
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "of null id"), (1, same), (5, ""), (5, ""), (6, "alone")]


def test_conflicting_labels_teach_nothing_and_null_ids_are_in_training(spark, tmp_path):
    rows = [(i, f"{'good long sentence here. ' * 9 if i % 2 else 'x# $% '}{i}", "en", "a") for i in range(60)] + [(None, "no id", "en", "a")]
    docs = frame(spark, rows)
    labels = [(i, i % 2) for i in range(50)]
    clash = [(i, 1 - i % 2) for i in range(10)]
    some = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    model = quality_model.train(docs, some(labels + clash))
    alone = quality_model.train(docs, some([(i, q) for i, q in labels if i >= 10]))
    again = quality_model.train(docs, some(clash + labels + labels).repartition(5))
    scores = lambda m: [tuple(r) for r in quality_model.score(docs, m).select("text", "score").orderBy("text").collect()]
    assert scores(model) == scores(alone) == scores(again)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    some(labels).write.parquet(str(tmp_path / "labels.parquet"))
    got = quality_model.op10_quality_classifier(spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False] and len(got) == 61


def test_texts_that_are_no_utf8_are_worked_on(spark, tmp_path):
    bad = spark.range(40).selectExpr("id AS doc_id", "concat(cast(x'61ff20' AS string), repeat('word next ', 30), cast(id AS string), cast(x'c3' AS string)) AS text")
    assert lm_score.lm_scores(bad).where("score < 0").count() == 40
    assert substring_dedup.drop_repeated_windows(bad, window=5).count() == 40
    rows = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, cast(x'61ff' AS string) AS text UNION ALL SELECT 1, 1, cast(x'ff' AS string), 'b'")
    (got,) = chat_format.conversation_digests(chat_format.format_turns(rows)).collect()
    assert got.turns_sha256 == hashlib.sha256("user\na\ufffd\n\ufffd\nb\n".encode()).hexdigest()


def test_classifier_on_held_out_labels(spark):
    got = {r.doc_id: r for r in quality_model.op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id].score, r.quality) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_classifier_scores_odd_texts_without_labels(spark):
    df = frame(spark, some_rows())
    model = quality_model.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_model.score(df, model).select("score").where("score between 0 and 1").count() == df.count()


def test_pipeline_stages_keep_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, scratch = docs, Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, kept, SF), name.replace(" ", "-"))
        assert after.columns == docs.columns, name
        if name != "mixing":
            assert after.count() <= kept.count()
        kept = after
    texts = {r.doc_id: r.n_chars for r in kept.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
