"""Token files against whole-text encoding, exact round trips, views without a copy, failed attempts."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import sequence_files as sf
from siltstone.llm.packing import default_tokenizer

ODD = ["", None, " \n", "Straße ÉCOLE don't x2y 配送", "word, " * 12_000, "\x00 é a­b", "a", "a"]


def texts():
    return dict(enumerate(ODD + [" ".join(f"tok{j}!" for j in range(i * 7)) for i in range(60)]))


def encoded(spark, lengths, partitions=1):
    rng = random.Random(1)
    rows = [(i, b"".join(rng.randrange(1, 40_000).to_bytes(4, "little") for _ in range(n))) for i, n in enumerate(lengths)]
    return rows, spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")


def test_query_matches_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [(i * 5 - 100, t, "clash", "clash") for i, t in texts().items()]
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, ids string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sf.op12_token_files(spark, str(tmp_path)).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("length", [8, 64])
@pytest.mark.parametrize("partitions", [1, 5])
def test_round_trip_of_any_lengths(spark, tmp_path, length, partitions):
    rng = random.Random(length)
    lengths = [rng.choice([1, 2, length, 64 * length, 64 * length - 1, rng.randrange(1, 300)]) for _ in range(90)]
    rows, df = encoded(spark, lengths, partitions)
    path = f"file://{tmp_path}/t"
    sf.write(df, path, length, vocabulary=40_000 if length == 8 else None)
    got = sorted(map(tuple, sf.read(spark, path).collect()))
    starts = np.cumsum([0, *lengths])
    assert [(r[0], r[1], r[2], bytes(r[3])) for r in got] == [(i, starts[i], lengths[i], ids) for i, ids in rows]
    sequences = sorted(sf.read(spark, path, "sequences").collect(), key=lambda r: r.start)
    assert all(len(r.ids) == len(r.mask) == len(r.last) == length for r in sequences)
    assert b"".join(i.to_bytes(4, "little") for r in sequences for i, m in zip(r.ids, r.mask) if m) == b"".join(ids for _, ids in rows)
    assert sum(m for r in sequences for m in r.last) == len(rows)
    padded = [r for r in sequences if False in r.mask]
    assert len(padded) <= len({r.shard for r in sequences}) and all(i == 0 for r in padded for i, m in zip(r.ids, r.mask) if not m)


def test_any_sequence_is_a_view_of_the_mapped_file(spark, tmp_path):
    _, df = encoded(spark, [100] * 200)
    sf.write(df, str(tmp_path / "t"), 32)
    (name,) = [f for f in os.listdir(tmp_path / "t" / "data") if f.endswith("sequences.arrow")]
    file = sf.SequenceFile(str(tmp_path / "t" / "data" / name))
    whole = np.concatenate([ids for ids, _, _ in file.runs()])
    assert len(file) == 20_000 // 32
    before = pa.total_allocated_bytes()
    for k in (len(file) - 1, 0, 64, 63, 400):
        ids, mask = file[k]
        assert (ids == whole[32 * k : 32 * k + 32]).all() and mask.true_count == 32
        assert not ids.flags.owndata and not ids.flags.writeable
    assert pa.total_allocated_bytes() == before
    with pytest.raises(IndexError):
        file[len(file)]


@pytest.mark.parametrize("texts_bytes", [1, 300, 4 << 20])
def test_batches_of_texts_have_the_ids_of_whole_texts(monkeypatch, texts_bytes):
    from tokenizers import Tokenizer

    from siltstone.llm import _tokens as bt

    monkeypatch.setattr(bt, "GENERATION", 20)
    monkeypatch.setattr(bt, "BLOCK", 7)
    monkeypatch.setattr(sf, "TEXT_BYTES", texts_bytes)
    whole = Tokenizer.from_file(default_tokenizer())
    odd = ["İstanbul IĞDIR ſo Ÿ ŉa ǅ ﬁ", "a.b c,, d! ?", ".", "e\u0301t\u00e9, ÉTÉ.", "ab\x0bcd\x0cef\x1cgh\x85ij", "  lead  and trail  ", "x" * 5000 + " y"]
    said = [*odd, *(t for t in texts().values() if t != ODD[4]), *odd]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(said))), "text": pa.array(said, pa.string())})
    tokens = bt.WordTokens(default_tokenizer())
    monkeypatch.setitem(bt._TOKENS, default_tokenizer(), tokens)
    at = 0
    for doc_ids, ids, counts in sf._encoded(batch, default_tokenizer(), 1):
        for n in counts:
            want = [*whole.encode(said[at] or "", add_special_tokens=False).ids, 1]
            assert ids[:n].tolist() == want, said[at]
            ids, at = ids[n:], at + 1
    assert at == len(said)


def test_order_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(3, "b"), (None, "x y"), (1, "a"), (3, "b"), (3, "c d"), (None, None), (2, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sf.write_texts(docs, str(tmp_path / "t"), default_tokenizer())
    got = sorted(sf.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1] * 3 + [2] * 3 + [3] * 9 + [None] * 6
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    alike = [bytes(r.ids) for r in got if r.doc_id == 3]
    assert sum(a != b for a, b in zip(alike, alike[1:])) == 1  # equal texts of an id stand together


def test_bytes_that_are_no_utf8_and_no_rows(spark, tmp_path):
    docs = spark.range(3).selectExpr("id AS doc_id", "cast(x'61ff20622063' AS string) AS text")
    sf.write_texts(docs, str(tmp_path / "a"), default_tokenizer())
    assert sf.read(spark, str(tmp_path / "a")).select("ids").distinct().count() == 1
    sf.write_texts(docs.limit(0), str(tmp_path / "b"), default_tokenizer())
    assert sf.read(spark, str(tmp_path / "b")).count() == 0


def test_overwrite_and_files_of_failed_attempts(spark, tmp_path):
    path = tmp_path / "t"
    rows, df = encoded(spark, [5, 6, 7])
    sf.write(df, str(path), 8)
    (path / "data" / "000000-ofafailedattempt-sequences.arrow").write_bytes(b"half")
    with pytest.raises(Exception, match="holds a table"):
        sf.write(df, str(path), 8)
    assert sf.read(spark, str(path)).count() == 3
    rows, df = encoded(spark, [2, 2])
    sf.write(df, str(path), 8, overwrite=True)
    assert [bytes(r.ids) for r in sf.read(spark, str(path)).orderBy("start").collect()] == [ids for _, ids in rows]
    assert len(os.listdir(path / "data")) == 2
