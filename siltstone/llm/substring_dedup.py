"""Substring dedup with fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import Chunks, contains, inside, pack, range_edges, rolling, unpack
from ._common import Scratch, release
from ._shingles import word_hashes

#: Words of a window. A repeated window holds a whole aligned block of either of its two places if 2 * block - 1 <= window.
WINDOW = 35
_ANCHOR_BITS = 48


def _anchor_keys(words: np.ndarray, block: int) -> np.ndarray:
    return rolling(words, block) >> np.uint64(64 - _ANCHOR_BITS)


def _read(texts: pd.Series) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    split = [t.encode().split() for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    return split, lengths, np.concatenate([word_hashes(s) for s in split]) if split else np.zeros(0, np.uint64)


def _dealt(chunk: int, edges: np.ndarray, **sets: np.ndarray) -> pd.DataFrame:
    """Rows of ``part``, ``chunk`` and each set's keys in that range."""
    cuts = {k: np.concatenate(([0], np.searchsorted(v, edges), [len(v)])) for k, v in sets.items()}
    parts = [p for p in range(len(edges) + 1) if any(c[p] < c[p + 1] for c in cuts.values())]
    columns = {k: [pack(v[cuts[k][p] : cuts[k][p + 1]]) for p in parts] for k, v in sets.items()}
    return pd.DataFrame({"part": np.array(parts, "int32"), "chunk": np.full(len(parts), chunk, "int32")} | columns)


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and those that occur more than once."""
    distinct, counts = np.unique(keys, return_counts=True)
    return distinct, distinct[counts > 1]


def _repeated(group: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The chunks' keys of a range, and the keys that occur twice in any way."""
    each = [unpack(x) for x in group["keys"]]
    everything, shared = _twice(np.concatenate(each))
    return each, np.union1d(shared, np.concatenate([unpack(x) for x in group["multi"]]))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``text`` (kept words joined by a space) and ``spans`` (removed [start, end) in words).

    Every word goes that lies in a run of ``window`` words of its document whose word sequence also starts anywhere else, the
    same document included; runs are judged on the input.

    1. Index: each document's non-overlapping blocks of (window + 1) // 2 words. 2. Probe: every rolling window of a block's
    length is looked up in the index; one that equals an indexed block and stands in two places is a hit. A repeated run
    holds a whole indexed block of either place, so it holds a hit. 3. Extend: around hits, runs of ``window`` words are compared
    exactly (64-bit fingerprints of whole runs), one start after another, so that a hit grows to the maximal repeat or is
    dropped. Anchors have 48 bits: a false hit costs a comparison, not a word.

    Words are what stands between ASCII white space, unchanged. Null and short texts lose nothing; an empty table gives no rows; repeated
    rows are copies of one another; ids may be null. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    chunks = Chunks(docs, id_col, text_col)
    block = (window + 1) // 2
    anchor_edges, run_edges = range_edges(chunks.parts, _ANCHOR_BITS), range_edges(chunks.parts, 64)
    dealt = "part int, chunk int, keys binary, multi binary"

    def anchors(key, frame):
        _, lengths, words = _read(frame["text"])
        ok = inside(lengths, block)
        rolled = _anchor_keys(words, block)
        start = np.arange(len(rolled)) - np.repeat(np.cumsum(lengths) - lengths, lengths)[: len(rolled)]
        probes, multi = _twice(rolled[ok])
        indexed = np.unique(rolled[ok & (start % block == 0)])
        return _dealt(key[0], anchor_edges, keys=probes, multi=multi, blocks=indexed)

    def hits(group):
        each, repeated = _repeated(group)
        index = np.unique(np.concatenate([unpack(x) for x in group["blocks"]]))
        found = np.intersect1d(repeated, index, assume_unique=True)
        packed = [pack(x[contains(found, x)]) for x in each]
        return pd.DataFrame({"chunk": group["chunk"], "found": packed})[[len(x) > 0 for x in packed]]

    def runs(key, frame, found):
        if not len(frame) or not len(found):
            return _dealt(key[0], run_edges, keys=np.zeros(0, np.uint64), multi=np.zeros(0, np.uint64))
        _, lengths, words = _read(frame["text"])
        hit = contains(np.sort(np.concatenate([unpack(x) for x in found["found"]])), _anchor_keys(words, block))
        hit &= inside(lengths, block)
        so_far = np.concatenate(([0], np.cumsum(hit)))
        ok = inside(lengths, window)
        first = np.arange(len(ok))
        near = so_far[first + window - block + 1] > so_far[first]
        distinct, multi = _twice(rolling(words, window)[ok & near])
        return _dealt(key[0], run_edges, keys=distinct, multi=multi)

    def repeats(group):
        each, repeated = _repeated(group)
        packed = [pack(x[contains(repeated, x)]) for x in each]
        return pd.DataFrame({"chunk": group["chunk"], "found": packed})[[len(x) > 0 for x in packed]]

    def cleaned(key, frame, found):
        split, lengths, words = _read(frame["text"])
        covered = np.zeros(len(words) + 1, np.int64)
        if len(found):
            repeated = np.sort(np.concatenate([unpack(x) for x in found["found"]]))
            at = np.flatnonzero(contains(repeated, rolling(words, window)) & inside(lengths, window))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        texts, spans, removed, at = [], [], [], 0
        for doc in split:
            mask = gone[at : at + len(doc)]
            at += len(doc)
            n = int(mask.sum())
            removed.append(n)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])))) if n else np.zeros(0, np.int64)
            spans.append([[int(a), int(b)] for a, b in edges.reshape(-1, 2)])
            texts.append(b" ".join(doc if not n else [w for w, g in zip(doc, mask) if not g]).decode())
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_words": lengths, "n_removed": removed, "text": texts, "spans": spans})

    by_chunk = chunks.table.groupBy("chunk")
    asked = scratch.save(by_chunk.applyInPandas(anchors, f"{dealt}, blocks binary").groupBy("part").applyInPandas(hits, "chunk int, found binary"), "hits")
    release(spark)
    asked = by_chunk.cogroup(asked.groupBy("chunk")).applyInPandas(runs, dealt)
    found = scratch.save(asked.groupBy("part").applyInPandas(repeats, "chunk int, found binary"), "repeats")
    out = by_chunk.cogroup(found.groupBy("chunk")).applyInPandas(
        cleaned, "doc_id string, n_words long, n_removed long, text string, spans array<array<long>>"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    found = drop_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
