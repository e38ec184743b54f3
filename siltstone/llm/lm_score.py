"""Language-model scores from a log-frequency Bloom filter of word pairs and triples."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import Chunks, pack, range_edges, unpack
from ._common import Scratch, release
from ._shingles import mix

#: Bits per entry of the filter, and bits that an entry sets: in each of ``WORDS`` 64-bit words, ``PROBES`` of them.
BITS, WORDS, PROBES = 20, 2, 5
#: How often an absent entry is found (measured; a test holds it to this).
FALSE_RATE = 4e-4
#: Keys that are probed at a time.
PROBED = 1 << 18
#: Weight of the shorter context in the smoothing, in counts.
MU = 4.0
#: Pairs and triples seen less often have no entry (and no mass).
LEAST = 2
#: Levels of quantised counts; two to a doubling.
MAX_LEVEL = 80
#: Bits of a key: those of its context come first, so that a context's entries lie in one key range.
_KEY = {"pairs": (28, 28), "triples": (30, 18)}
_END = np.uint64(0xE2D0F7E87)
_START = np.uint64(0x57A27)
_SALT = mix(np.arange(1, MAX_LEVEL * WORDS + 1, dtype=np.uint64)).reshape(MAX_LEVEL, WORDS)


def level_counts() -> np.ndarray:
    """The least count of each level: 0, 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    k = np.arange(MAX_LEVEL // 2 + 1)
    low = np.stack((2.0**k, 1.5 * 2.0**k), axis=1).ravel()
    return np.concatenate(([0.0, 1.0], low[2 : MAX_LEVEL + 2]))


_COUNTS = level_counts()


def levels(counts: np.ndarray, up: bool = False) -> np.ndarray:
    """The level whose least count is the next one down, or, with ``up``, the next one up."""
    at = np.searchsorted(_COUNTS[: MAX_LEVEL + 1], counts, "left" if up else "right") - (0 if up else 1)
    return np.minimum(at, MAX_LEVEL)


def _place(keys: np.ndarray, level: int, i: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The word (of ``n``) and the bits in it that entry (key, ``level``) sets the ``i``-th time."""
    h = (keys ^ _SALT[level, i]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    word = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return word, [(h >> np.uint64(6 * j)) & np.uint64(63) for j in range(PROBES)]


def segment(keys: np.ndarray, level: np.ndarray) -> bytes:
    """The Bloom filter of a key range: entry (key, j) for each level j up to the key's."""
    n = max(1, -(-int(level.sum()) * BITS // 64))
    bits = np.zeros(n * 64, bool)
    for j in range(int(level.max(initial=0))):
        some = keys[level > j]
        for i in range(WORDS):
            word, places = _place(some, j, i, n)
            for place in places:
                bits[(word << np.uint64(6)) + place] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(data: bytes, keys: np.ndarray) -> np.ndarray:
    """The level of each key: probes go on level by level until one is absent."""
    words = np.frombuffer(data, "<u8")
    out = np.zeros(len(keys), np.uint8)
    alive, some = np.arange(len(keys)), keys
    for j in range(MAX_LEVEL):
        for i in range(WORDS):
            word, places = _place(some, j, i, len(words))
            mask = np.zeros(len(some), np.uint64)
            for place in places:
                mask |= np.uint64(1) << place
            there = words[word] & mask == mask
            alive, some = alive[there], some[there]
        if not len(alive):
            break
        out[alive] = j + 1
    return out


def entries(keys: np.ndarray, counts: np.ndarray, kind: str) -> bytes:
    """A segment from sorted distinct ``keys``: their counts rounded down, and per context the sum of these, rounded up."""
    level = levels(counts)
    if not len(keys):
        return segment(keys, level)
    context = keys >> np.uint64(_KEY[kind][1])
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sums = levels(np.add.reduceat(_COUNTS[level], first), up=True)
    return segment(np.concatenate((mix(keys), mix(~context[first]))), np.concatenate((level, sums)))


def found(data: bytes, keys: np.ndarray) -> np.ndarray:
    """``probe`` of any number of keys, ``PROBED`` at a time."""
    return np.concatenate([probe(data, mix(keys[i : i + PROBED])) for i in range(0, len(keys), PROBED)] or [np.zeros(0, np.uint8)])


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    """Which values of a sorted array differ from the one before."""
    return np.concatenate((np.ones(min(len(sorted_), 1), bool), sorted_[1:] != sorted_[:-1]))


def _edges(parts: int, kind: str) -> np.ndarray:
    """Where the key ranges begin, but for the first; no context is cut."""
    bits = np.uint64(_KEY[kind][1])
    return range_edges(parts, sum(_KEY[kind])) >> bits << bits


def _cuts(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _tokens(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all tokens (words, then one end per document), which of them each token is, and tokens per document."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words = split.flatten()
    there = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words
    so_far = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    lengths = np.diff(so_far[split.offsets.to_numpy() - split.offsets[0].as_py()]) + 1
    coded = words.filter(there).dictionary_encode()
    hashes = map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False))
    distinct, of = np.unique(np.append(np.fromiter(hashes, np.uint64, len(coded.dictionary)), _END), return_inverse=True)
    code = np.full(lengths.sum(), len(coded.dictionary))
    last = np.zeros(len(code), bool)
    last[np.cumsum(lengths) - 1] = True
    code[~last] = coded.indices.to_numpy()
    return distinct, of[code], lengths


def _key(context: np.ndarray, token: np.ndarray, kind: str) -> np.ndarray:
    own, other = _KEY[kind]
    return (context >> np.uint64(64 - own) << np.uint64(other)) | (mix(token) >> np.uint64(64 - other))


def _grams(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: the token before it (or the start), and the keys of the pair and the triple that it ends.

    A document's first token has no triple (key 0).
    """
    first = np.cumsum(lengths) - lengths
    before = np.concatenate(([_START], tokens[:-1]))
    before[first] = _START
    pairs = _key(mix(before), tokens, "pairs")
    context = mix(mix(before) + mix(np.concatenate(([_START], before[:-1])) + np.uint64(1)))
    triples = _key(context, tokens, "triples")
    triples[first] = 0
    return before, pairs, triples


def _counts(data: np.ndarray) -> bytes:
    width = 4 if data.max(initial=0) >= 1 << 16 else 2 if data.max(initial=0) >= 1 << 8 else 1
    width = 8 if data.max(initial=0) >= 1 << 32 else width
    return bytes([width]) + data.astype(f"<u{width}").tobytes()


def _uncounts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def _merged(packed: pd.Series, packed_n: pd.Series, pieces: int = 4) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The sorted distinct keys of all slices, their counts over all, and which of them each slice's keys are; worked out in pieces of the range."""
    keys, counts = [unpack(x) for x in packed], [_uncounts(x) for x in packed_n]
    where = [np.zeros(len(k), np.int32) for k in keys]
    some = [i for i, k in enumerate(keys) if len(k)]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), where
    low, high = min(int(keys[i][0]) for i in some), max(int(keys[i][-1]) for i in some)
    edges = np.array([low + (high - low) * i // pieces for i in range(1, pieces)], np.uint64)
    cuts, distinct, total, before = [_cuts(k, edges) for k in keys], [], [], 0
    for a in range(pieces):
        each = [(i, slice(cuts[i][a], cuts[i][a + 1])) for i in some]
        piece = np.concatenate([keys[i][at] for i, at in each])
        order = np.argsort(piece)
        piece, count = piece[order], np.concatenate([counts[i][at] for i, at in each])[order]
        first = _firsts(piece)
        nth = np.empty(len(piece), np.int32)
        nth[order] = before + np.cumsum(first) - 1
        done = 0
        for i, at in each:
            where[i][at] = nth[done : done + at.stop - at.start]
            done += at.stop - at.start
        distinct.append(piece[first])
        if len(piece):
            total.append(np.add.reduceat(count, np.flatnonzero(first)))
        before += len(distinct[-1])
    return np.concatenate(distinct), np.concatenate(total), where


def _in_training(ids: pd.Series, folds: int) -> np.ndarray:
    return np.array([pd.isna(i) or zlib.crc32(i.encode()) % folds != 0 for i in ids], bool)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, mu: float = MU) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row of ``docs``.

    Tokens are words between ASCII white space (A-Z lower-cased) and one end. Training rows are those whose crc32(id as text) is
    not 0 mod ``folds`` (null ids train). ``base_score`` is the single-word model's log10 probability, with exact counts.

    ``score`` is log10 of the product of p3: with p1 the single-word model's probability,
    p2(w | v) = (q(v, w) + mu p1(w)) / (Z(v) + mu + f) and p3(w | u, v) = (q(u, v, w) + mu p2(w | v)) / (Z(u, v) + mu + f). A document's
    first token has p2 alone. q is the count of a pair or triple as the filter holds it: none under ``LEAST``, else
    rounded down to a level, found by probing (key, 1), (key, 2), ... until one is absent. Z is the measured sum of a
    context's q, rounded up, held in the same filter. A pair is looked up only if both words occur ``LEAST`` times, a triple only
    if both its pairs were found, and a q over its context's Z is cut to it; f is the mass that false finds are expected to add
    (``FALSE_RATE`` times the words that could be looked up after v). So the probabilities after a context sum to 1 at most, in
    expectation over the filter's hashes, and to 1 where its Z is 0.

    Chunks count their own words, pairs and triples, key ranges add them up over all chunks; a range turns its pairs and triples into
    its segment of the filter, and returns each chunk the exact counts of its words and what the segment holds of its keys and contexts. So a key
    travels once per chunk and is probed once, where its segment is; the filter never is in one place. Null text is empty: its one token
    is the end. An empty table gives no rows; rows that repeat are documents each. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    chunks = Chunks(docs, id_col, text_col)
    edges = {"words": range_edges(chunks.parts, 64)} | {kind: _edges(chunks.parts, kind) for kind in _KEY}
    names = [f"{kind}{x}" for kind in edges for x in ("", "_n")]

    def slices(keys, counts, kind):
        cuts = _cuts(keys, edges[kind])
        return [(pack(keys[a:b]), _counts(counts[a:b])) if a < b else (b"", b"") for a, b in zip(cuts[:-1], cuts[1:])]

    def ask(key, frame):
        words, where, lengths = _tokens(frame["text"])
        trains = np.repeat(_in_training(frame["doc_id"], folds), lengths)
        sets = [slices(words, np.bincount(where[trains], minlength=len(words)), "words")]
        _, pairs, triples = _grams(words[where], lengths)
        for kind, keys in (("pairs", pairs), ("triples", triples)):
            distinct, learnt = np.sort(keys[keys > 0]), np.sort(keys[trains & (keys > 0)])
            distinct = distinct[_firsts(distinct)]
            counts = np.diff(np.searchsorted(learnt, distinct), append=len(learnt))
            sets.append(slices(distinct, counts, kind))
        rows = [(p, key[0], *(x for y in some for x in y)) for p, some in enumerate(zip(*sets)) if any(y[0] for y in some)]
        return pd.DataFrame(rows, columns=["part", "chunk", *names])

    def answer(group):
        distinct, n, where = _merged(group["words"], group["words_n"])
        out = {"part": group["part"], "chunk": group["chunk"], "words": [_counts(n[w]) for w in where]}
        sums = pd.DataFrame({"chunk": [-1], "n": [n.sum()], "v": [(n > 0).sum()], "often": [(n >= LEAST).sum()]})
        for kind, (_, token_bits) in _KEY.items():
            distinct, n, where = _merged(group[kind], group[f"{kind}_n"])
            data = entries(distinct[n >= LEAST], n[n >= LEAST], kind)
            context = distinct >> np.uint64(token_bits)
            first = _firsts(context)
            level, z, of = found(data, distinct), found(data, ~context[first]), np.cumsum(first, dtype=np.int32) - 1
            out[kind] = [level[w].tobytes() for w in where]
            out[f"{kind}_z"] = [z[c[_firsts(c)]].tobytes() for c in (of[w] for w in where)]
        return pd.concat([pd.DataFrame(out), sums])[["part", "chunk", *answers, "n", "v", "often"]]

    by_chunk = chunks.table.groupBy("chunk")
    asked = by_chunk.applyInPandas(ask, f"part int, chunk int, {', '.join(f'{x} binary' for x in names)}")
    answers = ["words", *(f"{kind}{x}" for kind in _KEY for x in ("", "_z"))]
    told = scratch.save(
        asked.groupBy("part").applyInPandas(answer, f"part int, chunk int, {', '.join(f'{x} binary' for x in answers)}, n long, v long, often long"), "counts"
    )
    release(spark)
    n, v, often = told.where("chunk < 0").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "often"))).first()

    def scored(key, frame, told):
        words, where, lengths = _tokens(frame["text"])
        told = told.sort_values("part")
        c = np.concatenate([_uncounts(x) for x in told["words"]])
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))[where]
        before, pairs, triples = _grams(words[where], lengths)
        at_before = np.concatenate(([0], where[:-1]))
        at_before[before == _START] = np.searchsorted(words, _END)
        c_before, c = c[at_before], c[where]
        before_last = lambda x: np.concatenate(([False], x[:-1])) & (triples > 0)
        contexts = c_before >= LEAST
        wanted = contexts & (c >= LEAST)
        sets = {"pairs": (pairs, contexts, wanted), "triples": (triples, before_last(wanted), before_last(wanted) & wanted)}
        p, total, q = 10.0**base, c_before, None
        for kind, (keys, has_context, wanted) in sets.items():
            seen, q, z = q, np.zeros(len(keys)), np.zeros(len(keys))
            distinct, at = np.unique(keys[keys > 0], return_inverse=True)
            level, of_context = (np.frombuffer(b"".join(told[x]), np.uint8) for x in (kind, f"{kind}_z"))
            context = np.cumsum(_firsts(distinct >> np.uint64(_KEY[kind][1]))) - 1
            q[keys > 0], z[keys > 0] = _COUNTS[level][at], _COUNTS[of_context][context][at]
            q[~wanted], z[~has_context] = 0, 0
            false = FALSE_RATE * often
            if kind == "triples":
                q[seen == 0], total = 0, np.concatenate(([0], seen[:-1]))
                z[total == 0], false = 0, FALSE_RATE * np.minimum(often, c_before)
            total = np.maximum(total, z) if kind == "triples" else total
            z = np.minimum(z, total)
            p = np.where(has_context & (z > 0), (np.minimum(q, z) + (mu + total - z) * p) / (total + mu + false), p)
        first = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "held_out": ~_in_training(frame["doc_id"], folds),
                "n_tokens": lengths,
                "n_known": add((c > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": add(base),
                "score": add(np.log10(p)),
            }
        )

    of_chunk = told.where("chunk >= 0").select("chunk", "part", *answers).groupBy("chunk")
    out = by_chunk.cogroup(of_chunk).applyInPandas(
        scored, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
