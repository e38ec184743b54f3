"""Whole texts in chunks, and sets of 64-bit keys dealt between chunks and key ranges.

A chunk is some megabytes of documents, dealt by hash. What a chunk asks of the whole corpus (how often does this key
occur?) goes out as one packed set of distinct keys per key range, so a key that stands in a third of all rows
travels once per chunk, and comes back the same way. All of it runs as Spark joins and groups over
written tables; a chunk or a key range is all that a task holds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Bucketed, Scratch, col, release
from ._shingles import mix

#: Characters of text in a chunk, about.
CHUNK_CHARS = 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Chunks:
    """``doc_id`` (as text, which pandas does not round) and ``text`` of all rows in files bucketed and sorted by ``chunk``.

    Bytes that are no UTF-8 become U+FFFD. Reading them by chunk needs no shuffle, so texts are shuffled once however often they are gone through.

    ``parts`` is the number of key ranges. A range holds two chunks' worth of keys in one task, and a chunk sends one row of packed keys to each
    range: their number is chunks times ranges, as the blocks of any shuffle, and never over the number of keys.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS):
        rows = docs.select(
            col(id_col).cast("long").cast("string").alias("doc_id"), F.make_valid_utf8(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("text")
        )
        chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, math.ceil(chars / chunk_chars))
        self.parts = max(32, math.ceil(self.n / 2))
        chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n)).cast("int").alias("chunk")
        self.files = Bucketed(rows.select(chunk, "doc_id", "text"), "chunk", Scratch(docs.sparkSession, "chunks"), buckets=min(self.n, 20_000))
        self.table = self.files.rows
        release(docs.sparkSession)


def range_edges(parts: int, bits: int) -> np.ndarray:
    """Where the key ranges begin, but for the first."""
    return np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)


def pack(keys: np.ndarray) -> bytes:
    """A sorted array of 64-bit keys as differences of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[1:, :width] = planes.T
    keys = steps.view(np.uint64).ravel()
    keys[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(keys, dtype=np.uint64)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values of a long array, in constant work a value."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    powers = np.full(len(words) + 1, _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(len(words) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)))
    return mix((total[width:] - total[:-width]) * inverse[: len(words) - width + 1])


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` over the concatenation of documents lie within one document."""
    n = int(lengths.sum()) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(n) + width <= ends[:n]


def contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys
