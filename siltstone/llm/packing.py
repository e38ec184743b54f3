"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch
from ._tokens import word_tokens

END_ID = 2
CAPACITY = 4096
#: Pieces of up to CAPACITY / TAIL_CLASS ids are packed as they are: their class wastes a 17th of a bin at most.
TAIL_CLASS = 16
#: Tasks whose last bins are settled together, before what they leave is settled over all.
GROUP = 64


def cut(n: int, capacity: int = CAPACITY, tail_class: int = TAIL_CLASS) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` ids.

    A piece of class k (lengths in (capacity / (k+1), capacity / k]) shares a bin with k - 1 others. What is
    left is kept whole where it fills its share to within a 17th; else the largest capacity / 2^i is cut off, which fills its share exactly.
    """
    start = 0
    while start < n:
        left = n - start
        k = max(1, capacity // left)
        share = capacity // k
        if left >= capacity:
            length, k = capacity, 1
        elif left * (tail_class + 1) >= share * tail_class or k >= tail_class:
            length = left
        else:
            k = 1
            while capacity // k > left:
                k *= 2
            length = capacity // k
        yield start, length, k
        start += length


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("class", T.IntegerType()),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class", pa.int32()),
    ]
)


def _batches(rows: Iterable[tuple], at_most: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


def _worker(path: str, capacity: int, end_id: int):
    """Tokenise, cut, and fill bins of k pieces per class k; pieces of bins that do not fill leave without a sequence (and the task as offset)."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        tokens, waiting, n_bins = word_tokens(path), {}, 0
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found, counts = tokens.batch(some.column(1).cast(pa.binary()))
                upto = np.cumsum(counts)
                for doc_id, first_id, last_id in zip(some.column(0).to_pylist(), (upto - counts).tolist(), upto.tolist()):
                    ids = found[first_id:last_id].astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    for start, length, k in cut(n, capacity):
                        bin_ = waiting.setdefault(k, [])
                        bin_.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n))
                        if len(bin_) == k:
                            offset = 0
                            for piece in bin_:
                                yield *piece, first + n_bins, offset, k
                                offset += piece[2]
                            n_bins += 1
                            waiting[k] = []
        for k, bin_ in waiting.items():
            for piece in bin_:
                yield *piece, None, TaskContext.get().partitionId(), k

    return lambda batches: _batches(rows(batches))


def _last_bins(capacity: int):
    """First fit, longest first, of the pieces that no full bin of their class takes."""

    def fill(pieces):
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="last")
        room: list[int] = []
        sequence, offset = [], []
        for n in pieces["length"]:
            for i, left in enumerate(room):
                if n <= left:
                    break
            else:
                i = len(room)
                room.append(capacity)
            sequence.append((3 << 60) + i)
            offset.append(capacity - room[i])
            room[i] -= n
        return pieces.assign(sequence_id=sequence, offset=offset)

    return fill


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``, ``class``.

    A document is its ids by ``tokenizer`` (a file's path on the workers) and ``end_id``; it is cut (see ``cut``) and every
    piece falls in a class by its length. Each worker fills the bins of a class with a fixed count of
    pieces on its own. What its last bins lack is settled over all workers: the same fixed count per class and group of tasks
    (``GROUP`` of them), again per class over the groups, then first fit for what is left, which is under one bin of each class:
    fewer than the sum of k - 1 over the classes that ``cut`` gives out, however large the input. A sequence's pieces lie gapless from offset 0; it is padded to ``capacity`` unless its length is a power of two.

    Null or empty text is ``end_id`` alone. Repeated rows are documents each. Null ids stay null. An
    empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.save(rows.mapInArrow(_worker(tokenizer, capacity, end_id), _PIECES), "pieces")
    done = [pieces.where(F.col("sequence_id").isNotNull())]
    rest = pieces.where(F.col("sequence_id").isNull()).withColumn("group", F.floor(F.col("offset") / GROUP))
    for level, by in ((1, ["class", "group"]), (2, ["class"])):
        full, rest = _fill(scratch.save(_ranked(rest, by), f"rest-{level}"), by, level)
        done.append(full)
    names = [f.name for f in _PIECES]
    done.append(rest.select(*names).groupBy().applyInPandas(_last_bins(capacity), _PIECES))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more.select(*names))
    return out


def _ranked(rest: DataFrame, by: list[str]) -> DataFrame:
    """``rest`` with its ``rank`` in its group; ids decide between pieces of one place of repeated documents."""
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "start", "ids")) - 1)


def _fill(rest: DataFrame, by: list[str], level: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of bins that a group fills by the fixed count of its class, and the others."""
    counts = rest.groupBy(*by).agg(F.count("*").alias("n")).select(*(F.col(c).alias(f"of_{c}") for c in by), "n")
    same = [F.col(c) == F.col(f"of_{c}") for c in by]
    rest = rest.join(counts, same).withColumn("bin", F.floor(F.col("rank") / F.col("class")).cast("long"))
    fills = (F.col("bin") + 1) * F.col("class") <= F.col("n")
    inside = Window.partitionBy(*by, "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    group = F.col("group").cast("long") if level == 1 else F.lit(0).cast("long")
    # 3 bits say who made a sequence: a worker's count stays under 2^59
    sequence = F.lit(level << 60) + F.col("class").cast("long") * F.lit(1 << 46) + group * F.lit(1 << 24) + F.col("bin")
    full = rest.where(fills).withColumns({"sequence_id": sequence, "offset": F.sum("length").over(inside) - F.col("length")})
    return full, rest.where(~fills).drop("rank", "bin", "n", *(f"of_{c}" for c in by))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents; the contract's columns."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or default_tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
