"""Dense vectors: normalisation, similarity of queries against all vectors, upkeep of the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; null for a zero vector."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))).getItem(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or a zero vector."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(0.0)


#: Queries that a task holds at a time.
QUERY_BLOCK = 4096


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, top: int = 30) -> DataFrame:
    """``nearest`` for a query set of any size: tasks hold blocks of ``QUERY_BLOCK`` queries, one after the other."""
    return nearest(queries, vectors, top, QUERY_BLOCK)


#: Vectors and queries that are multiplied at a time.
ROWS, COLUMNS = 4096, 512


def _odd(v: Column, key: Column) -> Column:
    """Vectors with a null key or components that are null, not finite or huge: numpy would add them up in another way."""
    return key.isNull() | F.exists(v, lambda x: x.isNull() | ~(F.abs(x) < 1e100))


class _Best:
    """The ``top`` of a block of queries of one length so far: rounded similarity downwards, then id upwards."""

    def __init__(self, matrix: np.ndarray, top: int):
        self.matrix, self.top = matrix, top
        self.score = np.full((len(matrix), top), -np.inf)
        self.ids = np.full((len(matrix), top), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for first in range(0, len(self.matrix), COLUMNS):
            raw = self.matrix[first : first + COLUMNS] @ rows.T
            least = self.score[first : first + COLUMNS, -1]
            if len(ids) > self.top and np.isneginf(least).any():  # no full list yet: that of these rows alone bounds it
                least = np.maximum(least, np.partition(raw, len(ids) - self.top, axis=1)[:, len(ids) - self.top])
            at, place = np.nonzero(raw >= least[:, None] - 2e-6)  # what rounding may lift to the last place is kept
            self._merge(first + at, ids[place], raw[at, place])

    def _merge(self, at: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> None:
        """Lists of all queries ``at`` together: one sort by query, similarity and id."""
        size = np.abs(raw)
        score = np.where(size < 1e9, np.copysign(np.floor(size * 1e6 + 0.5) / 1e6, raw) + 0.0, raw)
        better = (score > self.score[at, -1]) | ((score == self.score[at, -1]) & (ids < self.ids[at, -1]))
        at, ids, score = at[better], ids[better], score[better]
        changed = np.unique(at)
        at = np.append(np.repeat(changed, self.top), at)
        ids, score = np.append(self.ids[changed], ids), np.append(self.score[changed], score)
        order = np.lexsort((ids, -score, at))
        order = order[np.searchsorted(at[order], changed)[:, None] + np.arange(self.top)]
        self.score[changed], self.ids[changed] = score[order], ids[order]


def nearest(queries: DataFrame, vectors: DataFrame, top: int = 30, block: int | None = None) -> DataFrame:
    """``query_id``, ``vec_id`` (an integer), ``similarity``, ``rank``: the ``top`` most similar vectors of each query.

    ``queries`` (``query_id``, ``q``) is a small share of what a task could read and goes to every task, ``block`` queries at a time (all with None); a task
    multiplies its vectors with the queries as matrices. Only the ``top`` of each query and task reach the shuffle, and there are as many tasks as the
    session has cores: were they dealt by size, the rows shuffled would grow as queries times vectors. The vectors are shuffled once for all blocks.
    Odd vectors and queries (``_odd``) meet the others in a join of their own.
    """
    spark, kind, of = vectors.sparkSession, vectors.schema["vec_id"].dataType, queries.schema["query_id"].dataType
    odd_query, odd_vector = _odd(F.col("q"), F.col("query_id")), _odd(F.col("embedding"), F.col("vec_id"))
    queries, vectors = queries.where("q IS NOT NULL").select("query_id", "q"), vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    asked = queries.where(~odd_query).select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow().combine_chunks()
    wide = vectors.schema["embedding"].dataType.elementType
    numbers = F.col("embedding") if isinstance(wide, FloatType) else F.col("embedding").cast("array<double>")  # half the bytes to shuffle
    plain = vectors.where(~odd_vector).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    dealt = plain.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    schema = StructType([StructField("query_id", of), StructField("vec_id", LongType()), StructField("similarity", DoubleType())])

    scored = []
    for left, right in ((queries, vectors.where(odd_vector)), (queries.where(odd_query), vectors.where(~odd_vector))):
        pairs = right.join(F.broadcast(left.withColumn("dims", F.size("q"))), F.size("embedding") == F.col("dims"))
        scored.append(pairs.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("embedding")), 6).alias("similarity")))
    for first in range(0, len(asked), block or len(asked) or 1):
        found = _multiplied(asked.slice(first, block or len(asked)).combine_chunks(), top)
        scored.append(dealt.mapInArrow(found, schema).withColumn("vec_id", F.col("vec_id").cast(kind)))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return reduce(DataFrame.unionByName, scored).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _multiplied(asked: pa.Table, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task: the ``top`` of its vectors for each query ``asked`` (``query_id``, ``q``)."""
    names, q = (pa.concat_arrays(asked.column(c).chunks) for c in ("query_id", "q"))  # a slice's own rows only
    lengths = pc.list_value_length(q).to_numpy(zero_copy_only=False)
    groups = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    matrices = {n: q.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for n, at in groups.items()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(matrix, top) for n, matrix in matrices.items()}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                sizes = pc.list_value_length(some.column("embedding"))
                for n, of_length in best.items():
                    same = some.filter(pc.equal(sizes, n))
                    if len(same):
                        rows = same.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(same), n)
                        of_length.add(same.column("vec_id").to_numpy(zero_copy_only=False), rows)
        for n, of_length in best.items():
            for first in range(0, len(of_length.score), COLUMNS):
                part = slice(first, first + COLUMNS)
                at, place = np.nonzero(of_length.score[part] > -np.inf)
                columns = [names.take(pa.array(groups[n][part][at])), pa.array(of_length.ids[part][at, place]), pa.array(of_length.score[part][at, place])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "similarity"])

    return found


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model."""
    return chunks.join(vectors.where(F.col("model") == model), "chunk_id", "left_anti")


def without_orphans(vectors: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Vectors of the model whose chunk still exists."""
    return vectors.where(F.col("model") == model).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
