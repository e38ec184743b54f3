"""Vector code compression: product quantisation over integers, nearest entries by kd-trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, col, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf of the tree.
LEAF = 2
#: Components that a worker holds as integers at a time.
BATCH_VALUES = 2 << 20
#: Sums travel in digits of this base, so that integers of any size add up in decimals.
BASE = 10**18
_MOST = 2**63 - 1


class KdTree:
    """The entries of one codebook; ``nearest`` gives, of equally near entries, the one of the lowest index.

    A node is either a list of entries or (axis, greatest value on the left, least value on the right, left, right). The entries are split at
    their median along the axis of the widest spread; equal values may stand on both sides.
    """

    def __init__(self, entries: Sequence[Sequence[int]]):
        self.entries = [tuple(e) for e in entries]
        self.root = self._build(list(range(len(self.entries))))
        self.largest = max((abs(x) for e in self.entries for x in e), default=0)

    def _build(self, of: list[int]):
        values = list(zip(*(self.entries[i] for i in of)))
        spreads = [max(v) - min(v) for v in values]
        if len(of) <= LEAF or not any(spreads):
            return of
        axis = spreads.index(max(spreads))
        of = sorted(of, key=lambda i: (self.entries[i][axis], i))
        left, right = of[: len(of) // 2], of[len(of) // 2 :]
        return axis, self.entries[left[-1]][axis], self.entries[right[0]][axis], self._build(left), self._build(right)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of ``x`` and the squared distance. All rows go down the tree together.

        A row enters a child unless its distance to the child's side is greater than the best found: sides as far as
        the best are entered, as they may hold an equally near entry of a lower index.
        """
        far = _MOST if x.dtype != object else 1 << 8192
        best = np.full(len(x), far, x.dtype)
        which = np.full(len(x), len(self.entries), np.int64)
        entries = np.array(self.entries, x.dtype).reshape(len(self.entries), x.shape[1])

        def visit(node, rows: np.ndarray, bound: np.ndarray) -> None:
            near = np.asarray(bound <= best[rows], bool)
            rows, bound = rows[near], bound[near]
            if not len(rows):
                return
            if isinstance(node, list):
                for i in node:
                    step = x[rows] - entries[i]
                    found = (step * step).sum(axis=1)
                    wins = np.asarray((found < best[rows]) | ((found == best[rows]) & (i < which[rows])), bool)
                    best[rows[wins]], which[rows[wins]] = found[wins], i
                return
            axis, below, above, left, right = node
            value = x[rows, axis]
            to_left, to_right = (np.maximum(bound, np.maximum(gap, 0) ** 2) for gap in (value - below, above - value))
            first = np.asarray(to_left <= to_right, bool)
            visit(left, rows[first], to_left[first])
            visit(right, rows[~first], to_right[~first])
            visit(right, rows[first], to_right[first])
            visit(left, rows[~first], to_left[~first])

        visit(self.root, np.arange(len(x)), np.zeros(len(x), x.dtype))
        return which, best


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]``: integer components. ``dims`` is the length of a whole vector."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    dims: int
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        said = ",".join(str(x) for part in self.entries for e in part for x in e)
        return hashlib.sha256(said.encode()).hexdigest()

    def spans(self) -> list[tuple[int, int]]:
        return spans(self.dims, len(self.entries))


def spans(dims: int, parts: int) -> list[tuple[int, int]]:
    """Start and end of each part; equal where ``parts`` divides ``dims``."""
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def usable(vectors: DataFrame, id_col: str, vec_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``vec_id``, ``v`` (doubles) and the columns of ``keep``, of rows whose vector has components, all of them finite."""
    v = col(vec_col).cast("array<double>")
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v"), *(col(c).alias(f"k_{i}") for i, c in enumerate(keep)))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def quantised(values: np.ndarray, scale: int, largest: int) -> np.ndarray:
    """floor(scale * value) as 64-bit integers where squares of differences fit, else as Python's."""
    fits = math.isqrt(2**60 // values.shape[1])
    if largest <= fits and np.abs(values).max(initial=0.0) * scale <= fits:
        return np.floor(values * scale).astype(np.int64)
    whole = [[int(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in row] for row in values.tolist()]
    return np.array(whole, object).reshape(values.shape)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dims: int, scale: int, largest: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix of integers, cut so that a matrix stays small."""
    for batch in batches:
        n = max(1, BATCH_VALUES // dims)
        for start in range(0, batch.num_rows, n):
            some = batch.slice(start, n)
            values = some.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield some, quantised(values, scale, largest)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while value:
        value, digit = divmod(value, BASE)
        yield place, sign * digit
        place += 1


_SUMS = "part int, entry int, at int, place int, value long"


def _round(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floors of the means of the parts nearest to them."""
    spark, cuts, dims, scale = kept.sparkSession, books.spans(), books.dims, books.scale
    sent = spark.sparkContext.broadcast([KdTree(part) for part in books.entries])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        totals = [np.zeros((len(tree.entries), hi - lo + 1), object) for tree, (lo, hi) in zip(trees, cuts)]
        for _, x in _blocks(batches, 0, dims, scale, max(tree.largest for tree in trees)):
            for p, (tree, (lo, hi)) in enumerate(zip(trees, cuts)):
                which, _ = tree.nearest(x[:, lo:hi])
                more = np.zeros((len(tree.entries), hi - lo), x.dtype)
                np.add.at(more, which, x[:, lo:hi])
                totals[p][:, 1:] += more.astype(object)
                totals[p][:, 0] += np.bincount(which, minlength=len(tree.entries)).astype(object)
        rows = [
            (p, e, at, place, digit)
            for p, table in enumerate(totals)
            for e, line in enumerate(table.tolist())
            for at, value in enumerate(line)
            for place, digit in _digits(value)
        ]
        schema = pa.schema([(n, pa.int64() if n == "value" else pa.int32()) for n in ("part", "entry", "at", "place", "value")])
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = kept.select("v").mapInArrow(sums, _SUMS).groupBy("part", "entry", "at", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    totals: dict[tuple[int, int, int], int] = {}
    for r in found.collect():  # at most parts * entries * (dims / parts + 1) numbers of a few digits
        at = (r.part, r.entry, r.at)
        totals[at] = totals.get(at, 0) + int(r.value) * BASE**r.place
    sent.destroy()

    def moved(p: int, e: int, old: tuple[int, ...]) -> tuple[int, ...]:
        n = totals.get((p, e, 0), 0)
        return tuple(totals.get((p, e, i + 1), 0) // n for i in range(len(old))) if n else old

    return Codebooks(tuple(tuple(moved(p, e, old) for e, old in enumerate(part)) for p, part in enumerate(books.entries)), dims, scale)


def train(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks:
    """Codebooks of ``entries`` integer entries for each of ``parts`` consecutive parts of the vectors.

    Components become floor(``scale`` * x). The codebooks start as the parts of the ``entries`` smallest ids (ties by the vector; null ids last);
    each round broadcasts a kd-tree per codebook (its size does not grow with the data), assigns every part of every vector
    where it lies, and replaces an entry by floor(sum / count) of its parts. Sums are integers, so the result depends neither on the partitions nor on
    their order. Entries that no part is nearest to stay.

    Rows without a vector, with an empty one or with a null or non-finite component are left out, and so are rows whose vector is not as long as that
    of the smallest id. Repeated rows count as often as they stand. Lengths that ``parts`` does not divide are cut as evenly as they
    can be. With fewer rows than ``entries`` the codebooks are smaller; without rows they are empty and ``dims`` is 0.
    """
    kept = usable(vectors, id_col, vec_col).select("vec_id", "v")
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dims = len(seeds[0].v) if seeds else 0
    first = [quantised(np.array([r.v]), scale, 0)[0].tolist() for r in seeds if len(r.v) == dims]
    if len(first) < len(seeds):  # vectors of other lengths stood among them
        seeds = kept.where(F.size("v") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        first = [quantised(np.array([r.v]), scale, 0)[0].tolist() for r in seeds]
    books = Codebooks(tuple(tuple(tuple(v[lo:hi]) for v in first) for lo, hi in spans(dims, parts)), dims, scale)
    kept = kept.where(F.size("v") == dims)
    for _ in range(rounds if dims else 0):
        books = _round(kept, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """``vec_id``, the columns of ``keep``, ``code`` (two hex digits a part: the index of its nearest entry), ``error`` (squared distances, summed).

    Rows that ``train`` leaves out have no code and are left out. An ``error`` beyond a long is the largest long. Other columns are not read.
    """
    if max(map(len, books.entries)) > 256:
        raise ValueError("two hex digits number 256 entries at most")
    kept = usable(vectors, id_col, vec_col, keep).where(F.size("v") == books.dims)
    cuts, dims, scale = books.spans(), books.dims, books.scale
    sent = kept.sparkSession.sparkContext.broadcast([KdTree(part) for part in books.entries])
    out = T.StructType([*(f for f in kept.schema if f.name != "v"), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for some, x in _blocks(batches, 1, dims, scale, max(tree.largest for tree in trees)):
            index, error = np.zeros((len(x), len(cuts)), np.uint8), np.zeros(len(x), x.dtype)
            for p, (tree, (lo, hi)) in enumerate(zip(trees, cuts)):
                index[:, p], distance = tree.nearest(x[:, lo:hi])
                error += distance
            digits, w = index.tobytes().hex(), 2 * len(cuts)
            said = pa.array([digits[i : i + w] for i in range(0, w * len(x), w)], pa.string())
            error = pa.array([min(int(e), _MOST) for e in error], pa.int64())
            columns = {n: c for n, c in zip(some.schema.names, some.columns) if n != "v"} | {"code": said, "error": error}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    found = kept.mapInArrow(codes, out)
    return found.select("vec_id", *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), "code", "error")


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """``encoded`` with ``vector``: the entries that ``code`` names, one after the other, divided by the scale."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(x / books.scale) for x in e)) for e in part)) for part in books.entries))
    indexes = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return encoded.withColumn("vector", F.flatten(F.zip_with(tables, indexes, lambda part, i: F.get(part, i))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; the contract's columns.

    Errors are summed per label before anything is shuffled, and the sums are joined back (broadcast up to a checked size), so a label of a third of
    all rows is no group in one task.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(vectors)
    found = Scratch(spark, "vector-codes").save(encode(vectors, books, keep=["label"]), "codes")
    sums = found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    sums = small(sums, sums.count())
    return found.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")
    )


def _sql(rounds: int = ROUNDS) -> str:
    nearest = """SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT vec_id, label, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN c{0} USING (p)) GROUP BY vec_id, label, p"""
    steps = "".join(
        f""",
a{r} AS MATERIALIZED ({nearest.format(r - 1)}),
c{r} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{r - 1} c LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN parts USING (vec_id, p))
      GROUP BY p, e, i) GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""
        for r in range(1, rounds + 1)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})){steps},
last AS MATERIALIZED ({nearest.format(rounds)}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id, label),
said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, said
"""


OP11_SQL = _sql()
