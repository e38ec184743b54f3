"""Fill-in-middle transformation on ropes: texts cut at two unit ranks and rearranged around sentinels, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import NOT_SPACE, SPACE, col

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf, about: a leaf ends with the unit that reaches it.
LEAF_CHARS = 4096
#: A batch of this many characters leaves a task before the next text is worked on.
BATCH_CHARS = 8 << 20

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_EDGE = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_SPACES = " \t\n\v\f\r"


class Leaf:
    """A piece of text with the number of its code points and of its units (counted when first asked for).

    A unit is a run of white space with the word after it, or the white space at the end.
    """

    __slots__ = ("text", "chars", "_units")

    def __init__(self, text: str, units: int | None = None):
        self.text, self.chars, self._units = text, len(text), units

    @property
    def units(self) -> int:
        if self._units is None:  # bytes are split at ASCII white space alone
            self._units = len(self.text.encode().split()) + (self.text[-1:] in _SPACES and self.text != "")
        return self._units

    def leaves(self) -> Iterator[Leaf]:
        yield self

    def cut(self, rank: int, by: str) -> tuple[Leaf, Leaf]:
        if by == "chars":
            return Leaf(self.text[:rank]), Leaf(self.text[rank:])
        at = 0
        for unit, _ in zip(_UNIT.finditer(self.text), range(rank)):
            at = unit.end()
        return Leaf(self.text[:at], rank), Leaf(self.text[at:], self.units - rank)


class Node:
    """Two ropes after each other, with the sums of their counts."""

    __slots__ = ("left", "right", "chars", "_units")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right, self.chars, self._units = left, right, left.chars + right.chars, None

    @property
    def units(self) -> int:
        if self._units is None:
            self._units = self.left.units + self.right.units
        return self._units

    def leaves(self) -> Iterator[Leaf]:
        waiting: list[Leaf | Node] = [self]
        while waiting:
            top = waiting.pop()
            if isinstance(top, Leaf):
                yield top
            else:
                waiting += [top.right, top.left]


Rope = Leaf | Node


def rope(text: str) -> Rope:
    """A balanced rope whose leaves end where units end."""
    parts: list[Rope] = []
    at = 0
    while len(text) - at > LEAF_CHARS:
        edge = _EDGE.search(text, at + LEAF_CHARS - 1)
        end = edge.end() if edge else len(text)
        parts.append(Leaf(text[at:end]))
        at = end
    if at < len(text) or not parts:
        parts.append(Leaf(text[at:]))
    while len(parts) > 1:
        parts = [Node(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def concat(*parts: Rope) -> Rope:
    """The parts one after the other; empty ones are left out. The tree grows by one level a part."""
    out: Rope | None = None
    for part in parts:
        if part.chars:
            out = part if out is None else Node(out, part)
    return out or Leaf("", 0)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """``tree`` before and after its first ``rank`` units (or ``by="chars"``). Only leaves on the way down are cut; the others are shared."""
    before: list[Rope] = []
    after: list[Rope] = []
    while isinstance(tree, Node):
        here = getattr(tree.left, by)
        if rank < here:
            after.append(tree.right)
            tree = tree.left
        else:
            before.append(tree.left)
            rank -= here
            tree = tree.right
    left, right = tree.cut(rank, by)
    return concat(*before, left), concat(right, *reversed(after))


def flat(tree: Rope) -> str:
    return "".join(leaf.text for leaf in tree.leaves())


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 that an id decides; a null id counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform_text(text: str, h: list[int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    tree = rope(text)
    n = tree.units
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, suffix = split(tree, second)
    prefix, middle = split(before, first)
    p, s, m = (Leaf(mark, 0) for mark in (PREFIX, SUFFIX, MIDDLE))
    if h[3] % 100 < spm_rate:
        return n, "spm", prefix.chars, middle.chars, flat(concat(s, suffix, p, prefix, m, middle))
    return n, "psm", prefix.chars, middle.chars, flat(concat(p, prefix, s, suffix, m, middle))


def restore_text(output: str, form: str) -> str:
    """The text whose ``output`` has that form.

    A transformed text holds no sentinel of its own, and none can arise across a seam (a sentinel starts with the only ``<`` it has and ends
    with the only ``>``), so the first find of each is the one put there.
    """
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(two, len(one)), output.index(MIDDLE)
    rest, third = split(rope(output), at[1], "chars")
    rest, second = split(rest, at[0], "chars")
    parts = [split(part, len(mark), "chars")[1] for part, mark in ((rest, one), (second, two), (third, MIDDLE))]
    prefix, suffix = (parts[1], parts[0]) if form == "spm" else parts[:2]
    return flat(concat(prefix, parts[2], suffix))


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts one at a time; bytes that are no UTF-8 become U+FFFD."""
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42
) -> DataFrame:
    """One row per document: ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A text is a rope of its units (white space and the word after it). ``rate`` percent of the documents are cut before two ranks that
    the id and ``seed`` decide and written as ``<P>``prefix``<S>``suffix``<M>``middle (``psm``) or, ``spm_rate`` percent of them, as
    ``<S>``suffix``<P>``prefix``<M>``middle (``spm``). The others stay as they are (``plain``, null counts), as do empty texts and those that
    hold a sentinel. Every row is worked on where it lies; nothing is shuffled.

    Null text counts as empty. A null id counts as an empty string in the draw. Repeated rows are documents each; of a repeated id all are
    drawn alike. Bytes that are no UTF-8 become U+FFFD before the text is cut, in ``plain`` too. An empty table gives no rows. Other columns are not read.
    """
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, rows, held = 0, [], 0
            ids = batch.column(0)
            for i, text in enumerate(_texts(batch.column(1))):
                rows.append(transform_text(text, draws(ids[i].as_py(), seed), rate, spm_rate))
                held += len(text)
                if held >= BATCH_CHARS or i + 1 == batch.num_rows:
                    new = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)).cast(pa.int64()), *new], schema=schema)
                    start, rows, held = i + 1, [], 0

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (as ``fill_in_middle`` gives it) with ``restored``: the text, rebuilt from ``output`` and ``form`` alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, output = (batch.schema.get_field_index(c) for c in ("form", "output"))
            start, rows, held = 0, [], 0
            for i, text in enumerate(_texts(batch.column(output))):
                rows.append(restore_text(text, batch.column(form)[i].as_py()))
                held += len(text)
                if held >= BATCH_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(rows))
                    yield part.append_column("restored", pa.array(rows, pa.string()))
                    start, rows, held = i + 1, [], 0

    return made.mapInArrow(work, T.StructType([*made.schema, T.StructField("restored", T.StringType())]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract's columns, digests taken of ``output`` and ``restored``."""
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '{SPACE[:-1]}*{NOT_SPACE}|{SPACE}') AS u
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)::BIGINT], '') AS prefix,
    array_to_string(u[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS middle, array_to_string(u[greatest(a, b)::BIGINT + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
