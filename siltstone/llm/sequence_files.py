"""Token ids in Arrow files of equal-length sequences and masks, as a Spark data source that writes and reads them.

A table is a folder: ``manifest.arrow`` (one row a shard) and, per shard, ``data/NAME-sequences.arrow`` and ``data/NAME-documents.arrow``. All are Arrow
IPC files: a stream of record batches and a footer that says where each lies.

- Sequences: ``ids`` (uint16 where the vocabulary fits, else int32), ``mask`` and ``last`` (bits), fixed-size lists of ``length`` values, ``BATCH`` rows
  in every batch but the last. Row k lies in batch k // BATCH, so a reader that maps the file gets any sequence without a copy (``SequenceFile``). A
  shard's ids run on from row to row; only its last row is padded. ``mask`` is set for ids and not for padding, ``last`` for the last id of a document.
- Documents: ``doc_id`` and ``start`` (ids of the shard before it), in order.
- Manifest: ``name``, ``documents``, ``tokens``, ``start`` (ids of all shards before it), in order; ``length`` stands in the schema's metadata.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._common import col, shared_dir
from ._tokens import word_tokens
from .packing import default_tokenizer

END_ID = 1
#: A multiple of eight, so that a sequence's bits start with a byte.
LENGTH = 2048
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 4 << 20
#: Sequences of a record batch.
BATCH = 64
#: Documents of a record batch of the list of documents.
DOCUMENTS_BATCH = 65_536

_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64())])
_MANIFEST = pa.schema([("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("start", pa.int64())])


def _sequences_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))])


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder: local, ``file:``, or any store that Arrow knows."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _open(where: arrow_fs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    """Local files are mapped into memory, others read by range."""
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(where, arrow_fs.LocalFileSystem) else where.open_input_file(path))


class SequenceFile:
    """Sequences of one shard by number. What a mapped file gives are views of its pages: nothing is copied or read ahead."""

    def __init__(self, path: str):
        self._file = _open(*_place(path))
        self.length = self._file.schema.field("ids").type.list_size
        last = self._file.num_record_batches - 1
        self._n = last * BATCH + self._file.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids (numpy) and mask (Arrow bits) of sequence ``k``."""
        if not 0 <= k < self._n:
            raise IndexError(k)
        batch, at = self._file.get_batch(k // BATCH), k % BATCH * self.length
        ids, mask = batch.column("ids").values, batch.column("mask").values
        return ids.slice(at, self.length).to_numpy(), mask.slice(at, self.length)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, mask and last ids of each batch, one sequence after the other (bits as bytes)."""
        for i in range(self._file.num_record_batches):
            ids, *bits = self._file.get_batch(i).columns
            yield ids.values.to_numpy(), *(x.values.to_numpy(zero_copy_only=False) for x in bits)


class _Shard:
    """Writes the ids of documents one after the other; holds one batch of sequences."""

    def __init__(self, where: arrow_fs.FileSystem, stem: str, length: int, id_type: pa.DataType):
        self.length, self.documents, self.tokens = length, 0, 0
        self._ids, self._last, self._at = np.zeros(BATCH * length, id_type.to_pandas_dtype()), np.zeros(BATCH * length, bool), 0
        self._pending: list[tuple[list[int | None], np.ndarray]] = []
        self._schema = _sequences_schema(length, id_type)
        self._sinks = [where.open_output_stream(f"{stem}-{what}.arrow") for what in ("sequences", "documents")]
        self._files = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self._sinks, (self._schema, _DOCUMENTS))]

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents of ``counts`` ids each, one after the other in ``ids``."""
        if (counts < 1).any():
            raise ValueError("a document has one id at least, its end")
        if len(ids) and int(ids.max()) > np.iinfo(self._ids.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit {self._ids.dtype}")
        ends = np.cumsum(counts)
        self._pending.append((doc_ids, self.tokens + ends - counts))
        self.documents += len(doc_ids)
        if sum(len(x) for x, _ in self._pending) >= DOCUMENTS_BATCH:
            self._list()
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, len(self._ids) - self._at)
            self._ids[self._at : self._at + n] = ids[done : done + n]
            self._last[self._at : self._at + n] = last[done : done + n]
            self._at, done = self._at + n, done + n
            if self._at == len(self._ids):
                self._flush()
        self.tokens += len(ids)

    def _flush(self) -> None:
        n = -(-self._at // self.length) * self.length
        self._ids[self._at : n], self._last[self._at : n] = 0, False
        values = self._ids[:n], np.arange(n) < self._at, self._last[:n]
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in values]
        self._files[0].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self._schema))
        self._at = 0

    def _list(self) -> None:
        ids, starts = [i for some, _ in self._pending for i in some], np.concatenate([x for _, x in self._pending])
        self._files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts)], schema=_DOCUMENTS))
        self._pending = []

    def close(self) -> None:
        if self._at:
            self._flush()
        if self._pending:
            self._list()
        for end in (*self._files, *self._sinks):
            end.close()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    tokens: int


def _some_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``TEXT_BYTES`` of ``text``, a row at least."""
    upto = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + TEXT_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _encoded(batch: pa.RecordBatch, tokenizer: str, end_id: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Ids of texts with ``end_id`` after each."""
    for some in _some_texts(batch):
        found, counts = word_tokens(tokenizer).batch(some.column("text").cast(pa.binary()))
        counts = counts + 1
        ids = np.full(len(found) + len(counts), end_id, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(counts) - 1] = False
        ids[inside] = found
        yield some.column("doc_id").to_pylist(), ids, counts


def _given(batch: pa.RecordBatch) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents whose ``ids`` are little-endian 32-bit numbers already."""
    values = batch.column("ids").cast(pa.binary())
    counts = np.asarray(pc.binary_length(values).fill_null(0), np.int64) // 4
    return batch.column("doc_id").to_pylist(), np.frombuffer(b"".join(x or b"" for x in values.to_pylist()), "<u4"), counts


class _Writer(DataSourceArrowWriter):
    """Every task attempt writes files of its own name; the manifest, written last, lists those of the attempts that Spark committed."""

    def __init__(self, path: str, length: int, narrow: bool, tokenizer: str | None, end_id: int, overwrite: bool):
        self.path, self.length, self.narrow, self.tokenizer, self.end_id, self.overwrite = path, length, narrow, tokenizer, end_id, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = _place(self.path)
        where.create_dir(f"{root}/data")
        partition = TaskContext.get().partitionId()
        name, shard = f"{partition:06d}-{uuid.uuid4().hex}", None
        for batch in iterator:
            for documents in _encoded(batch, self.tokenizer, self.end_id) if self.tokenizer else [_given(batch)]:
                if documents[0]:
                    shard = shard or _Shard(where, f"{root}/data/{name}", self.length, pa.uint16() if self.narrow else pa.int32())
                    shard.add(*documents)
        if shard is None:
            return _Written(partition, "", 0, 0)
        shard.close()
        return _Written(partition, name, shard.documents, shard.tokens)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = _place(self.path)
        shards = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition)
        target = f"{root}/manifest.arrow"
        if not self.overwrite and where.get_file_info(target).type != arrow_fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a table")
        where.create_dir(f"{root}/data")
        starts = np.cumsum([0, *(m.tokens for m in shards)])[:-1]
        rows = [[m.name for m in shards], [m.documents for m in shards], [m.tokens for m in shards], starts]
        schema = _MANIFEST.with_metadata({"length": str(self.length)})
        with where.open_output_stream(f"{target}.new") as sink, pa.ipc.new_file(sink, schema) as file:
            file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema))
        where.move(f"{target}.new", target)
        listed = {m.name for m in shards}
        for info in where.get_file_info(arrow_fs.FileSelector(f"{root}/data")):
            if info.base_name.rsplit("-", 1)[0] not in listed:  # of failed attempts, or of the table overwritten
                where.delete_file(info.path)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = _place(self.path)
        for m in messages:
            if m is not None and m.documents:
                for what in ("sequences", "documents"):
                    where.delete_file(f"{root}/data/{m.name}-{what}.arrow")


@dataclass
class _ShardToRead(InputPartition):
    name: str
    documents: int
    tokens: int
    start: int


class _Reader(DataSourceReader):
    """A partition a shard. ``view`` is ``documents`` or ``sequences``."""

    def __init__(self, path: str, view: str):
        self.path, self.view = path, view

    def partitions(self) -> list[_ShardToRead]:
        where, root = _place(self.path)
        with where.open_input_file(f"{root}/manifest.arrow") as file:
            return [_ShardToRead(**row) for row in pa.ipc.open_file(file).read_all().to_pylist()] or [_ShardToRead("", 0, 0, 0)]

    def read(self, partition: _ShardToRead) -> Iterator[pa.RecordBatch]:
        if not partition.documents:
            return iter(())
        stem = f"{self.path}/data/{partition.name}"
        sequences = SequenceFile(f"{stem}-sequences.arrow")
        return self._sequences(partition, sequences) if self.view == "sequences" else self._documents(partition, sequences, f"{stem}-documents.arrow")

    @staticmethod
    def _sequences(shard: _ShardToRead, file: SequenceFile) -> Iterator[pa.RecordBatch]:
        at = 0
        for ids, mask, last in file.runs():
            n = len(ids) // file.length
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * file.length)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids.astype(np.int32), mask, last)]
            start = shard.start + file.length * np.arange(at, at + n)
            columns = [pa.array([shard.name] * n), pa.array(start, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "start", "ids", "mask", "last"])
            at += n

    @staticmethod
    def _documents(shard: _ShardToRead, file: SequenceFile, listed: str) -> Iterator[pa.RecordBatch]:
        """Documents end where ``last`` says so; the list of documents must agree."""
        index = _open(*_place(listed))
        documents = (row for i in range(index.num_record_batches) for row in zip(*(c.to_pylist() for c in index.get_batch(i).columns)))
        start, open_ids = 0, []
        for ids, mask, last in file.runs():
            data, rows, at = ids.astype("<u4").tobytes(), [], 0
            for end in (np.flatnonzero(last) + 1).tolist():
                whole = b"".join([*open_ids, data[4 * at : 4 * end]])
                doc_id, said = next(documents, (None, None))
                if said != start:
                    raise ValueError(f"{listed}: document {doc_id} starts at {said}, the masks say {start}")
                rows.append((doc_id, shard.start + start, len(whole) // 4, whole))
                start, at, open_ids = start + len(whole) // 4, end, []
            open_ids.append(data[4 * at : 4 * int(mask.sum())])
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])
        if start != shard.tokens or next(documents, None) is not None or any(open_ids):
            raise ValueError(f"{listed}: the masks end after {start} of {shard.tokens} ids")


class TokenSequences(DataSource):
    """``path``; writing: ``length``, ``narrow``, ``tokenizer``, ``end_id``; reading: ``view`` (``documents`` or ``sequences``)."""

    VIEWS = {
        "documents": "doc_id long, start long, n_tokens long, ids binary",
        "sequences": "shard string, start long, ids array<int>, mask array<boolean>, last array<boolean>",
    }

    @classmethod
    def name(cls) -> str:
        return "token_sequences"

    def schema(self) -> str:
        return self.VIEWS[self.options.get("view", "documents")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("view", "documents"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        o = self.options
        return _Writer(o["path"], int(o["length"]), o["narrow"] == "true", o.get("tokenizer"), int(o.get("end_id", END_ID)), overwrite)


def _write(rows: DataFrame, path: str, length: int, overwrite: bool, **options: str) -> None:
    if length % 8:
        raise ValueError("a sequence has a multiple of eight ids")
    rows.sparkSession.dataSource.register(TokenSequences)
    writer = rows.write.format("token_sequences").option("path", path).option("length", length).options(**options)
    writer.mode("overwrite" if overwrite else "append").save()


def write(encoded: DataFrame, path: str, length: int = LENGTH, vocabulary: int | None = None, overwrite: bool = False) -> None:
    """Write ``doc_id`` and ``ids`` (little-endian 32-bit, one at least) in their order as a table of sequences of ``length``.

    A partition is a shard; empty ones have none, and a table without documents has an empty manifest. ``vocabulary`` is the number of ids there are, if known. Where
    ``path`` holds a table, ``overwrite`` replaces it at the moment its manifest is replaced; without it, writing fails.
    """
    narrow = vocabulary is not None and vocabulary <= 1 << 16
    _write(encoded.select("doc_id", "ids"), path, length, overwrite, narrow=str(narrow).lower())


def write_texts(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, overwrite: bool = False
) -> None:
    """Encode texts, ``end_id`` after each, and write them in ascending order of ids over all shards and within each.

    Null ids come last; rows of one id are dealt and ordered by a hash of their text and, where they repeat, by their place in the
    input, so no id fills a partition by itself. Null text counts as empty; bytes that are no UTF-8 become U+FFFD. Texts are shuffled once, before they
    are encoded by the tasks that write. ``tokenizer`` is a file's path on the workers. Other columns are not read.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab().values()) + 1
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text).withColumn("row", F.monotonically_increasing_id())
    order = F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("row").asc()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    narrow = max(vocabulary, end_id + 1) <= 1 << 16
    _write(dealt, path, length, overwrite, narrow=str(narrow).lower(), tokenizer=tokenizer, end_id=str(end_id))


def read(spark: SparkSession, path: str, view: str = "documents") -> DataFrame:
    """What the files hold: ``doc_id``, ``start``, ``n_tokens``, ``ids`` a document, or ``shard``, ``start``, ``ids``, ``mask``, ``last`` a sequence.

    ``start`` counts the ids of documents before, over all shards; padding does not count.
    """
    spark.dataSource.register(TokenSequences)
    return spark.read.format("token_sequences").option("path", path).option("view", view).load()


def op12_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, written to the shared folder and read back; the contract's columns."""
    path = f"{shared_dir(spark)}/siltstone/token-files-{uuid.uuid4().hex}"
    write_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer or default_tokenizer())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
