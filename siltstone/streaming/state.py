"""Order-dependent operators: as folds over sorted groups, and as streams with keyed state.

Batch folds stream a key's rows through a small state (rows dealt by key, sorted within partitions), so a key may hold any
number of rows. The streams use the same step functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import delete, new_folder

_CENT = Decimal("0.01")

# Failures that open a circuit, seconds that it stays open (and that failures are remembered), errors that say nothing of the provider.
BREAKER_FAILS, BREAKER_OPEN, RATE_OPEN = 3, 900, 60
CONTENT_ERRORS = ("refusal", "empty", "aborted", "parse", "no_key", "no_model")
#: Seconds that changes of an item wait for others.
DEBOUNCE = 30


def limiter_run(times: list[float], seconds: np.ndarray, window: float, limit: int) -> tuple[list[float], np.ndarray]:
    """(accepted times that still count, which of the ascending ``seconds`` are let through): ``limit`` within ``window`` seconds.

    Refused attempts do not count, so it goes from one accepted time straight to the next that can be.
    """
    allowed = np.zeros(len(seconds), bool)
    at = 0
    while at < len(seconds) and limit > 0:
        times = [x for x in times if seconds[at] - x < window]
        if len(times) >= limit:
            at = max(at + 1, int(np.searchsorted(seconds, min(times) + window)))
            continue
        times, allowed[at] = [*times, float(seconds[at])], True
        at += 1
    return times, allowed


class Breaker(NamedTuple):
    """Failures so far, until when the circuit is open, when all of it is forgotten."""

    fails: int = 0
    until: float = 0.0
    expires: float = 0.0


def breaker_step(state: Breaker, now: float, ok: bool | None, error: str | None = "") -> tuple[Breaker, bool]:
    """State after an attempt, and whether it was let through; a refused attempt changes nothing.

    A success clears the state. A failure counts unless its code (what stands before the first colon) is one of ``CONTENT_ERRORS``, and is remembered for
    ``BREAKER_OPEN`` seconds. An auth error opens the circuit at once, a rate limit for ``RATE_OPEN`` seconds, any third failure for ``BREAKER_OPEN``. A null
    ``ok`` is a failure.
    """
    if now >= state.expires:
        state = Breaker()
    if now < state.until:
        return state, False
    if ok:
        return Breaker(), True
    code = (error or "").split(":", 1)[0].strip()
    if code in CONTENT_ERRORS:
        return state, True
    fails = state.fails + 1
    open_for = BREAKER_OPEN if code == "auth" else RATE_OPEN if code == "rate_limit" else BREAKER_OPEN if fails >= BREAKER_FAILS else 0
    return Breaker(fails, now + open_for if open_for else 0.0, now + BREAKER_OPEN), True


def breaker_run(state: Breaker, seconds: list[float], oks: list[bool | None], errors: list[str | None]) -> tuple[Breaker, list[bool]]:
    through = []
    for now, ok, error in zip(seconds, oks, errors):
        state, passed = breaker_step(state, now, ok, error)
        through.append(passed)
    return state, through


def average_step(last: float | None, value: float, keep: float = 0.7) -> float:
    """Moving average, rounded to cents at each step; it starts with the first value."""
    now = value if last is None else last * keep + value * (1 - keep)
    return float(Decimal(repr(now)).quantize(_CENT, ROUND_HALF_UP)) if math.isfinite(now) else now


def fold_runs(rows: DataFrame, key: str, order: list[str], run: Callable, start: Callable, out: str, kind: T.DataType) -> DataFrame:
    """``rows`` with ``out``: for each stretch of rows of one key, in ``order``, what ``run(state, columns)`` -> (state, values) says.

    Rows are dealt by ``key`` and sorted, and pass through in Arrow batches, so a key may hold any number of rows; ``columns`` has the stretch as
    Arrow arrays by name. The state starts anew with each key; a null key is a key like any other.
    """
    schema = T.StructType([*rows.schema, T.StructField(out, kind)])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, began = None, None, False
        for batch in batches:
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            values = []
            for a, b in zip(edges, edges[1:]):
                some = batch.slice(a, b - a)
                k = some.column(key)[0].as_py()
                if not began or not (k == now or (k != k and now != now)):
                    now, state, began = k, start(), True
                state, found = run(state, dict(zip(some.schema.names, some.columns)))
                values.append(pa.array(found, arrow.field(out).type))
            if values:
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.concat_arrays(values)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), *order).mapInArrow(work, schema)


def _seconds(columns: dict) -> np.ndarray:
    return columns["second"].to_numpy(zero_copy_only=False).astype(float)


def limited(events: DataFrame, window_s: float, limit: int) -> DataFrame:
    """``allowed`` per event (``key``, ``second``, ``event_id``): refused attempts do not count."""
    run = lambda times, c: limiter_run(times, _seconds(c), window_s, limit)
    return fold_runs(events, "key", ["second", "event_id"], run, list, "allowed", T.BooleanType())


def circuit(calls: DataFrame) -> DataFrame:
    """``let_through`` per call (``key``, ``second``, ``event_id``, ``ok``, ``error``)."""
    run = lambda s, c: breaker_run(s, _seconds(c).tolist(), c["ok"].to_pylist(), c["error"].to_pylist())
    return fold_runs(calls, "key", ["second", "event_id"], run, Breaker, "let_through", T.BooleanType())


def debounced(changes: DataFrame, seconds: float = DEBOUNCE) -> DataFrame:
    """``key``, ``event_id``, ``action``, ``due``: what becomes of changes (``key``, ``second``, ``event_id``, ``action``).

    A delete is due at once. An upsert is due after ``seconds``; upserts of the key that come until then are part of it (it has the first one's id). A change
    at the very second it is due starts a new one. A delete does not take back what waits.
    """
    upserts = limited(changes.where("action <> 'delete'"), seconds, 1).where("allowed")
    due = F.col("second") + F.when(F.col("action") == "delete", 0).otherwise(seconds)
    return changes.where("action = 'delete'").unionByName(upserts.drop("allowed")).select("key", "event_id", "action", due.cast("double").alias("due"))


def session_stream(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of a stream of ``user_id``, ``ts``: a gap closes one.

    In append mode rows later than ``late`` are dropped by the watermark, and a session comes out once the watermark passes its end;
    complete mode keeps all and gives open sessions too.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
    )


def applied_changes(changes: DataFrame) -> DataFrame:
    """``item``, ``action``, ``newest``, ``changes``: the last change of each item of a stream of ``item``, ``event_id``, ``action`` (for complete mode)."""
    return changes.groupBy("item").agg(F.max_by("action", "event_id").alias("action"), F.max("event_id").alias("newest"), F.count("*").alias("changes"))


def as_stream(rows: DataFrame, by: Column, batches: int) -> DataFrame:
    """``rows`` as a stream that brings them in ``batches`` micro-batches: those of ``by`` = 0 first, then 1, and so on."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "batches")
    for i in range(batches):
        rows.where(by == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def appended(loads: list[DataFrame], kind: str = "parquet") -> DataFrame:
    """Loads of one schema appended one after the other to a log under the folder the executors share, and the log as it is then."""
    spark = loads[0].sparkSession
    path = new_folder(spark, "log")
    for load in loads:
        load.write.mode("append").format(kind).save(path)
    return spark.read.schema(loads[0].schema).format(kind).load(path)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into Parquet under the folder the executors share, and read that back.

    In ``complete`` mode each batch writes the whole result and the last one counts, so groups that are still open when the input
    ends are part of it.
    """
    spark = stream.sparkSession
    root = new_folder(spark, "stream")
    out, last = f"{root}/out", [None]
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True)

    def whole(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")
        last[0] = f"{out}/{batch}"

    writer = writer.foreachBatch(whole) if mode == "complete" else writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    delete(spark, f"{root}/checkpoint")
    if mode != "complete":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(stream.schema).parquet(last[0]) if last[0] else spark.createDataFrame([], stream.schema)
