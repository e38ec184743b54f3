"""Streams whose state is kept by key: rate limit, circuit breaker, moving average, debounced changes, answers checked as they grow.

Each does to a stream what its batch fold in ``state`` does to a table. Rows of a key are taken in order of time within a micro-batch; state lives in the
state store, with timers on event time that let it go, and survives a lost executor through the checkpoint. The streams need the RocksDB
provider (``with_rocksdb``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.redaction import check_facts
from . import state as st

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and several state variables need, for the streams that are started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A micro-batch's rows of one key; how many they are is bounded by what a trigger reads."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _values(column: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in column]


class _Breaker(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("breaker", "fails int, until double, expires double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = _in_order(rows, ["second", "event_id"])
        old = st.Breaker(*self._state.get()) if self._state.exists() else st.Breaker()
        new, through = st.breaker_run(old, some["second"].astype(float).tolist(), _values(some["ok"]), _values(some["error"]))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if new == st.Breaker():
            self._state.clear()
        else:
            self._state.update(tuple(new))
            self._handle.registerTimer(int(new.expires * 1000))
        yield pd.DataFrame({"key": [key[0]] * len(some), "event_id": some["event_id"].to_numpy(), "let_through": through})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def circuit_stream(calls: DataFrame, late: str = "1 minute") -> DataFrame:
    """``key``, ``event_id``, ``let_through`` of a stream of ``key`` (long), ``ts``, ``second``, ``event_id``, ``ok``, ``error``: ``state.circuit``.

    The state of a key goes when nothing of it counts any more: at a success, or ``BREAKER_OPEN`` seconds of event time after its last failure.
    """
    return calls.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        _Breaker(), "key long, event_id long, let_through boolean", "Append", "EventTime"
    )


#: Keys of a limited stream are dealt to so many groups; a group's state is one value.
GROUPS = 512


class _Limiter(StatefulProcessor):
    """Limits for a group of keys: a call and a read of the state a group and micro-batch, not a key."""

    def __init__(self, window_s: float, limit: int):
        self._window, self._limit = window_s, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("times", "keys array<string>, times array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows), ignore_index=True)
        names = pa.array(some["key"], pa.string(), from_pandas=True).dictionary_encode(null_encoding="encode")
        of, seconds, ids = names.indices.to_numpy(), some["second"].to_numpy(float), some["event_id"].to_numpy()
        order = np.lexsort((ids, seconds, of))
        of, seconds, ids = of[order], seconds[order], ids[order]
        keys, times = self._state.get() if self._state.exists() else ((), ())
        seen = timerValues.getCurrentWatermarkInMs()
        held = {k: list(ts) for k, ts in zip(keys, times) if int((max(ts) + self._window) * 1000) > seen}  # the others are past their window
        allowed, names = np.zeros(len(of), bool), names.dictionary.to_pylist()
        cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for first, last in zip(cuts, [*cuts[1:], len(of)]):
            k = names[of[first]]
            left, allowed[first:last] = st.limiter_run(held.get(k, []), seconds[first:last], self._window, self._limit)
            if left:
                held[k] = left
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if held:
            self._state.update((list(held), list(held.values())))
            self._handle.registerTimer(max(int((max(ts) + self._window) * 1000) for ts in held.values()))
        else:
            self._state.clear()
        yield pd.DataFrame({"key": pd.Series([names[i] for i in of.tolist()], dtype=object), "event_id": ids, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, window_s: float, limit: int, late: str = "1 minute") -> DataFrame:
    """``key``, ``event_id``, ``allowed`` of a stream of ``key`` (a type that can be read back from a string), ``ts``, ``second``, ``event_id``: ``state.limited``.

    At most ``limit`` times a key are kept; they go when their group is read again a window of event time after the last of them, or all at once when that is past for
    every key of the group. Keys are dealt to ``GROUPS`` groups, so the calls and reads of a micro-batch do not grow with the keys. With a limit of one this finds
    replays: what is not allowed came before within the window.
    """
    kind = events.schema["key"].dataType.simpleString()
    named = events.withColumn("key", F.col("key").cast("string"))  # in pandas, longs beside a null would be floats
    dealt = named.withColumn("__group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).withWatermark("ts", late)
    found = dealt.groupBy("__group").transformWithStateInPandas(_Limiter(window_s, limit), "key string, event_id long, allowed boolean", "Append", "EventTime")
    return found.withColumn("key", F.col("key").cast(kind))


class _Average(StatefulProcessor):
    def __init__(self, keep: float):
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("average", "ema double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = _in_order(rows, ["second", "event_id"])
        last, n = self._state.get() if self._state.exists() else (None, 0)
        after = []
        for value in some["value"].astype(float).tolist():
            last, n = st.average_step(last, value, self._keep), n + 1
            after.append((key[0], n, last))
        self._state.update((last, n))
        ids = some["event_id"].to_numpy()
        yield pd.DataFrame(after, columns=["key", "nth", "ema"]).assign(event_id=ids)[["key", "event_id", "nth", "ema"]]

    def close(self) -> None:
        pass


def average_stream(values: DataFrame, keep: float = 0.7) -> DataFrame:
    """``key``, ``event_id``, ``nth``, ``ema`` after each row of a stream of ``key`` (string), ``second``, ``event_id``, ``value``. One number a key is kept, for ever."""
    return values.groupBy("key").transformWithStateInPandas(_Average(keep), "key string, event_id long, nth long, ema double", "Append", "None")


class _Debounce(StatefulProcessor):
    def __init__(self, seconds: float):
        self._wait = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getValueState("waiting", "event_id long, due double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting.get() if self._waiting.exists() else None
        before, out = waiting, []
        for r in _in_order(rows, ["second", "event_id"]).itertuples(index=False):
            if waiting is not None and r.second >= waiting[1]:  # it was due before this change, whatever the watermark has seen
                out.append((key[0], waiting[0], "upsert", float(waiting[1])))
                waiting = None
            if r.action == "delete":
                out.append((key[0], r.event_id, "delete", float(r.second)))
            elif waiting is None:
                waiting = (int(r.event_id), float(r.second) + self._wait)
        if waiting != before:
            if before is not None:
                self._handle.deleteTimer(int(before[1] * 1000))
            if waiting is None:
                self._waiting.clear()
            else:
                self._waiting.update(waiting)
                self._handle.registerTimer(int(waiting[1] * 1000))
        yield pd.DataFrame(out, columns=["key", "event_id", "action", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        event_id, due = self._waiting.get()
        self._waiting.clear()
        yield pd.DataFrame([(key[0], event_id, "upsert", due)], columns=["key", "event_id", "action", "due"])

    def close(self) -> None:
        pass


def debounced_stream(changes: DataFrame, seconds: float = st.DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """``state.debounced`` on a stream of ``key`` (string), ``ts``, ``second``, ``event_id``, ``action``: deletes come out at once, upserts when they are due.

    What waits comes out by a timer when the watermark passes, without another change of its key; what is not due when the stream ends still waits in the
    checkpoint.
    """
    return changes.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        _Debounce(seconds), "key string, event_id long, action string, due double", "Append", "EventTime"
    )


class _GrowingAnswer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._answer = handle.getValueState("answer", "text string, aborted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, aborted = self._answer.get() if self._answer.exists() else ("", False)
        out = []
        for r in _in_order(rows, ["position"]).itertuples(index=False):
            if aborted:
                break
            text += r.delta or ""
            stable = text[: max(text.rfind(" "), text.rfind("\n"), 0)]
            ok, _, wrong, _ = check_facts(stable, r.facts)
            aborted = not ok
            out.append((key[0], int(r.position), "" if aborted else r.delta or "", aborted, wrong[0] if wrong else None))
        self._answer.update((text, aborted))
        yield pd.DataFrame(out, columns=["answer_id", "position", "shown", "aborted", "violation"])

    def close(self) -> None:
        pass


def checked_answers(deltas: DataFrame) -> DataFrame:
    """``answer_id``, ``position``, ``shown``, ``aborted``, ``violation``: pieces of answers as they may be shown.

    ``deltas`` is a stream of ``answer_id`` (long), ``position``, ``delta``, ``facts``. With every piece the answer so far is checked up to its last space or line end, so
    that a half-written amount is never judged. The piece that brings a violation is not shown, and nothing of the answer comes after it.
    """
    return deltas.groupBy("answer_id").transformWithStateInPandas(
        _GrowingAnswer(), "answer_id long, position long, shown string, aborted boolean, violation string", "Append", "None"
    )
