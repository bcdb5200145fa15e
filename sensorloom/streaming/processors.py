"""Stateful processors of one session each: named state variables, values that expire, registered timers.

They run by ``transformWithStateInPandas``, which keeps state in RocksDB; set
``PROVIDER`` in the session before a query starts, as ``replayed`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sensorloom.storage import shared_folder
from sensorloom.streaming import sessions

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Windows(StatefulProcessor):
    """A session's state: how far each stream has come, and its open windows' numbers, rows and sums.

    A window closes as ``drained`` when all streams have passed its end.  A timer
    closes those that the leading stream has passed as ``stalled``, ``grace_ms``
    after the last row; another, ``idle_ms`` after it, closes all as ``idle`` and
    clears the state.  Without ``idle_ms`` there are no timers.  Each variable of a
    state is a message between Python and the JVM, so all is one value, read and
    written once for a session's rows.
    """

    def __init__(self, streams: int, width_us: int, grace_ms: int, idle_ms: int | None):
        self.streams, self.width_us, self.grace_ms, self.idle_ms = streams, width_us, grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "tops array<long>, closed long, idle_at long, numbers array<long>, ns array<long>, totals array<double>")

    def _update(self, tops: list[int], closed: int, idle_at: int, windows: dict[int, tuple[int, float]]) -> None:
        self.state.update((tops, closed, idle_at, list(windows), [n for n, _ in windows.values()], [x for _, x in windows.values()]))

    @staticmethod
    def _closed(key: tuple, windows: dict[int, tuple[int, float]], through: int, reason: str) -> Iterator[pd.DataFrame]:
        numbers = sorted(w for w in windows if w <= through)
        if numbers:
            yield pd.DataFrame([(key[0], w, *windows.pop(w), reason) for w in numbers], columns=["session", "window", "n", "total", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        tops, closed, _, *open_ = known or ([-1] * self.streams, -1, -1, [], [], [])
        tops, windows = list(tops), {w: (n, x) for w, n, x in zip(*open_, strict=True)}
        for batch in rows:
            if batch["timestamp_us"].hasnans:
                batch = batch.dropna(subset="timestamp_us")
            at, values = batch["timestamp_us"].to_numpy(np.int64), batch["value"].to_numpy(float)
            streams = batch["stream"].to_numpy()
            for s in range(self.streams):
                tops[s] = max(tops[s], int(at[streams == s].max(initial=-1)))
            numbers, of = np.unique(at // self.width_us, return_inverse=True)
            counts, sums = np.bincount(of).tolist(), np.bincount(of, np.where(np.isnan(values), 0, values)).tolist()
            for w, n, total in zip(numbers.tolist(), counts, sums, strict=True):
                if w > closed:  # rows of closed windows are late and count no more
                    before = windows.get(w, (0, 0.0))
                    windows[w] = before[0] + n, before[1] + total
        drained = max(closed, min(tops) // self.width_us - 1)
        yield from self._closed(key, windows, drained, "drained")
        idle_at = -1
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            now = timerValues.getCurrentProcessingTimeInMs()
            idle_at = now + self.idle_ms
            self.handle.registerTimer(idle_at)
            if max(tops) // self.width_us - 1 > drained:
                self.handle.registerTimer(now + self.grace_ms)
        self._update(tops, drained, idle_at, windows)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tops, closed, idle_at, *open_ = self.state.get()
        windows = {w: (n, x) for w, n, x in zip(*open_, strict=True)}
        if expiredTimerInfo.getExpiryTimeInMs() >= idle_at:
            yield from self._closed(key, windows, 1 << 62, "idle")
            self.state.clear()
            return
        through = max(closed, max(tops) // self.width_us - 1)
        yield from self._closed(key, windows, through, "stalled")
        self._update(list(tops), through, idle_at, windows)

    def close(self) -> None:
        pass


class LateMarks(StatefulProcessor):
    """The last time of a session, which expires ``idle_ms`` after it was set."""

    def __init__(self, period_us: int, idle_ms: int | None):
        self.period_us, self.idle_ms = period_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last_us long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        marked, last = sessions.mark_late(pd.concat(list(rows)).sort_values("arrival", ignore_index=True), last, self.period_us)
        self.last.update((last,))
        yield marked[["session", "arrival", "timestamp_us", "value", "late", "gap"]]

    def close(self) -> None:
        pass


class States(StatefulProcessor):
    """The state machine of a session, which expires ``idle_ms`` after its last row."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", "state string, since_us long, contact_us long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        machine = sessions.Machine(*self.machine.get()) if self.machine.exists() else sessions.Machine()
        yield sessions.session_states(pd.concat(list(rows)).sort_values(sessions.IN_ORDER), machine)
        self.machine.update(astuple(machine))

    def close(self) -> None:
        pass


def processed(rows: DataFrame, processor: StatefulProcessor, schema: str, idle_ms: int | None) -> DataFrame:
    """Without ``idle_ms`` nothing expires and a query may end by itself; with it, wall time moves the state."""
    return rows.groupBy("session").transformWithStateInPandas(processor, schema, "Append", "None" if idle_ms is None else "ProcessingTime")


def two_stream_windows(left: DataFrame, right: DataFrame, ts: str, value: str, width: str, delay: str) -> DataFrame:
    """Means by event-time window over two inputs (with equal columns), each with its own watermark.

    The watermark of the union is the slower input's (``multipleWatermarkPolicy``
    min, Spark's default), so a window closes when both inputs have passed its end."""
    timed = lambda d: d.withColumn("_t", F.timestamp_micros(ts)).withWatermark("_t", delay)
    both = timed(left).unionByName(timed(right))
    return both.groupBy(F.window("_t", width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def replayed(stream: DataFrame, name: str, timeout_s: int = 3600) -> DataFrame:
    """All that a stream of files gives when run to its end, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"{name} did not end in {timeout_s} s")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
