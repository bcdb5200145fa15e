"""Stateful streams: late samples, stream watermarks, the measurement states.

The step functions are plain Python over one session's small state, so a batch
of a session and a stream of it give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Times of the states in milliseconds.
CONTACT_STABLE_MS, CONTACT_TIMEOUT_MS, WARMUP_MS, MEASURE_MS, HOLD_MS = 500, 120_000, 3_000, 60_000, 45_000

#: Wall time without a row after which a session's state is let go.
IDLE_MS = 3_600_000

LATE_SCHEMA = "session long, arrival long, timestamp_us long, value double, late boolean, gap boolean"
STATE_SCHEMA = "session long, timestamp_us long, state string"


def mark_late(rows: pd.DataFrame, last_us: int | None, period_us: int) -> tuple[pd.DataFrame, int | None]:
    """Rows in order of arrival; ``late`` is not after the last time, and
    late rows and jumps alike are a ``gap``.  Late rows don't move the time."""
    running = rows["timestamp_us"].cummax()
    before = running.shift(1)
    if last_us is not None:
        before = before.fillna(last_us).clip(lower=last_us)
    late = (rows["timestamp_us"] <= before) & before.notna()
    gap = late | ((rows["timestamp_us"] - before) > 1.5 * period_us)
    top = int(running.iloc[-1]) if len(rows) else last_us
    return rows.assign(late=late, gap=gap & before.notna()), top if last_us is None else max(top, last_us)


def late_marked_stream(samples: DataFrame, period_us: int, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``samples`` (session, arrival, timestamp_us, value) as a stream.

    ``arrival`` numbers rows as they came, such as a source's offset: a
    micro-batch's shuffle keeps no order, so rows are put into that one.  A
    session without a row for ``idle_ms`` is forgotten and begins anew.
    """
    from sensorloom.streaming import processors

    return processors.processed(samples, processors.LateMarks(period_us, idle_ms), LATE_SCHEMA, idle_ms)


@dataclass
class Machine:
    """The state of one session and when it began."""

    state: str = "idle"
    since_us: int = 0
    contact_us: int = -1

    def step(self, t: int, contact: bool, start: bool) -> str:
        self.contact_us = (t if self.contact_us < 0 else self.contact_us) if contact else -1
        waited = (t - self.since_us) / 1000
        if self.state == "idle" and start:
            self._go("contact_wait", t)
        elif self.state == "contact_wait":
            if self.contact_us >= 0 and (t - self.contact_us) / 1000 >= CONTACT_STABLE_MS:
                self._go("warmup", t)
            elif waited >= CONTACT_TIMEOUT_MS:
                self._go("error", t)
        elif self.state == "warmup" and waited >= WARMUP_MS:
            self._go("measuring", t)
        elif self.state == "measuring" and waited >= MEASURE_MS:
            self._go("result", t)
        elif self.state in ("result", "error") and waited >= HOLD_MS:
            self._go("idle", t)
        return self.state

    def _go(self, state: str, t: int) -> None:
        self.state, self.since_us = state, t


def session_states(rows: pd.DataFrame, machine: Machine) -> pd.DataFrame:
    """The state after each row (timestamp_us, contact, start), in order."""
    states = [machine.step(t, c, s) for t, c, s in zip(rows["timestamp_us"].tolist(), rows["contact"].tolist(), rows["start"].tolist(), strict=True)]
    return rows.assign(state=states)[["session", "timestamp_us", "state"]]


IN_ORDER = ["timestamp_us", "sequence"]


def state_batch(events: DataFrame) -> DataFrame:
    """The states of ``events`` (session, timestamp_us, sequence, contact, start); ``sequence`` orders rows of one time."""
    return events.groupBy("session").applyInPandas(lambda rows: session_states(rows.sort_values(IN_ORDER), Machine()), STATE_SCHEMA)


def state_stream(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``state_batch`` as a stream; a session without a row for ``idle_ms`` is forgotten and begins anew."""
    from sensorloom.streaming import processors

    return processors.processed(events, processors.States(idle_ms), STATE_SCHEMA, idle_ms)


#: Wall time that a window waits for a stream that has stalled, after another has passed its end.
GRACE_MS = 160

WINDOW_SCHEMA = "session long, window long, n long, total double, reason string"


def closed_windows_stream(samples: DataFrame, streams: int, width_us: int, grace_ms: int = GRACE_MS, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``samples`` (session, stream from 0, timestamp_us, value) as windows of each
    session: one closes when all streams have reached its end (``drained``), or, if one
    stalls, ``grace_ms`` of wall time after the last row (``stalled``: all that the
    leading stream has passed).  After ``idle_ms`` without a row the rest closes
    (``idle``) and the session's state is cleared."""
    from sensorloom.streaming import processors

    return processors.processed(samples, processors.Windows(streams, width_us, grace_ms, idle_ms), WINDOW_SCHEMA, idle_ms)


def windowed_means(samples: DataFrame, ts: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    """Means by event-time window with a watermark; the stream's
    checkpoint makes each result at-least-once for a sink keyed by window."""
    timed = samples.withColumn("_t", F.timestamp_micros(ts)).withWatermark("_t", delay)
    return timed.groupBy(F.window("_t", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
