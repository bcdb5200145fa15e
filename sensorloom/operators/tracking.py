"""Tracks of boxes over the frames of a session, in a batch or a stream.

Frame by frame: open tracks are predicted, boxes within a gate of a prediction
are candidates, the cheapest assignment pairs them, pairs update their track,
boxes that are left open tracks, and tracks that miss too many frames close.
The step is plain numpy on one session's few open tracks; sessions spread over
the cluster, and a stream keeps the open tracks as a session's state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from sensorloom.operators.blocks import over_runs
from sensorloom.operators.detections import BOX, assignment

TRACKED = "frame long, track long, box long, x double, y double, opened boolean"


@dataclass
class Settings:
    """The gate in multiples of the predicted deviation, frames that a track may miss, and the deviations of a step's
    push, of a box's centre and of a new track's speed."""

    gate: float = 3.0
    most_missed: int = 2
    push: float = 1.0
    seen: float = 2.0
    speed: float = 5.0


@dataclass
class Tracker:
    """A session's open tracks: their numbers, states (x, y and their speeds), the covariance of place and speed, which both
    axes share, and the frames that they have missed."""

    settings: Settings
    following: int = 0
    frame: int | None = None
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    states: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    missed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _predict(self, steps: int) -> None:
        """V17 for a constant speed with random pushes, ``steps`` frames on."""
        q = self.settings.push**2
        for _ in range(steps):
            self.states[:, :2] += self.states[:, 2:]
            pp, pv, vv = self.spread.T
            self.spread = np.stack([pp + 2 * pv + vv + q / 4, pv + vv + q / 2, vv + q], 1)

    def step(self, frame: int, ids: np.ndarray, boxes: np.ndarray) -> list[tuple]:
        """A row for each box: frame, track, box, the track's place after it, and whether the box opened the track.
        Boxes are taken in the order of their corners, so their order in the frame doesn't matter."""
        s = self.settings
        order = np.lexsort((ids, *boxes.T[::-1])) if len(boxes) > 1 else np.arange(len(boxes))
        ids, centres = ids[order], (boxes[order, :2] + boxes[order, 2:]) / 2
        gone = 0 if self.frame is None else frame - self.frame
        self._predict(min(gone, s.most_missed + 1))
        self.missed = self.missed + max(0, gone - 1)
        self._keep(self.missed <= s.most_missed)
        self.frame = frame
        off = centres[None] - self.states[:, None, :2]
        room = self.spread[:, 0] + s.seen**2
        far = (off**2).sum(2) / room[:, None]
        allowed = far <= s.gate**2
        at, box = _paired(far, allowed, s.gate**2)
        gain = self.spread[at, :2] / room[at, None]
        self.states[at, :2] += gain[:, :1] * off[at, box]
        self.states[at, 2:] += gain[:, 1:] * off[at, box]
        pp, pv, vv = self.spread[at].T
        self.spread[at] = np.stack([pp * (1 - gain[:, 0]), pv * (1 - gain[:, 0]), vv - gain[:, 1] * pv], 1)
        self.missed = self.missed + 1
        self.missed[at] = 0
        rows = [(frame, t, b, x, y, False) for t, b, (x, y) in zip(self.ids[at].tolist(), ids[box].tolist(), self.states[at, :2].tolist(), strict=True)]
        free = np.ones(len(ids), bool)
        free[box] = False
        new = np.flatnonzero(free)
        numbers = self.following + np.arange(len(new))
        self.following += len(new)
        self._keep(self.missed <= s.most_missed)
        if not len(new):
            return rows
        states, spread = np.zeros((len(new), 4)), np.empty((len(new), 3))
        states[:, :2], spread[:] = centres[new], (s.seen**2, 0.0, s.speed**2)
        self.ids = np.concatenate([self.ids, numbers])
        self.states = np.concatenate([self.states, states])
        self.spread = np.concatenate([self.spread, spread])
        self.missed = np.concatenate([self.missed, np.zeros(len(new), np.int64)])
        return rows + [(frame, t, b, x, y, True) for t, b, (x, y) in zip(numbers.tolist(), ids[new].tolist(), centres[new].tolist(), strict=True)]

    def _keep(self, which: np.ndarray) -> None:
        if which.all():
            return
        self.ids, self.states, self.spread, self.missed = self.ids[which], self.states[which], self.spread[which], self.missed[which]

    def run(self, rows: pd.DataFrame) -> list[tuple]:
        """The rows of some frames (frame, id and the corners), in order of the frames; a frame before the last is late and left out."""
        return self.run_sorted(*_arrays(rows.sort_values("frame", kind="stable")))

    def run_sorted(self, frames: np.ndarray, ids: np.ndarray, boxes: np.ndarray) -> list[tuple]:
        """``run`` of rows that are in order of their frames."""
        found: list[tuple] = []
        edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(frames)] if len(frames) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            frame = int(frames[a])
            if self.frame is None or frame > self.frame:
                found += self.step(frame, ids[a:b], boxes[a:b])
        return found

    def packed(self) -> tuple:
        return self.following, self.frame, self.ids.tolist(), self.states.ravel().tolist(), self.spread.ravel().tolist(), self.missed.tolist()

    @classmethod
    def unpacked(cls, settings: Settings, row: tuple) -> Tracker:
        following, frame, ids, states, spread, missed = row
        return cls(settings, following, frame, np.array(ids, np.int64), np.array(states, float).reshape(-1, 4), np.array(spread, float).reshape(-1, 3), np.array(missed, np.int64))


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["frame"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), rows[BOX].to_numpy(float)


def _paired(far: np.ndarray, allowed: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Tracks and their boxes: as many allowed pairs as can be, of least total cost.  Where no two allowed pairs share a
    track or a box, they are all of them; otherwise an assignment tells, in which a pair that isn't allowed costs more
    than all the others could."""
    at, box = np.nonzero(allowed)
    if len(at) < 2 or (len(set(at.tolist())) == len(at) and len(set(box.tolist())) == len(box)):
        return at, box
    of = assignment(np.where(allowed, far, (top + 1) * (min(far.shape) + 1)))
    at = np.flatnonzero(of >= 0)
    at = at[allowed[at, of[at]]]
    return at, of[at]


def _columns(keys: Sequence[str], found: list[tuple], first: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=[c.split()[0] for c in TRACKED.split(", ")])
    for k in reversed(list(keys)):
        out.insert(0, k, first[k].iloc[0])
    return out


def tracked(boxes: DataFrame, keys: Sequence[str], settings: Settings | None = None) -> DataFrame:
    """V15 to V17 over frames: keys, frame, track, box (its id), the track's place x, y and opened, for each box of
    ``boxes`` (keys, frame, id, x1, y1, x2, y2).

    A session is one task's work, as each frame needs the tracks of the one before.  Rows with a null frame, id or
    corner take no part; frames without boxes count as missed; an empty table gives an empty result."""
    settings = settings or Settings()
    rows = boxes.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX]).dropna(subset=["frame", "id", *BOX])
    schema = ", ".join([*[f"`{k}` {t}" for k, t in rows.dtypes if k in keys], TRACKED])
    kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.bool_()]

    def run(table: pa.Table, edges: np.ndarray) -> pa.Table:
        frames, ids, boxes = _arrays(table.select(["frame", "id", *BOX]).to_pandas())
        found, sizes = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = Tracker(settings).run_sorted(frames[a:b], ids[a:b], boxes[a:b])
            found += own
            sizes.append(len(own))
        out = table.select(list(keys)).take(pa.array(np.repeat(edges[:-1], sizes)))
        for name, kind, values in zip(TRACKED.split(", "), kinds, zip(*found, strict=True), strict=True):
            out = out.append_column(name.split()[0], pa.array(values, kind))
        return out

    return over_runs(rows, keys, ["frame"], run, schema)


class Tracks(StatefulProcessor):
    """``tracked`` as a stream by session: the open tracks are its state, which expires after ``idle_ms``.  A micro-batch
    must hold whole frames, in order of the frames over batches."""

    def __init__(self, settings: Settings, idle_ms: int | None):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "following long, frame long, ids array<long>, states array<double>, spread array<double>, missed array<long>"
        self.open = handle.getValueState("open", schema, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tracker = Tracker.unpacked(self.settings, tuple(self.open.get())) if self.open.exists() else Tracker(self.settings)
        part = pd.concat(list(rows))
        found = tracker.run(part)
        self.open.update(tracker.packed())
        if found:
            yield _columns(["session"], found, part)

    def close(self) -> None:
        pass


def tracked_stream(boxes: DataFrame, settings: Settings | None = None, idle_ms: int | None = 3_600_000) -> DataFrame:
    """``tracked`` over a stream of (session, frame, id, x1, y1, x2, y2)."""
    from sensorloom.streaming import processors

    return processors.processed(boxes, Tracks(settings or Settings(), idle_ms), f"session long, {TRACKED}", idle_ms)
