"""Binary logs as a Spark data source, ``sensor_log``: read in byte ranges, followed as a stream, written with commits.

A log is 28-byte frames (``logs.FRAME``), with damage anywhere.  A range may
begin in the middle of a frame: a good frame is one with the sync word and the
right checksum that doesn't overlap an earlier good one, so wherever two frames
are 28 bytes apart or more the later is good whatever came before.  A range is
read from far enough back to find such a place.  All other bytes come as rows
with a ``reason``; how they are cut depends on the bytes and on multiples of
CUT only, so rows are the same however a file is split.

Register it by ``spark.dataSource.register(LogSource)``.  Paths may be folders,
globs or files of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sensorloom.sources import logs

SIZE = logs.FRAME.itemsize
#: Bytes of a partition and of a step, ranges of bad bytes, and bytes that a step sees on both sides.
PARTITION_BYTES, STEP_BYTES, CUT, AROUND = 64 << 20, 4 << 20, 4096, 8192
#: Bytes at the end of a growing file in which the last good frame is looked for.
TAIL_BYTES = 1 << 16

SCHEMA = "path string, offset long, n_bytes int, reason string, " + logs.RECORDS
_FIELDS = {"schema": "i4", "record_type": "i4", "timestamp_us": "i8", "sequence": "i8", "value_a": "i4", "value_b": "i4", "flags": "i4"}


@dataclass
class Range(InputPartition):
    """Frames and bad bytes that begin in ``start`` to ``end`` of a file that counts as ``size`` bytes long.  ``clean``: no frame reaches over ``start``."""

    path: str
    start: int
    end: int
    size: int
    clean: bool = False

    def __hash__(self):
        return hash((self.path, self.start))


def files_of(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a folder, glob or file."""
    star = min((i for i in map(path.find, "*?[") if i >= 0), default=-1)
    base = path if star < 0 else path[: path.rfind("/", 0, star)]
    system, inner = fs.FileSystem.from_uri(base)
    prefix = base[: len(base) - len(inner)] if base.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    pattern = inner + path[len(base) :] if star >= 0 else None
    hidden = lambda p: any(part[0] in "._" for part in p[len(inner) :].split("/") if part)
    found = [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and not hidden(x.path)]
    return sorted((prefix + x.path, x.size) for x in found if pattern is None or fnmatch(x.path, pattern))


def _good(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sync word, and of frames with the right checksum, overlapping ones too."""
    low, high = logs.SYNC & 255, logs.SYNC >> 8
    sync = np.flatnonzero((data[:-1] == low) & (data[1:] == high))
    whole = sync[sync + SIZE <= len(data)]
    rows = np.lib.stride_tricks.sliding_window_view(data, SIZE)[whole] if len(whole) else np.zeros((0, SIZE), np.uint8)
    sums = rows[:, SIZE - 2].astype(np.uint16) | rows[:, SIZE - 1].astype(np.uint16) << 8
    return sync, whole[logs.crc16(rows[:, : SIZE - 2]) == sums]


def _apart(places: np.ndarray, first: int) -> tuple[np.ndarray, float]:
    """Those that stay if each must be SIZE after the last that stayed, and from which place on that is sure
    whatever is before ``first``."""
    if not len(places):
        return places, first
    settled = np.append(places[0] >= first + SIZE - 1, np.diff(places) >= SIZE)
    sure = places[np.argmax(settled)] if settled.any() else np.inf
    if settled[1:].all():
        return places, sure
    kept, last = [], -SIZE
    for p in places.tolist():
        if p >= last + SIZE or p == sure:
            kept.append(p)
            last = p
    return np.array(kept, np.int64), sure


def _step(read, at: Range, start: int, end: int) -> pa.RecordBatch:
    """The rows that begin in ``start`` to ``end``."""
    clean = at.clean and start == at.start
    back = AROUND
    while True:
        low = start if clean else max(0, start - back)
        high = min(at.size, end + AROUND)
        data = np.frombuffer(read(low, high - low), np.uint8)
        sync, good = _good(data)
        good, sure = _apart(good, -SIZE if clean or low == 0 else 0)
        if low == 0 or clean or sure + low <= start or not len(good) or good[0] + low >= start:
            break
        back *= 4  # frames overlap all the way back: look further
    # Bad bytes: what no good frame covers, cut at sync words, and at multiples of CUT more than a frame after a sync word.
    edges = np.concatenate([[0], np.stack([good, good + SIZE], 1).ravel(), [len(data)]])
    gaps = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b > a]
    pieces = []
    for a, b in gaps:
        words = sync[(sync >= a) & (sync < b)].tolist()
        at_sync = [a, *words] if not words or words[0] != a else words
        for p, q in zip(at_sync, [*at_sync[1:], b], strict=True):
            begins = p in words
            cuts = range(-(-(p + low + (SIZE if begins else 1)) // CUT) * CUT - low, q, CUT)
            bounds = [p, *cuts, q]
            pieces += [(x, y - x, ("checksum" if q - p >= SIZE else "torn") if begins and x == p else "no_sync") for x, y in zip(bounds, bounds[1:], strict=False) if y > x]
    mine = lambda p: start <= p + low < end
    bad = [(p + low, n, why) for p, n, why in pieces if mine(p)]
    good = good[(good + low >= start) & (good + low < end)]
    frames = np.lib.stride_tricks.sliding_window_view(data, SIZE)[good].copy().view(logs.FRAME).ravel() if len(good) else np.zeros(0, logs.FRAME)
    n = len(good) + len(bad)
    where = np.concatenate([good + low, np.array([b[0] for b in bad], np.int64)]).astype(np.int64)
    order = pa.array(np.argsort(where, kind="stable"))
    nothing = np.arange(n) >= len(good)
    column = lambda c, t: pa.array(np.concatenate([frames[c].astype(t), np.zeros(len(bad), t)]), mask=nothing)
    table = {
        "path": pa.array([at.path] * n, pa.string()),
        "offset": pa.array(where),
        "n_bytes": pa.array([SIZE] * len(good) + [b[1] for b in bad], pa.int32()),
        "reason": pa.array([None] * len(good) + [b[2] for b in bad], pa.string()),
        **{c: column(c, t) for c, t in _FIELDS.items()},
    }
    return pa.RecordBatch.from_pydict(table).take(order)


def read_range(at: Range) -> Iterator[pa.RecordBatch]:
    system, inner = fs.FileSystem.from_uri(at.path)
    with system.open_input_file(inner) as f:
        read = lambda start, n: f.read_at(n, start)
        for start in range(at.start, at.end, STEP_BYTES):
            batch = _step(read, at, start, min(start + STEP_BYTES, at.end))
            if batch.num_rows:
                yield batch


def _ranges(path: str, start: int, end: int, size: int, width: int, clean: bool) -> list[Range]:
    cuts = [start, *range((start // width + 1) * width, end, width), end]
    return [Range(path, a, b, size, clean and a == start) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], max(CUT, int(options.get("partitionbytes", PARTITION_BYTES)) // CUT * CUT)

    def partitions(self) -> list[Range]:
        return [r for path, size in files_of(self.path) for r in _ranges(path, 0, size, size, self.width, True)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.end > partition.start else iter(())


class LogStreamReader(DataSourceStreamReader):
    """Offsets are bytes read of each file.  A file's end is behind its last good
    frame, so a frame that is still being written waits; only the files' tails
    are looked at on the driver.  With more than TAIL_BYTES without a good frame, all but the last few kB are taken."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], max(CUT, int(options.get("partitionbytes", PARTITION_BYTES)) // CUT * CUT)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        try:
            found = files_of(self.path)
        except FileNotFoundError:
            found = []
        for path, size in found:
            before = self.seen.get(path, 0)
            if size > before:
                self.seen[path] = max(before, self._settled(path, size))
        return {"files": json.dumps(self.seen, sort_keys=True)}

    @staticmethod
    def _settled(path: str, size: int) -> int:
        system, inner = fs.FileSystem.from_uri(path)
        low = max(0, size - TAIL_BYTES)
        with system.open_input_file(inner) as f:
            data = np.frombuffer(f.read_at(size - low, low), np.uint8)
        good, _ = _apart(_good(data)[1], -SIZE if low == 0 else 0)
        if len(good):
            return low + int(good[-1]) + SIZE
        return max(0, (size - AROUND) // CUT * CUT) if low else 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = (json.loads(x["files"]) for x in (start, end))
        self.seen = {**after, **{k: max(v, after.get(k, 0)) for k, v in self.seen.items()}}
        return [r for path, b in sorted(after.items()) if b > before.get(path, 0) for r in _ranges(path, before.get(path, 0), b, b, self.width, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    n: int


class LogWriter(DataSourceArrowWriter):
    """Frames of the rows' records.  Tasks write files under ``_staging``; commit moves those of the tasks that
    succeeded to their places and abort removes them, so a reader sees a whole save or nothing of it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = fs.FileSystem.from_uri(self.path)
        folder, name, n = f"{inner}/_staging/{self.job}", f"part-{uuid.uuid4().hex}.bin", 0
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(logs.encoded(batch.to_pandas()))
                    n += batch.num_rows
        return Written([(f"{folder}/{name}", f"{inner}/{name}")], n)

    def commit(self, messages: list[Written]) -> None:
        system, inner = fs.FileSystem.from_uri(self.path)
        system.create_dir(inner, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            for staged, final in m.files if m and m.n else []:
                system.move(staged, final)
        for path in old:
            system.delete_file(path)
        self._cleared(system, inner)

    def abort(self, messages: list[Written]) -> None:
        self._cleared(*fs.FileSystem.from_uri(self.path))

    def _cleared(self, system: fs.FileSystem, inner: str) -> None:
        if system.get_file_info(f"{inner}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_staging/{self.job}")


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LogWriter(self.options, overwrite)
