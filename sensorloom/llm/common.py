"""Shared pieces of the training-data operators.

Operators that must compare every window of every document with every other
one share one pattern.  Documents are dealt into *chunks* of a few megabytes
by a hash, and the keys of a chunk's windows into *shards* by value.  A chunk
sends its sorted distinct keys, equal keys of all chunks meet in their shard,
and the answers come back in the order of the keys sent, so an answer needs a
byte or less and no key.  ``Exchange`` does that in as many hops as it takes to
keep each sender's rows few, see there.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and values in a shard, on average.
CHUNK_BYTES = 4 << 20
SHARD_VALUES = 2 << 20
#: Rows that a chunk or a node between chunks and shards sends at most; of a chunk's values some 170 go in each then.
FAN_OUT = 4096
#: Rows of a partition of a checkpointed table.
PARTITION_ROWS = 100_000
#: Bytes whose words are looked for at once.
STEP_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(n) for n in (30, 27, 31, 32))
_LOW32 = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------------------ folders
def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what ``spark.checkpoint.dir``
    names.  Where it is unset, a local master takes a new local folder, as in
    tests; a cluster can't use one, so that is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isDefined():
            return context._jsc.sc().getCheckpointDir().get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        context.setCheckpointDir(base)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, in as many
    partitions as its rows need, so that small tables make few shuffle files."""
    scratch_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    return kept.coalesce(max(1, math.ceil(kept.count() / PARTITION_ROWS)))


# ------------------------------------------------------------------- chunks
def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def chunked(docs: DataFrame, n_chunks: int) -> DataFrame:
    """doc_id and text with the chunk that each row belongs to.  Equal rows go
    to one chunk only as far as they are in one partition of ``docs``."""
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chunk.alias("chunk"))


def chunk_count(n_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / CHUNK_BYTES))


def shard_count(n_values: float) -> int:
    return max(1, math.ceil(n_values / SHARD_VALUES))


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts of a chunk as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in table.column("text").cast(pa.binary()).to_pylist()]


# ------------------------------------------------------------------- hashes
def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.copy()
    x ^= x >> _S30
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            m = max(n, 2 * len(self._up))
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                out = np.full(m, b, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self._up[:n], self._down[:n]


def _sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """For each span of ``values`` a polynomial of them modulo 2**64, the same
    for equal spans wherever they are."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def window_sums(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """``_sums_between`` for each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[width:] - total[:n]) * down[:n]


# -------------------------------------------------------------------- words
_WORD_POWERS = Powers(0xA3EC647659359ACD), Powers(0x8CB92BA72F3D8DD7)
_WORD_BYTES = mixed(np.arange(5001, 5257, dtype=np.uint64)), mixed(np.arange(7001, 7257, dtype=np.uint64))
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256) + 32 * ((np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")))


class Words:
    """The words, runs of bytes other than space and \\t to \\r, of some texts.

    ``data`` holds the texts, each with a line feed after it; word i has the
    bytes ``start[i]`` to ``end[i]`` of it, and ``sizes`` tells the words of
    each text.  ``hashes`` are 64-bit hashes of each word's bytes, ``n_hashes``
    independent ones, of A-Z in lower case where ``lower`` is set.  Texts are
    worked through in steps of STEP_BYTES, so no word is a Python object and a
    text takes some ten bytes for each of its own.
    """

    def __init__(self, texts: list[bytes], n_hashes: int = 1, lower: bool = False):
        self.data = b"\n".join([*texts, b""])
        tables = [x[_LOWER] if lower else x for x in _WORD_BYTES[:n_hashes]]
        parts = [self._part(base, tables) for base in range(0, len(self.data), STEP_BYTES)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * n_hashes)
        start, end, *hashes = (np.concatenate(c) for c in zip(none, *parts, strict=True))
        # A word that steps cut goes together again: each later piece's hash, moved behind the pieces before it.
        later = np.flatnonzero((start[1:] == end[:-1]) & (start[1:] % STEP_BYTES == 0)) + 1
        if len(later):
            head = None
            for i in later.tolist():
                head = i - 1 if head is None or end[i - 1] != end[head] else head
                for h, powers in zip(hashes, _WORD_POWERS, strict=False):
                    moved = pow(powers.base, int(start[i] - start[head]), 1 << 64)
                    h[head : head + 1] += h[i : i + 1] * np.uint64(moved)
                end[head] = end[i]
            keep = np.ones(len(start), bool)
            keep[later] = False
            start, end, hashes = start[keep], end[keep], [h[keep] for h in hashes]
        self.start, self.end, self.hashes = start, end, [mixed(h) for h in hashes]
        offsets = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.sizes = np.diff(np.searchsorted(start, offsets))

    def _part(self, base: int, tables: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(self.data, np.uint8, min(STEP_BYTES, len(self.data) - base), base)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IN_WORD[data]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        sums = [_sums_between(t[data], start, end, p) for t, p in zip(tables, _WORD_POWERS, strict=False)]
        return start + base, end + base, *sums


# --------------------------------------------------------- packed whole numbers
_LIMITS = np.array([(1 << 8 * w) - 1 for w in range(1, 8)], np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers below 2**64 in the fewest bytes of one width that serve
    most of them; the few larger ones follow whole.  Flags take a bit each."""
    x = np.ascontiguousarray(x).astype(np.uint64, copy=False)
    if not len(x) or x.max() <= 1:
        return b"\0" + np.packbits(x.astype(bool)).tobytes()
    larger = len(x) - np.cumsum(np.bincount(np.searchsorted(_LIMITS, x, "right"), minlength=8))[:7]
    width = int(np.argmin(np.append(np.arange(1, 8) * len(x) + 8 * larger, 8 * len(x)))) + 1
    if width == 8:
        return b"\x08" + x.tobytes()
    limit = _LIMITS[width - 1]
    low = np.minimum(x, limit).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + low.tobytes() + x[x >= limit].tobytes()


def unpack_ints(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack_ints`` packed, as uint64."""
    width = packed[0]
    if width == 0:
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), count=n).astype(np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, n * width, 1).reshape(n, width)
    out = out.reshape(-1).view(np.uint64)
    if width < 8:
        out[out == _LIMITS[width - 1]] = np.frombuffer(packed, np.uint64, offset=1 + n * width)
    return out


# ------------------------------------------------------------------- exchange
PART_SCHEMA = "grp long, dest long, sender long, n int, keys binary, number binary"
ANSWER_SCHEMA = "sender long, dest long, n int, a binary, b binary"


def distinct_digests(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts 128-bit digests, the group of each in that order, and where groups begin."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


class Exchange:
    """Equal keys of all chunks meet in their shard, and answers come back.

    With more than FAN_OUT shards a chunk would send each of them a few keys
    only, so that rows grew with the square of the input.  Then keys go in
    hops: of h hops, each sends at most R rows, the h-th root of the shards.  A
    node takes the rows of R senders for one range of shards, merges their
    equal keys, and sends them on to R narrower ranges; the last nodes are the
    shards.  Answers go back through the same nodes, which merge the same rows
    again to tell whose they are.  So a row holds as many keys at any size, and
    bytes a key grow with the number of hops alone.

    Keys are sorted ``cells`` below ``n_shards * span``, or, with a span of 0,
    128-bit digests as (first, second).  Each key carries a number; numbers of
    equal keys are added up or, with ``least``, the smallest stays.  The shard
    calls ``answer(first, number)`` with all its distinct keys in order and
    gets one or two arrays of whole numbers, in the order of the keys.
    """

    def __init__(self, n_shards: int, answer: Callable, span: int = 0, least: bool = False):
        self.n_shards, self.answer, self.span, self.least = n_shards, answer, span, least
        self.hops = 1
        while FAN_OUT**self.hops < n_shards:
            self.hops += 1
        self.radix = math.ceil(n_shards ** (1 / self.hops))

    def _bounds(self, shards: np.ndarray) -> np.ndarray:
        if self.span:
            return shards.astype(np.uint64) * np.uint64(self.span)
        return np.array([(int(s) << 64) // self.n_shards for s in shards], np.uint64)

    def rows(self, sender: int, first: np.ndarray, second: np.ndarray | None, number: np.ndarray, hop: int = 1, parent: int = 0) -> pa.Table:
        """What a sender sends: a row for each range of shards that has keys."""
        width = self.radix ** (self.hops - hop)
        low = parent * self.radix
        children = np.arange(low, min(low + self.radix, -(-self.n_shards // width)), dtype=np.int64)
        bounds = self._bounds(children * width)
        edges = np.append(np.searchsorted(first, bounds), len(first))
        full = np.flatnonzero(np.diff(edges))
        keys, numbers = [], []
        for i in full.tolist():
            a, b = edges[i], edges[i + 1]
            if self.span:
                keys.append(pack_ints(np.diff(first[a:b], prepend=bounds[i])))
            else:
                keys.append(np.stack([first[a:b], second[a:b]], 1).tobytes())
            numbers.append(pack_ints(number[a:b]))
        group = sender // self.radix if hop < self.hops else 0
        constant = lambda x: pa.array(np.full(len(full), x, np.int64))
        return pa.table(
            {
                "grp": constant(group),
                "dest": pa.array(children[full]),
                "sender": constant(sender),
                "n": pa.array(np.diff(edges)[full].astype(np.int32)),
                "keys": pa.array(keys, pa.binary()),
                "number": pa.array(numbers, pa.binary()),
            }
        )

    def _merged(self, table: pa.Table, hop: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """The distinct keys (first, second) of a node's rows and their numbers, and which of them each key sent is."""
        sizes = table.column("n").to_pylist()
        number = np.concatenate([unpack_ints(x, n) for x, n in zip(table.column("number").to_pylist(), sizes, strict=True)])
        packed = table.column("keys").to_pylist()
        if self.span:
            bound = self._bounds(np.array([table.column("dest")[0].as_py() * self.radix ** (self.hops - hop)]))
            every = np.concatenate([np.cumsum(unpack_ints(x, n)) for x, n in zip(packed, sizes, strict=True)]) + bound
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            new = np.ones(len(ordered), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            first, second = ordered[begin], None
        else:
            every = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2)
            order, group, begin = distinct_digests(every[:, 0], every[:, 1])
            first, second = every[order[begin], 0], every[order[begin], 1]
        combine = np.minimum if self.least else np.add
        number = number.astype(np.int64) if self.least else number
        total = combine.reduceat(number[order], begin)
        of = np.empty(len(order), np.int64)
        of[order] = group
        return first, second, total, of

    @staticmethod
    def _answers(table: pa.Table, answers: tuple[np.ndarray, ...], of: np.ndarray) -> pa.Table:
        """A row for each row of ``table``: the answers to its keys."""
        sizes = table.column("n").to_pylist()
        cuts = np.cumsum(sizes)[:-1]
        packed = [[pack_ints(x) for x in np.split(y[of], cuts)] for y in answers]
        return pa.table(
            {
                "sender": table.column("sender"),
                "dest": table.column("dest"),
                "n": table.column("n"),
                "a": pa.array(packed[0], pa.binary()),
                "b": pa.array(packed[1] if len(packed) > 1 else [None] * len(sizes), pa.binary()),
            }
        )

    def answered(self, parts: DataFrame, hop: int = 1) -> DataFrame:
        """For each row of ``parts``, what its shards answered: sender, dest, n and the packed answers a and b."""
        if hop == self.hops:

            def shard(table: pa.Table) -> pa.Table:
                first, _, number, of = self._merged(table, hop)
                return self._answers(table, self.answer(first, number), of)

            return parts.groupBy("grp", "dest").applyInArrow(shard, ANSWER_SCHEMA)

        def on(key: tuple, table: pa.Table) -> pa.Table:
            first, second, number, _ = self._merged(table, hop)
            return self.rows(key[0].as_py(), first, second, number, hop + 1, key[1].as_py())

        def back(table: pa.Table, answers: pa.Table) -> pa.Table:
            *_, of = self._merged(table, hop)
            found = [answers_of(answers, x) for x in "ab"]
            return self._answers(table, tuple(x for x in found if len(x)), of)

        nodes = parts.groupBy("grp", "dest")
        up = self.answered(nodes.applyInArrow(on, PART_SCHEMA), hop + 1)
        up = up.select(F.col("sender").alias("grp"), F.floor(F.col("dest") / self.radix).alias("up"), "dest", "n", "a", "b")
        return nodes.cogroup(up.groupBy("grp", "up")).applyInArrow(back, ANSWER_SCHEMA)


def answers_of(table: pa.Table, column: str = "a") -> np.ndarray:
    """What a chunk was answered, in the order of the keys that it sent."""
    dest, sizes, packed = (table.column(c).to_pylist() for c in ("dest", "n", column))
    order = [i for i in np.argsort(np.array(dest, np.int64), kind="stable").tolist() if packed[i] is not None]
    return np.concatenate([np.zeros(0, np.uint64), *[unpack_ints(packed[i], sizes[i]) for i in order]])


# ------------------------------------------------------------ partition sketch
class Sketch:
    """A count-min sketch of ``rows`` rows of counters, dealt into shards.

    A partition's part is sparse: the cells that it touches and their counts;
    ``exchange`` adds up all partitions' parts.  With ``per_value`` counters in
    a row for each expected value, a value that is unique shares its counter
    with another about once in ``per_value`` times, and all its counters once
    in ``per_value ** rows`` times.  A value's estimate is the least of its
    counters, which is never below its count.
    """

    def __init__(self, n_values: float, answer: Callable, per_value: int = 64, rows: int = 1):
        self.n_rows = rows
        self.shards = shard_count(n_values)
        self.span = max(1, math.ceil(per_value * n_values / self.shards / (1 << 16))) << 16
        self.exchange = Exchange(rows * self.shards, answer, self.span)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        """rows x values: each value's cell in each row."""
        out = np.empty((self.n_rows, len(hashes)), np.uint64)
        for r in range(self.n_rows):
            h = hashes if r == 0 else mixed(hashes + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            shard = (((h >> _S32) * np.uint64(self.shards)) >> _S32) + np.uint64(r * self.shards)
            out[r] = shard * np.uint64(self.span) + (((h & _LOW32) * np.uint64(self.span)) >> _S32)
        return out

    def touched(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct cells of some values, their counts, and rows x values: which of them each value has."""
        cells, of, counts = np.unique(self.cells(hashes), return_inverse=True, return_counts=True)
        return cells, counts, of.reshape(self.n_rows, -1)

    def part(self, sender: int, hashes: np.ndarray) -> pa.Table:
        cells, counts, _ = self.touched(hashes)
        return self.exchange.rows(sender, cells, None, counts)


def repeated(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray]:
    """Answers whether a key was there twice or more."""
    return (number >= 2,)


def counted(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray]:
    """Answers with ``count_code``."""
    return (count_code(number),)


def count_code(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 128, then in steps of a quarter power of two."""
    big = 128 + np.minimum(127, np.floor(4 * np.log2(np.maximum(n, 128) / 128)))
    return np.where(n < 128, n, big).astype(np.uint8)
