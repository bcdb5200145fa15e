"""Sessions of any length, worked on in blocks of consecutive rows.

``numbered`` gives every row its place in its session from one range sort, so a
session that holds most of the rows is many tasks' work.  A block is a fixed
number of places.  Three things make block results equal those of whole
sessions:

* a linear recurrence maps a block's first state to its last by an affine map;
  the maps of a session's blocks are combined by a scan, and each block runs
  from its own start (``recurrence``);
* an operator that looks at neighbours gets copies of the rows next to its block
  (``with_halo``);
* a refractory time maps the last event before a block to the last one in it;
  that map has a step for each event within one refractory time of the block's
  first, and the maps are combined by the same scan (``spaced``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.dsp import ENVELOPE_KEEP
from sensorloom.storage import written

#: Rows of a block, blocks that a scan step combines, and rows of a range of the sort.
BLOCK_ROWS, SCAN_BLOCKS, RANGE_ROWS = 1 << 16, 4096, 1 << 20
#: Samples that run one after the other; lanes of so many run side by side.
LANE = 256


# ------------------------------------------------------------------ numbering
def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "idx", rows_per_range: int | None = None) -> DataFrame:
    """Every row with ``name``, its place from 0 in its group's order.

    One range sort by keys and order; places come from the rows that each
    partition has of a group, added up over partitions.  Nothing is collected, and
    no task holds a group.  Nulls come first unless ``order`` says otherwise;
    rows that are equal in keys and order are numbered in any order, within one
    partition.
    """
    parts = max(1, -(-df.count() // (rows_per_range or RANGE_ROWS)))
    by = [*[F.asc_nulls_first(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "numbered")
    held = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds the group
    shifts = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with idx and block, and the number of blocks of the largest session.
    Where every session fits one block, a window numbers the rows."""
    rows = rows or BLOCK_ROWS
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= rows:
        placed = df.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    else:
        placed = written(numbered(df, keys, order), "placed")
    return placed.withColumn("block", F.floor(F.col("idx") / rows).cast("long")), max(1, -(-most // rows))


def with_halo(df: DataFrame, before: int, after: int, rows: int | None = None) -> DataFrame:
    """``df`` with, for each block, copies of the ``before`` rows ahead of it and
    the ``after`` rows behind it; own tells a block's rows from copies."""
    rows = rows or BLOCK_ROWS
    if max(before, after) > rows:
        raise ValueError("a halo must not be longer than a block")
    at = F.col("idx") - F.col("block") * rows
    later = F.when(at >= rows - before, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    earlier = F.when((at < after) & (F.col("block") > 0), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    copies = df.withColumn("_to", F.explode(F.concat(F.array(F.lit(0)), later, earlier)))
    return copies.withColumn("own", F.col("_to") == 0).withColumn("block", F.col("block") + F.col("_to")).drop("_to")


def over_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], f: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``f`` on tables of whole groups in order, many groups in a call, with the
    places where groups begin and the end; a table is a batch and at most one
    group longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            edges = _edges(table, keys)
            if len(edges) > 2:
                yield from f(table.slice(0, edges[-2]), edges[:-1]).to_batches()
            held = table.slice(edges[-2]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from f(table, np.array([0, table.num_rows])).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _edges(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:-1] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


# ------------------------------------------------------------ affine recurrences
@dataclass
class Affine:
    """state' = a state + b x, y = c state + d x.  A session starts from ``first`` times its first x, and ``fixed``."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    first: np.ndarray
    fixed: np.ndarray = field(default=None)

    def __post_init__(self):
        self.fixed = np.zeros(len(self.b)) if self.fixed is None else self.fixed

    def start(self, x0: np.ndarray) -> np.ndarray:
        return np.asarray(x0, float)[:, None] * self.first + self.fixed

    def _lanes(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        """Runs lanes side by side, a sample of each at a time; their last states."""
        order = np.argsort(-size, kind="stable")
        at, size, state = at[order], size[order], state[order].copy()
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t))  # lanes that are longer than t
            v = x[at[:m] + t]
            if y is not None:
                y[at[:m] + t] = state[:m] @ self.c + self.d * v
            state[:m] = state[:m] @ self.a.T + v[:, None] * self.b
        out = np.empty_like(state)
        out[order] = state
        return out

    def run(self, x: np.ndarray, edges: np.ndarray, start: np.ndarray, output: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """The outputs of groups of samples, each from its start, and their last states.

        Groups longer than LANE are cut in lanes: all run from nothing, the starts
        of a group's lanes follow from their ends, then all run again."""
        x, size = np.asarray(x, float), np.diff(edges)
        n_lanes = np.maximum(1, -(-size // LANE))
        of = np.repeat(np.arange(len(size)), n_lanes)
        number = np.arange(len(of)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        at = edges[:-1][of] + number * LANE
        length = np.minimum(LANE, size[of] - number * LANE)
        state = start[of].copy()
        if len(n_lanes) and n_lanes.max() > 1:
            alone = self._lanes(x, at, length, np.zeros_like(state), None)
            over = np.linalg.matrix_power(self.a, LANE)
            for k in range(1, int(n_lanes.max())):
                here = np.flatnonzero(number == k)
                state[here] = state[here - 1] @ over.T + alone[here - 1]
        y = np.empty(len(x)) if output else None
        ends = self._lanes(x, at, length, state, y)
        return y, ends[np.cumsum(n_lanes) - 1]


def ema(alpha: float, begins: float | None = None, of_level: bool = False) -> Affine:
    """y += alpha (x - y), from the first sample or from ``begins``; F01 with ``of_level``: x less that."""
    keep = 1 - alpha
    c, d = ([-keep], keep) if of_level else ([keep], alpha)
    first, fixed = ([1.0], None) if begins is None else ([0.0], np.array([begins]))
    return Affine(np.array([[keep]]), np.array([alpha]), np.array(c), d, np.array(first), fixed)


def level_then_smooth(dc: float, low_pass: float) -> Affine:
    """the level taken off, then smoothed; the state is (level, smooth)."""
    p, q = 1 - dc, 1 - low_pass
    a = np.array([[p, 0.0], [-low_pass * p, q]])
    return Affine(a, np.array([dc, low_pass * p]), np.array([-low_pass * p, q]), low_pass * p, np.array([1.0, 0.0]))


def sections(rows: np.ndarray, settled: bool = False) -> Affine:
    """second-order sections (b0 b1 b2 a1 a2) in series, from rest; ``settled``: as if the first sample had always been there."""
    k = 2 * len(rows)
    a, b, level = np.zeros((k, k)), np.zeros(k), 1.0
    first = np.zeros(k)
    c, d = np.zeros(k), 1.0  # what the next section is fed, from all states and x
    for i, (b0, b1, b2, a1, a2) in enumerate(rows.tolist()):
        s = 2 * i
        out, straight = b0 * c, b0 * d
        out[s] += 1.0
        a[s], b[s] = b1 * c - a1 * out, b1 * d - a1 * straight
        a[s, s + 1] += 1.0
        a[s + 1], b[s + 1] = b2 * c - a2 * out, b2 * d - a2 * straight
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * gain
        first[s : s + 2] = (b1 - a1 * gain + z2) * level, z2 * level
        level *= gain
        c, d = out, straight
    return Affine(a, b, c, d, first if settled else np.zeros(k))


def _scanned(sums: DataFrame, keys: Sequence[str], most: int, step: Callable[[tuple, object], object], combine: Callable[[Sequence], object], fan: int) -> DataFrame:
    """keys, at and start (binary) of the blocks that follow those in ``sums``.

    ``sums`` has keys, at, map (binary) and, at 0 only, start.  ``step`` takes a
    start through a map, ``combine`` makes one map of consecutive ones.  Up to
    ``fan`` blocks are one group; of more, each group becomes one map, their starts
    come from this function, and go on within the groups.
    """
    key_schema = ", ".join(f"`{k}` {t}" for k, t in sums.dtypes if k in keys)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        known = rows["start"].dropna()
        state, starts = (known.iloc[0] if len(known) else None), []
        for m in rows["map"]:
            state = step(m, state)
            starts.append(state)
        return pd.DataFrame({**{k: rows[k] for k in keys}, "at": rows["at"] + 1, "start": starts})

    schema = f"{key_schema}, at long, start binary"
    if most <= fan:
        return sums.groupBy(*keys).applyInPandas(walk, schema)
    groups = sums.withColumn("_group", F.floor(F.col("at") / fan).cast("long"))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({**{k: rows[k].iloc[:1] for k in keys}, "at": rows["_group"].iloc[:1], "map": [combine(list(rows["map"]))], "start": rows["start"].iloc[:1]})

    above = groups.groupBy(*keys, "_group").applyInPandas(joined, f"{key_schema}, at long, map binary, start binary")
    starts = _scanned(above, keys, -(-most // fan), step, combine, fan).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), F.col("start").alias("_start"))
    same = F.col("_group") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = groups.join(starts, same & (F.col("at") % fan == 0), "left").select(*keys, "_group", "at", "map", F.coalesce("start", "_start").alias("start"))
    return within.groupBy(*keys, "_group").applyInPandas(walk, schema)


def recurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, filters: dict[str, Affine], carry: Sequence[str] = (), rows: int | None = None, scan: int | None = None, placed: tuple | None = None) -> DataFrame:
    """Keys, idx, block, ``carry`` and, for each named filter, its output over the session.

    A session of one block is filtered at once.  Of longer ones each block is first
    run from nothing; its end, and the filter's power over the block's rows, are
    its affine map.  ``placed`` is an ``in_blocks`` result to go on with.
    """
    rows = rows or BLOCK_ROWS
    placed, most = placed or in_blocks(df, keys, order, rows)
    columns = list(dict.fromkeys([*keys, "idx", "block", *carry]))
    data = placed.select(*columns, F.col(value).cast("double").alias("_x"))
    names = list(filters)
    several = most > 1
    if several:
        full = data.filter(F.col("block") < most - 1)
        edge_schema = ", ".join(f"`{k}` {t}" for k, t in data.dtypes if k in keys)

        def ends(table: pa.Table, edges: np.ndarray) -> pa.Table:
            whole = np.flatnonzero(np.diff(edges) == rows)  # only these have a block after them
            x = table.column("_x").to_numpy()
            block = table.column("block").to_numpy()[edges[:-1]]
            maps, first = [[] for _ in edges[:-1]], [None] * (len(edges) - 1)
            for f in filters.values():
                _, last = f.run(x, edges, np.zeros((len(edges) - 1, len(f.b))), output=False)
                begin = f.start(x[edges[:-1]])
                for g in whole.tolist():
                    maps[g].append(last[g])
                    first[g] = (first[g] or b"") + begin[g].tobytes()
            return pa.table(
                {
                    **{k: table.column(k).take(pa.array(edges[:-1][whole])) for k in keys},
                    "at": pa.array(block[whole]),
                    "map": pa.array([np.concatenate([[1.0], *maps[g]]).tobytes() for g in whole], pa.binary()),
                    "start": pa.array([first[g] if block[g] == 0 else None for g in whole], pa.binary()),
                }
            )

        over = _block_diagonal([np.linalg.matrix_power(f.a, rows) for f in filters.values()])

        def step(packed: bytes, state: bytes) -> bytes:
            m = np.frombuffer(packed)
            return (np.linalg.matrix_power(over, int(m[0])) @ np.frombuffer(state) + m[1:]).tobytes()

        def combine(maps: list[bytes]) -> bytes:
            total, v = 0.0, np.zeros(len(over))
            for packed in maps:
                m = np.frombuffer(packed)
                v = np.linalg.matrix_power(over, int(m[0])) @ v + m[1:]
                total += m[0]
            return np.concatenate([[total], v]).tobytes()

        sums = over_runs(full, [*keys, "block"], ["idx"], ends, f"{edge_schema}, at long, map binary, start binary")
        starts = _scanned(sums, keys, most, step, combine, scan or SCAN_BLOCKS).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), F.col("start").alias("_start"))
        same = F.col("block") == F.col("_at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        data = data.join(starts, same, "left").select(*columns, "_x", "_start")
    kinds = {c: t for c, t in data.dtypes if c in columns}

    def outputs(table: pa.Table, edges: np.ndarray) -> pa.Table:
        x, at = table.column("_x").to_numpy(), 0
        given = table.column("_start").take(pa.array(edges[:-1])).to_pylist() if several else [None] * (len(edges) - 1)
        known = np.array([g is not None for g in given])
        states = np.array([np.frombuffer(g) for g in given if g is not None])
        out = {c: table.column(c) for c in columns}
        for name, f in filters.items():
            start, k = f.start(x[edges[:-1]]), len(f.b)
            if known.any():
                start[known] = states[:, at : at + k]
            at += k
            out[name] = pa.array(f.run(x, edges, start)[0])
        return pa.table(out)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], *[f"`{n}` double" for n in names]])
    return over_runs(data, [*keys, "block"], ["idx"], outputs, schema)


def _block_diagonal(parts: list[np.ndarray]) -> np.ndarray:
    out, at = np.zeros((sum(map(len, parts)),) * 2), 0
    for p in parts:
        out[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    return out


def zero_phase(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows_of_filter: np.ndarray, carry: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """the sections forwards and backwards over the signal with odd
    extensions at both ends.  A session that is too short only loses its mean."""
    rows = rows or BLOCK_ROWS
    reach = 3 * (2 * len(rows_of_filter) + 1)
    placed, most = in_blocks(df, keys, order, rows)
    carried = [c for c in carry if c not in keys]
    placed = placed.select(*keys, "idx", *carried, F.col(value).cast("double").alias("_x"))
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_x").alias("_mean"), F.min_by("_x", "idx").alias("_first"), F.max_by("_x", "idx").alias("_last"))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", "_mean", "_first", "_last")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    known = placed.join(sizes, same).drop(*[f"_{k}" for k in keys])
    pad = F.least(F.lit(reach), F.col("_n") - 2)
    short = (F.col("_n") < 12) | (pad <= 0)
    only_mean = known.filter(short).select(*keys, "idx", *carried, (F.col("_x") - F.col("_mean")).alias("y"))
    back = F.col("_n") - 1 - F.col("idx")
    left = F.when((F.col("idx") >= 1) & (F.col("idx") <= pad), F.struct((pad - F.col("idx")).alias("at"), (2 * F.col("_first") - F.col("_x")).alias("x"), F.lit(False).alias("own")))
    right = F.when((back >= 1) & (back <= pad), F.struct((pad + F.col("_n") - 1 + back).alias("at"), (2 * F.col("_last") - F.col("_x")).alias("x"), F.lit(False).alias("own")))
    own = F.struct((pad + F.col("idx")).alias("at"), F.col("_x").alias("x"), F.lit(True).alias("own"))
    longer = known.filter(~short).withColumn("_e", F.explode(F.array_compact(F.array(own, left, right))))
    longer = longer.select(*keys, *carried, F.col("idx").alias("_idx"), (F.col("_n") + 2 * pad).alias("_long"), F.col("_e.at").alias("idx"), F.col("_e.x").alias("_x"), F.col("_e.own").alias("_own"))
    settled = sections(rows_of_filter, settled=True)
    more = -(-(most * rows + 2 * reach) // rows)
    kept = [*carried, "_idx", "_long", "_own"]
    blocked = lambda d: d.withColumn("block", F.floor(F.col("idx") / rows).cast("long"))
    ahead = recurrence(longer, keys, order, "_x", {"_y": settled}, kept, rows, placed=(blocked(longer), more))
    turned = ahead.select(*keys, *kept, (F.col("_long") - 1 - F.col("idx")).alias("idx"), "_y")
    turned = written(turned, "turned") if more > 1 else turned
    done = recurrence(turned, keys, order, "_y", {"y": settled}, kept, rows, placed=(blocked(turned), more))
    return done.filter("_own").select(*keys, F.col("_idx").alias("idx"), *carried, "y").unionByName(only_mean)


# ------------------------------------------------------------- spacing of events
def _chain(t: np.ndarray, gap: int) -> np.ndarray:
    """For each of ascending times, the last one of the chain of kept events that begins with it."""
    following = np.searchsorted(t, t + gap, "left")
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            last[i] = last[following[i]]
    return t[last]


def _through(packed: bytes, last: bytes | None, gap: int) -> bytes | None:
    """The last kept event after a block whose first events are (time, last of its chain)."""
    steps = np.frombuffer(packed, np.int64).reshape(-1, 2)
    if last is None:
        return steps[0, 1:].tobytes() if len(steps) else None
    i = int(np.searchsorted(steps[:, 0], np.frombuffer(last, np.int64)[0] + gap, "left"))
    return steps[i, 1:].tobytes() if i < len(steps) else last


def spaced(df: DataFrame, keys: Sequence[str], ts: str, gap: int, width: int | None = None, scan: int | None = None) -> DataFrame:
    """The rows, one after the other in time, that are ``gap`` or more after the last one kept.

    Blocks are spans of ``width`` of time (many gaps).  A block's map from the
    last event kept before it to the last one kept in it is a step function with
    steps only for the events within one gap of the block's first: each begins a
    chain, and all later ones follow from those.  Rows of one time are one event;
    with a gap of 1 or more the first by the remaining columns stays.
    """
    width = width or 4096 * max(1, gap)
    data = df.withColumn("block", F.floor(F.col(ts) / width).cast("long"))
    first = Window.partitionBy(*keys)
    spans = data.groupBy(*keys, "block").agg(F.count("*").alias("_n"))
    ranked = spans.withColumn("at", (F.row_number().over(first.orderBy("block")) - 1).cast("long"))  # a row a block
    ranked = ranked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), "at")
    most = ranked.agg(F.max("at")).first()[0]
    if most is None:
        return df.limit(0)
    same = F.col("block") == F.col("_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    data = data.join(ranked, same).select(*df.columns, "at")
    several, columns = most > 0, df.columns
    if several:
        key_schema = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys)

        def maps(table: pa.Table, edges: np.ndarray) -> pa.Table:
            t, packed = table.column(ts).to_numpy(), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = t[a:b]
                ends = _chain(mine, gap)
                n = min(len(mine), int(np.searchsorted(mine, mine[0] + gap, "left")) + 1)
                packed.append(np.stack([mine[:n], ends[:n]], 1).tobytes())
            head = pa.array(edges[:-1])
            return pa.table({**{k: table.column(k).take(head) for k in keys}, "at": table.column("at").take(head), "map": pa.array(packed, pa.binary()), "start": pa.nulls(len(head), pa.binary())})

        def combine(packed: list[bytes]) -> bytes:
            """The first block's steps, each taken on through the other blocks, and where the blocks after it begin for a later start."""
            times: list[int] = []
            for p in packed:
                steps = np.frombuffer(p, np.int64).reshape(-1, 2)
                times += [x for x in steps[:, 0].tolist() if not times or x < times[0] + gap]
                if steps[0, 0] >= times[0] + gap:
                    times.append(int(steps[0, 0]))
                    break
                if len(steps) and steps[-1, 0] >= times[0] + gap:
                    times.append(int(steps[-1, 0]))
                    break
            out = []
            for x in times:
                last = np.array([x - gap], np.int64).tobytes()
                for p in packed:
                    last = _through(p, last, gap)
                out.append([x, int(np.frombuffer(last, np.int64)[0])])
            return np.array(out, np.int64).tobytes()

        sums = over_runs(data.select(*keys, "at", ts), [*keys, "at"], [ts], maps, f"{key_schema}, at long, map binary, start binary")
        starts = _scanned(sums, keys, most + 1, lambda m, s: _through(m, s, gap), combine, scan or SCAN_BLOCKS)
        starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), F.col("start").alias("_start"))
        same = F.col("at") == F.col("_at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        data = data.join(starts, same, "left").select(*df.columns, "at", "_start")

    def kept(table: pa.Table, edges: np.ndarray) -> pa.Table:
        t, keep = table.column(ts).to_numpy(), []
        given = table.column("_start").take(pa.array(edges[:-1])).to_pylist() if several else [None] * (len(edges) - 1)
        for a, b, start in zip(edges[:-1].tolist(), edges[1:].tolist(), given, strict=True):
            i = a if start is None else a + int(np.searchsorted(t[a:b], np.frombuffer(start, np.int64)[0] + gap, "left"))
            while i < b:
                keep.append(i)
                i = max(i + 1, a + int(np.searchsorted(t[a:b], t[i] + gap, "left")))
        return table.select(columns).take(pa.array(keep, pa.int64()))

    return over_runs(data, [*keys, "at"], [ts, *[c for c in df.columns if c != ts and c not in keys]], kept, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


# ------------------------------------------------------------------------- peaks
def _candidates(v: np.ndarray, envelope: np.ndarray, edges: np.ndarray, scale: float) -> np.ndarray:
    """Places higher than the one before, not lower than the one after, and above the envelope as of the one after."""
    inner = np.ones(len(v), bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    at = np.flatnonzero(inner)
    return at[(v[at] > v[at - 1]) & (v[at] >= v[at + 1]) & (v[at] > envelope[at + 1] * scale)]


def session_peaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str, settings: dict, rows: int | None = None) -> DataFrame:
    """keys, time and amplitude of each session's peaks, see ``dsp.peaks``.

    A session of one block is done at once.  Of longer ones the envelope is a
    recurrence over blocks, blocks get their neighbours' next rows, and the
    refractory time goes through blocks as ``spaced`` tells.
    """
    rows = rows or BLOCK_ROWS
    scale, gap = settings["scale"], settings["refractory_us"]
    placed, most = in_blocks(df.select(*dict.fromkeys([*keys, *order, ts, value])), keys, order, rows)
    v = F.col(value).cast("double")
    data = placed.select(*keys, "idx", "block", F.col(ts).cast("long").alias("peak_us"), (F.abs(v) if settings["magnitude"] else v).alias("amplitude")).withColumn("_a", F.abs("amplitude"))
    envelope = ema(1 - ENVELOPE_KEEP, begins=1.0)
    schema = ", ".join([*[f"`{k}` {t}" for k, t in data.dtypes if k in keys], "peak_us long, idx long, amplitude double"])
    columns = [*keys, "peak_us", "idx", "amplitude"]

    if most == 1:

        def whole(table: pa.Table, edges: np.ndarray) -> pa.Table:
            v, t = table.column("amplitude").to_numpy(), table.column("peak_us").to_numpy()
            level, _ = envelope.run(np.abs(v), edges, envelope.start(np.zeros(len(edges) - 1)))
            keep, last, of = [], None, -1
            found = _candidates(v, level, edges, scale)
            for i, session in zip(found.tolist(), (np.searchsorted(edges, found, "right") - 1).tolist(), strict=True):
                if session != of or t[i] - last >= gap:
                    keep.append(i)
                    last, of = t[i], session
            return table.select(columns).take(pa.array(keep, pa.int64()))

        return over_runs(data, keys, ["idx"], whole, schema).drop("idx")

    levels = recurrence(data, keys, order, "_a", {"_e": envelope}, ["peak_us", "amplitude"], rows, placed=(data, most))

    def marked(table: pa.Table, edges: np.ndarray) -> pa.Table:
        at = _candidates(table.column("amplitude").to_numpy(), table.column("_e").to_numpy(), edges, scale)
        own = table.column("own").to_numpy(zero_copy_only=False)
        return table.select(columns).take(pa.array(at[own[at]]))

    found = over_runs(with_halo(levels, 1, 1, rows), [*keys, "block"], ["idx"], marked, schema)
    return spaced(written(found, "peaks"), keys, "peak_us", gap).drop("idx")
