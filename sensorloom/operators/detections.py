"""Boxes, tracks, calibrated scores and outliers of model results.

A frame's boxes, or a session's events, are one group; what can be told of a row
by itself is an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import blocks
from sensorloom.operators.dsp import over_sessions
from sensorloom.operators.series import ordered

BOX = ["x1", "y1", "x2", "y2"]
#: Costs that are looked at side by side.
SIDE_BY_SIDE = 1 << 18


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


# ------------------------------------------------------------------------ boxes
def overlaps(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Shared area over the area of both, of one box and each of ``others``;
    corners may come in either order, and a box without area shares nothing."""
    (low, high), (lows, highs) = [(np.minimum(b[..., :2], b[..., 2:]), np.maximum(b[..., :2], b[..., 2:])) for b in (box, others)]
    shared = np.maximum(np.minimum(high, highs) - np.maximum(low, lows), 0).prod(-1)
    area, areas = (high - low).prod(-1), (highs - lows).prod(-1)
    both = area + areas - shared
    usable = (area > 0) & (areas > 0)
    return np.divide(shared, both, out=np.zeros(np.shape(both)), where=usable)


def kept_boxes(df: DataFrame, frame: Sequence[str], id_column: str, score: str, iou: float, least_score: float, most: int) -> DataFrame:
    """Of each frame's boxes (x1, y1, x2, y2) those over ``least_score``, best
    first (ties to the smaller id), without any that overlaps a kept one by ``iou``
    or more; ``most`` of a frame at the utmost.  Columns: frame, id, score, rank."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, id_column], ascending=[False, True], ignore_index=True)
        boxes, left, taken = rows[BOX].to_numpy(float), np.arange(len(rows)), []
        while len(left) and len(taken) < most:
            best, left = left[0], left[1:]
            taken.append(best)
            left = left[overlaps(boxes[best], boxes[left]) < iou]
        return rows.loc[taken, [*frame, id_column, score]].assign(rank=np.arange(1, len(taken) + 1))

    rows = df.filter(F.col(score) > least_score).select(*frame, id_column, F.col(score).cast("double").alias(score), *BOX)
    return rows.groupBy(*frame).applyInPandas(keep, f"{_key_schema(rows, [*frame, id_column])}, {score} double, rank int")


def crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, segments: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """How often each path's steps cross each segment; touching an end is no
    crossing.  Columns: keys, crossings0, crossings1, ..."""
    w = ordered(keys, order)
    here, before = (F.col(x), F.col(y)), (F.lag(x).over(w), F.lag(y).over(w))
    rows = df.select(*keys, here[0].alias("_x"), here[1].alias("_y"), before[0].alias("_u"), before[1].alias("_v"))
    now, then = (F.col("_x"), F.col("_y")), (F.col("_u"), F.col("_v"))
    left = lambda a, b, p: (p[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (p[0] - a[0])
    found = []
    for i, s in enumerate(segments):
        a, b = [(F.lit(float(s[k])), F.lit(float(s[k + 1]))) for k in (0, 2)]
        across = (left(a, then, now) != left(b, then, now)) & (left(a, b, then) != left(a, b, now))
        found.append(F.count(F.when(across, 1)).alias(f"crossings{i}"))
    return rows.groupBy(*keys).agg(*found)


# ----------------------------------------------------------------------- tracks
def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row so that the total cost is least, each column at
    most once; -1 for the rows beyond the columns.  Rows enter one by one along
    the shortest augmenting path."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        back = assignment(cost.T)
        out = np.full(cost.shape[0], -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    n, m = cost.shape
    by_row, by_column, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        distance, parent, done, row, base, path = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), start, 0.0, [start]
        while True:
            through = base + cost[row] - by_row[row] - by_column
            nearer = ~done & (through < distance)
            distance[nearer], parent[nearer] = through[nearer], row
            column = int(np.argmin(np.where(done, np.inf, distance)))
            base, done[column] = distance[column], True
            if owner[column] < 0:
                break
            row = owner[column]
            path.append(row)
        by_row[start] += base
        for r in path[1:]:
            by_row[r] += base - distance[np.flatnonzero(owner == r)[0]]
        by_column[done] -= base - distance[done]
        while column >= 0:
            row = parent[column]
            before = np.flatnonzero(owner == row)
            owner[column] = row
            column = int(before[before != column][0]) if row != start else -1
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assignments(costs: np.ndarray) -> np.ndarray:
    """``assignment`` of each of many cost matrices of one shape, side by side; ties fall as they do there."""
    costs = np.asarray(costs, float)
    count, n, m = costs.shape
    if n > m:
        back, out = assignments(costs.transpose(0, 2, 1)), np.full((count, n), -1)
        which, column = np.nonzero(back >= 0)
        out[which, back[which, column]] = column
        return out
    by_row, by_column = np.zeros((count, n)), np.zeros((count, m))
    owner, of = np.full((count, m), -1), np.full((count, n), -1)
    every = np.arange(count)
    for start in range(n):
        distance, parent, done = np.full((count, m), np.inf), np.full((count, m), -1), np.zeros((count, m), bool)
        row, base, last = np.full(count, start), np.zeros(count), np.full(count, -1)
        on_path = np.zeros((count, n), bool)
        a = every
        while len(a):
            through = base[a, None] + costs[a, row[a]] - by_row[a, row[a], None] - by_column[a]
            nearer = ~done[a] & (through < distance[a])
            distance[a], parent[a] = np.where(nearer, through, distance[a]), np.where(nearer, row[a, None], parent[a])
            column = np.argmin(np.where(done[a], np.inf, distance[a]), 1)
            base[a], done[a, column] = distance[a, column], True
            taken = owner[a, column]
            last[a[taken < 0]] = column[taken < 0]
            a, taken = a[taken >= 0], taken[taken >= 0]
            row[a] = taken
            on_path[a, taken] = True
        by_row[:, start] += base
        which, r = np.nonzero(on_path)
        by_row[which, r] += base[which] - distance[which, of[which, r]]
        by_column -= np.where(done, base[:, None] - np.where(done, distance, 0), 0)
        a, column = every, last
        while len(a):
            r = parent[a, column]
            before = of[a, r]
            owner[a, column], of[a, r] = r, column
            a, column = a[r != start], before[r != start]
    return of


def centre_distance(tracks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The distance of each track's centre from that of each box found."""
    centre = lambda b: (b[..., :2] + b[..., 2:]) / 2
    return np.linalg.norm(centre(tracks)[..., :, None, :] - centre(found)[..., None, :, :], axis=-1)


def squared_distance(tracks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The square of ``centre_distance``: of crossing pairs it prefers those that don't cross."""
    return centre_distance(tracks, found) ** 2


def overlap_cost(tracks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """1 less the overlap."""
    return 1.0 - overlaps(tracks[..., :, None, :], found[..., None, :, :])


def aligned(
    tracks: DataFrame, found: DataFrame, frame: Sequence[str], cost: Callable[[np.ndarray, np.ndarray], np.ndarray] = overlap_cost, most_cost: float = np.inf
) -> DataFrame:
    """Frame, track, found and cost of the pairs with the least total cost
    in each frame; pairs over ``most_cost`` go.  Both sides have the frame, an ``id`` and a box.

    ``cost`` takes frames x boxes x corners; frames of one batch with equally many
    tracks and boxes are paired side by side."""

    def pair(table: pa.Table, edges: np.ndarray) -> pa.Table:
        boxes = np.stack([table.column(x).to_numpy() for x in BOX], 1)
        begin, is_track = edges[:-1], np.append(0, np.cumsum(table.column("_track").to_numpy()))
        n = is_track[edges[1:]] - is_track[begin]  # a frame's tracks come first
        m = np.diff(edges) - n
        rows: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        paired = np.flatnonzero((n > 0) & (m > 0))
        shapes, shape = np.unique(np.stack([n[paired], m[paired]], 1), axis=0, return_inverse=True)
        for k, (a, b) in enumerate(shapes.tolist()):
            of_shape = begin[paired[shape.ravel() == k]]
            for first in np.array_split(of_shape, -(-len(of_shape) * a * b // SIDE_BY_SIDE)):
                left, right = first[:, None] + np.arange(a), first[:, None] + a + np.arange(b)
                c = cost(boxes[left], boxes[right])
                of = assignments(c)
                which, row = np.nonzero(of >= 0)
                at = of[which, row]
                near = c[which, row, at] <= most_cost
                which, row, at = which[near], row[near], at[near]
                for own, more in zip(rows, (left[which, row], right[which, at], c[which, row, at]), strict=True):
                    own.append(more)
        at, to, costs = map(np.concatenate, rows)
        order = np.argsort(at)
        out, ids = table.select(list(frame)).take(pa.array(at[order])), table.column("id")
        for name, values in (("track", ids.take(pa.array(at[order]))), ("found", ids.take(pa.array(to[order]))), ("cost", pa.array(costs[order]))):
            out = out.append_column(name, values)
        return out

    sides = [side.select(*frame, F.col("id").cast("long").alias("id"), *[F.col(x).cast("double").alias(x) for x in BOX], F.lit(track).alias("_track")) for side, track in ((tracks, 1), (found, 0))]
    return blocks.over_runs(sides[0].unionByName(sides[1]), frame, [F.desc("_track"), "id"], pair, f"{_key_schema(tracks, frame)}, track long, found long, cost double")


def kalman(z: np.ndarray, step: Callable, slope: Callable, seen: Callable, seen_slope: Callable, q: np.ndarray, r: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The states after each observation of an extended Kalman filter with the
    models ``step`` and ``seen`` and their slopes; a missing observation only predicts."""
    states = []
    for o in z:
        f = slope(x)
        x, p = step(x), f @ p @ f.T + q
        if np.isfinite(o).all():
            h = seen_slope(x)
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + gain @ (np.atleast_1d(o) - seen(x)), p - gain @ h @ p
        states.append(x)
    return np.array(states)


# ----------------------------------------------------------------------- scores
def calibrated_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], scores: Sequence[str], width: int, threshold: float, pause: int) -> DataFrame:
    """The rows at which a label is recognised: its mean score over the last
    ``width`` rows is the highest (the first of equal ones), positive and at least
    ``threshold``, and more than ``pause`` rows have passed since the last event."""
    w = ordered(keys, order)
    means = [F.avg(s).over(w.rowsBetween(1 - width, 0)).alias(s) for s in scores]
    rows = df.select(*dict.fromkeys([*keys, *order]), F.row_number().over(w).alias("pos"), *means)
    top = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    label = reduce(lambda rest, s: F.when(F.col(s) == F.col("score"), s).otherwise(rest), reversed(scores[:-1]), F.lit(scores[-1]))
    candidates = rows.withColumn("score", top).filter((F.col("score") >= threshold) & (F.col("score") > 0)).withColumn("label", label)

    def apart(rows: pd.DataFrame) -> pd.DataFrame:
        at, kept = rows["pos"].to_numpy(), [0]
        while (after := np.searchsorted(at, at[kept[-1]] + pause, "right")) < len(at):
            kept.append(after)
        return rows.iloc[kept]

    kept = candidates.select(*dict.fromkeys([*keys, *order]), "pos", "label", "score")
    return over_sessions(kept, keys, ["pos"], apart, kept.schema.simpleString()[7:-1].replace(":", " "))


# --------------------------------------------------------------------- outliers
def fit_clusters(df: DataFrame, features: Sequence[str], label: str) -> list[tuple[list[float], float]]:
    """The centre of each label's rows and the greatest distance of one from it;
    as many as there are labels, so these must be few."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_k"), *features)
    centres = rows.groupBy("_k").agg(*[F.avg(f).alias(f"_{f}") for f in features])
    distance = F.sqrt(reduce(add, [(F.col(f) - F.col(f"_{f}")) * (F.col(f) - F.col(f"_{f}")) for f in features]))
    found = rows.join(centres, "_k").groupBy("_k", *[f"_{f}" for f in features]).agg(F.max(distance).alias("_r"))
    return [([r[f"_{f}"] for f in features], r["_r"]) for r in found.orderBy("_k").collect()]


def cluster_anomaly(features: Sequence[Column], clusters: Sequence[tuple[Sequence[float], float]]) -> Column:
    """The distance from the nearest cluster less its radius, 1000 at most."""
    away = [F.sqrt(reduce(add, [(x - m) * (x - m) for x, m in zip(features, centre, strict=True)])) - radius for centre, radius in clusters]
    return F.least(F.lit(1000.0), *away)


def fit_mixture(df: DataFrame, features: Sequence[str], label: str) -> list[tuple[float, list[float], np.ndarray]]:
    """Share, mean and covariance of each label's rows; labels must be few."""
    n = len(features)
    pairs = [F.covar_pop(a, b).alias(f"_c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    found = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)], *pairs).orderBy(label).collect()
    total = sum(r["_n"] for r in found)
    return [(r["_n"] / total, [r[f"_m{i}"] for i in range(n)], np.array([[r[f"_c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])) for r in found]


def mixture_anomaly(features: Sequence[Column], parts: Sequence[tuple[float, Sequence[float], np.ndarray]]) -> Column:
    """Minus the logarithm of a Gaussian mixture's density, from the largest
    term, so that far rows don't underflow."""
    terms = []
    for share, mean, covariance in parts:
        inverse, (_, size) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
        off = [x - float(m) for x, m in zip(features, mean, strict=True)]
        square = reduce(add, [off[i] * off[j] * float(inverse[i, j]) for i in range(len(off)) for j in range(len(off))])
        terms.append(float(np.log(share) - 0.5 * (len(off) * np.log(2 * np.pi) + size)) - 0.5 * square)
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return -(top + F.log(reduce(add, [F.exp(t - top) for t in terms])))
