"""Clusters and Gaussian mixtures fitted over the whole table.

A round is one aggregate: each task adds up what its rows contribute to every
component (weight, sum, sum of products), a few kB whatever the rows, and these
merge through a tree.  Rows with a null or non-finite feature take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.storage import written

#: Rounds of seeding, of moving centres and of expectation and maximisation, at most.
SEED_ROUNDS, MOVE_ROUNDS, EM_ROUNDS = 5, 50, 100
#: What is added to each component's sum of products, so that it stays invertible; it is a prior, and the objective has it.
PRIOR = 1e-6


def matrix_rows(df: DataFrame, features: Sequence[Column]) -> DataFrame:
    """The usable rows as f0, f1 ..., written once."""
    rows = df.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in rows.columns]
    for ok in fine:
        rows = rows.filter(ok)
    return written(rows, "features")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)


def summed(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``f``, which maps a matrix of rows to ``size`` numbers."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return rows.mapInArrow(parts, "part binary").rdd.map(lambda r: np.frombuffer(r["part"])).treeAggregate(np.zeros(size), lambda a, b: a + b, lambda a, b: a + b)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(2)


# ------------------------------------------------------------------------ k-means
def seeds(rows: DataFrame, k: int, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """k-means||: in each round every value is a candidate with a probability that
    grows with its rows and its squared distance from those so far, about 2 k a
    round; the candidates, weighted by the rows next to them, are then thinned
    out to k."""
    columns = rows.columns
    values = written(rows.groupBy(*columns).agg(F.count("*").alias("_n")), "values")
    at = lambda r: F.xxhash64(*columns, F.lit(r))
    first = rows.orderBy(at(0), *columns).limit(1).collect()
    if not first:
        return np.zeros((0, len(columns)))
    centres = np.array([list(first[0])])
    for r in range(1, rounds + 1):
        total = summed(rows, lambda x, c=centres: _squares(x, c).min(1).sum()[None], 1)[0]
        if total <= 0:
            break
        away = F.least(*_distances(columns, centres)) if len(centres) > 1 else _distances(columns, centres)[0]
        lot = F.pmod(at(r), F.lit(1 << 40)) / float(1 << 40)
        found = values.filter(lot * total < 2 * k * away * F.col("_n")).select(*columns).collect()  # about 2 k rows
        centres = np.unique(np.concatenate([centres, np.array([list(x) for x in found]).reshape(-1, len(columns))]), axis=0)
    weight = summed(rows, lambda x: np.bincount(_squares(x, centres).argmin(1), minlength=len(centres)).astype(float), len(centres))
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(centres)):  # the heaviest times farthest next
        chosen.append(int((weight * _squares(centres, centres[chosen]).min(1)).argmax()))
    return centres[chosen]


def _distances(columns: Sequence[str], centres: np.ndarray) -> list[Column]:
    return [sum((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(columns, centre, strict=True)) for centre in centres]


def clusters(rows: DataFrame, k: int, rounds: int = MOVE_ROUNDS) -> list[tuple[list[float], float]]:
    """The centre and the greatest distance of each of up to ``k`` clusters, in order of their centres.

    Centres move to the mean of the rows next to them (of equally near ones the
    first) until none moves or ``rounds`` are over; one without rows stays."""
    centres, d = seeds(rows, k), len(rows.columns)
    for _ in range(rounds if len(centres) else 0):

        def sums(x: np.ndarray, c: np.ndarray = centres) -> np.ndarray:
            near, out = _squares(x, c).argmin(1), np.zeros((len(c), d + 1))
            np.add.at(out, near, np.column_stack([x, np.ones(len(x))]))
            return out.ravel()

        found = summed(rows, sums, len(centres) * (d + 1)).reshape(-1, d + 1)
        moved = np.where(found[:, -1:] > 0, found[:, :-1] / np.maximum(found[:, -1:], 1), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    if not len(centres):
        return []
    centres = centres[np.lexsort(centres.T[::-1])]
    away = _distances(rows.columns, centres)
    nearest = F.least(*away) if len(away) > 1 else away[0]
    which = F.array_position(F.array(*away), nearest) - 1
    radius = {r["which"]: r["far"] for r in rows.select(which.alias("which"), F.sqrt(nearest).alias("d")).groupBy("which").agg(F.max("d").alias("far")).collect()}
    return [(c.tolist(), radius.get(i, 0.0)) for i, c in enumerate(centres)]


# ----------------------------------------------------------------------- mixtures
@dataclass
class Mixture:
    """Components as (share, mean, covariance), and the objective after each round: the log-likelihood with the prior."""

    parts: list[tuple[float, list[float], np.ndarray]]
    objective: list[float]


def _log_terms(x: np.ndarray, parts: Sequence[tuple[float, Sequence[float], np.ndarray]]) -> np.ndarray:
    """rows x components: the logarithm of each component's share of the density."""
    out = np.empty((len(x), len(parts)))
    for k, (share, mean, covariance) in enumerate(parts):
        root = np.linalg.cholesky(covariance)
        z = np.linalg.solve(root, (x - np.asarray(mean)).T)
        out[:, k] = np.log(share) - 0.5 * (len(mean) * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(root)).sum()
    return out


def mixture(rows: DataFrame, k: int, rounds: int = EM_ROUNDS, least_gain: float = 1e-6) -> Mixture:
    """A Gaussian mixture of up to ``k`` components by expectation and
    maximisation from the clusters' centres.  The objective never falls; rounds
    end when a row gains less than ``least_gain`` in it, or after ``rounds``."""
    d = len(rows.columns)
    centres = [c for c, _ in clusters(rows, k)]
    if not centres:
        return Mixture([], [])
    whole = summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), 1 + d + d * d)
    n, mean = whole[0], whole[1 : d + 1] / whole[0]
    spread = whole[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    prior = PRIOR * n * np.diag(np.maximum(np.diag(spread), 1e-12))
    parts = [(1 / len(centres), c, spread / len(centres) + prior / n) for c in centres]
    gained: list[float] = []
    for _ in range(rounds):

        def statistics(x: np.ndarray, parts: list = parts) -> np.ndarray:
            terms = _log_terms(x, parts)
            top = terms.max(1)
            density = top + np.log(np.exp(terms - top[:, None]).sum(1))
            weight = np.exp(terms - density[:, None])
            off = [x - np.asarray(m) for _, m, _ in parts]  # about the means so far, which keeps digits
            return np.concatenate([[density.sum()], *[np.concatenate([[w.sum()], w @ o, ((o.T * w) @ o).ravel()]) for w, o in zip(weight.T, off, strict=True)]])

        found = summed(rows, statistics, 1 + len(parts) * (1 + d + d * d))
        gained.append(found[0] - 0.5 * sum(np.trace(np.linalg.solve(s, prior)) for *_, s in parts))
        if len(gained) > 1 and gained[-1] - gained[-2] < least_gain * n:
            break
        after = []
        for (share, m, s), row in zip(parts, found[1:].reshape(len(parts), -1), strict=True):
            w, shift = row[0], row[1 : d + 1] / max(row[0], 1e-300)
            if w <= 1e-9 * n:
                after.append((max(w, 1e-300) / n, m, s))  # no row is this component's: it stays where it is
                continue
            after.append((w / n, (np.asarray(m) + shift).tolist(), (row[d + 1 :].reshape(d, d) - w * np.outer(shift, shift) + prior) / w))
        parts = after
    return Mixture(sorted(parts, key=lambda p: list(p[1])), gained)
