"""Finite filters, changes of rate and wavelets of ordered samples.

A finite filter needs only the last few rows, so it is a window frame; a change
of rate sends each sample to the few results that it is part of.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce
from math import comb, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sensorloom.operators import blocks, series
from sensorloom.storage import written


def sinc_taps(rate: float, size: int, low_pass: float = 0.0, high_pass: float = 0.0) -> np.ndarray:
    """A windowed sinc (Hamming) of gain 1; a high pass is a low pass with
    every other tap, from the first, negated.  One of the cut-offs must be given."""
    if not low_pass and not high_pass:
        raise ValueError("a low-pass or a high-pass cut-off is needed")
    cut = (high_pass or low_pass) / rate
    at = np.arange(size) - size // 2
    taps = 2 * np.pi * cut * np.sinc(2 * cut * at) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1)))
    taps /= taps.sum()
    if not low_pass:
        taps[::2] *= -1
    return taps


def fixed_point(taps: np.ndarray) -> np.ndarray:
    """Taps of 16 bits."""
    return np.trunc(taps * 32767).astype(int)


def _weighted(value: Column, keys: Sequence[str], order: Sequence[str], taps: Sequence[float]) -> Column:
    """The taps' sum over the row and those before it: a product for each lag, no array of a row's neighbours."""
    w, zero = series.ordered(keys, order), F.lit(type(taps[0])(0)).cast("double" if isinstance(taps[0], float) else "long")
    before = lambda k: F.coalesce(F.lag(value, k).over(w), zero) if k else value
    return reduce(lambda total, k: total + before(k) * F.lit(taps[k]), range(len(taps)), zero)


def fir(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, taps: np.ndarray, output: str = "y") -> DataFrame:
    """The taps' sum over the last rows; rows before the first are zeros.  ``value`` may hold no null."""
    return df.withColumn(output, _weighted(F.col(value).cast("double"), keys, order, [float(t) for t in taps]))


def fir_fixed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, taps: np.ndarray, output: str = "y") -> DataFrame:
    """V30 in whole numbers of 16 bits: sums rounded, cut to the type's range."""
    total = _weighted(F.col(value).cast("long"), keys, order, [int(t) for t in fixed_point(taps)]) + (1 << 14)
    return df.withColumn(output, F.greatest(F.lit(-32768), F.least(F.lit(32767), F.shiftright(total, 15))).cast("int"))


def resampled(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, up: int, down: int, taps: Sequence[float]) -> DataFrame:
    """Keys, ``m`` and ``y``: the samples with ``up - 1`` zeros after each,
    through ``taps`` centred on the sample (times ``up``), and each ``down``-th of that."""
    up, down = up // gcd(up, down), down // gcd(up, down)
    half, n_taps = (len(taps) - 1) // 2, len(taps)
    rows = series.positions(df.select(*dict.fromkeys([*keys, *order, value])), keys, order)
    n_out = F.ceil(F.count("*").over(Window.partitionBy(*keys)) * up / down)
    # Sample k meets tap m * down - k * up + half, for those m where there is one.
    rows = rows.withColumn("_n", n_out).withColumn("_at", F.col("pos") * up - half)
    first = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("_at") / down))
    last = F.least(F.col("_n") - 1, F.floor((F.col("_at") + n_taps - 1) / down))
    numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    parts = rows.select(*keys, "_at", F.col(value).cast("double").alias("_x"), F.explode(numbers).alias("m"))
    tap = F.element_at(F.array(*[F.lit(float(t) * up) for t in taps]), (F.col("m") * down - F.col("_at") + 1).cast("int"))
    return parts.groupBy(*keys, "m").agg(F.sum(F.col("_x") * tap).alias("y"))


def daubechies(moments: int) -> np.ndarray:
    """The low-pass filter of the Daubechies wavelet with as many vanishing
    moments (1 is Haar's), from the roots of its polynomial inside the unit circle."""
    poly = [comb(moments - 1 + k, k) for k in range(moments)][::-1]
    taps = np.array([1.0])
    for _ in range(moments):
        taps = np.convolve(taps, [1.0, 1.0])
    for y in np.roots(poly):
        z = np.roots([1.0, 4 * y - 2, 1.0])
        taps = np.convolve(taps, [1.0, -z[np.argmin(np.abs(z))]])
    taps = np.real(taps)
    return taps * (np.sqrt(2) / taps.sum())


def halved(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of each row of ``x``, with mirrored ends."""
    n, m = len(low), x.shape[-1]
    high = low[::-1] * np.where(np.arange(n) % 2, 1.0, -1.0)
    longer = np.pad(x, ((0, 0), (n - 2, n)), mode="symmetric")
    views = np.lib.stride_tricks.sliding_window_view(longer, n, axis=-1)[:, ::2][:, : (m + n - 1) // 2]
    return views @ low[::-1], views @ high[::-1]


def wavelet_components(windows: DataFrame, keys: Sequence[str], value: str, levels: int, moments: int) -> DataFrame:
    """Keys, w, component (0 the approximation, then details from the coarsest),
    i and x of each window's wavelet transform; all windows have one size."""
    low = daubechies(moments)

    @pandas_udf("array<array<double>>")
    def transform(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            if not len(rows):
                yield pd.Series([], dtype=object)
                continue
            rest, details = np.stack(rows.to_numpy()).astype(float), []
            for _ in range(levels):
                rest, detail = halved(rest, low)
                details.append(detail)
            yield pd.Series([[list(part[i]) for part in (rest, *details[::-1])] for i in range(len(rows))])

    ordered = F.sort_array(F.collect_list(F.struct("i", F.col(value).cast("double").alias("x"))))
    arrays = windows.groupBy(*keys, "w").agg(F.transform(ordered, lambda s: s["x"]).alias("x"))
    split = arrays.select(*keys, "w", F.posexplode(transform("x")).alias("component", "_x"))
    return split.select(*keys, "w", "component", F.posexplode("_x").alias("i", "x"))


def best_ratio(x: float, most: int) -> tuple[int, int]:
    """The fraction nearest to ``x`` > 0 whose terms are ``most`` at most, by the Stern-Brocot tree.

    Runs of steps to one side are taken at once, so a very small or large x needs few."""
    if not 0 < x < float("inf") or most < 1:
        raise ValueError("a positive finite rate and a positive bound are needed")
    exact = Fraction(x)
    low, high = (0, 1), (1, 0)
    while True:
        # As many steps right as stay at or below x, then as many left as stay above.
        for right in (True, False):
            (a, b), (c, d) = (low, high) if right else (high, low)
            up, down = (exact.numerator * b - exact.denominator * a), (exact.denominator * c - exact.numerator * d)
            up, down = (up, down) if right else (-up, -down)
            k = up // down if down else most
            k = min(k, *[(most - s) // t for s, t in ((a, c), (b, d)) if t])
            a, b = a + k * c, b + k * d
            low, high = ((a, b), high) if right else (low, (a, b))
        nearer = (low[0] + high[0], low[1] + high[1])
        if Fraction(*low) == exact or max(nearer) > most:
            break
    ends = [f for f in (low, high) if 0 < min(f) and max(f) <= most]
    return min(ends, key=lambda f: (abs(Fraction(*f) - exact), f))


def decimated(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, factor: int, taps: int = 61) -> DataFrame:
    """Keys, ``m`` and ``y``: each ``factor``-th sample of the signal through a low pass at four fifths of the new half rate."""
    return resampled(df, keys, order, value, 1, factor, sinc_taps(1.0, taps, low_pass=0.4 / factor).tolist())


def symlet(moments: int) -> np.ndarray:
    """The low-pass filter with as many vanishing moments whose phase is nearest to linear: of each group of roots
    of the Daubechies polynomial the ones inside or outside the unit circle, by the choice that bends the phase least."""
    poly = [comb(moments - 1 + k, k) for k in range(moments)][::-1]
    pairs = [np.roots([1.0, 4 * y - 2, 1.0]) for y in np.roots(poly)]
    groups: list[list[np.ndarray]] = []
    for pair in pairs:  # a root and its conjugate are chosen together
        same = next((g for g in groups if len(g) == 1 and abs(g[0].imag).max() > 1e-9 and min(abs(pair - g[0][0].conj())) < 1e-6), None)
        groups.append([pair]) if same is None else same.append(pair)
    w = np.linspace(0.01, np.pi * 0.9, 200)
    best = None
    for choice in range(1 << len(groups)):
        taps = np.array([1.0 + 0j])
        for _ in range(moments):
            taps = np.convolve(taps, [1.0, 1.0])
        for g, pairs_ in enumerate(groups):
            for pair in pairs_:
                inside = pair[np.argmin(np.abs(pair))]
                taps = np.convolve(taps, [1.0, -(1 / inside if choice >> g & 1 else inside)])
        taps = np.real(taps)
        taps *= np.sqrt(2) / taps.sum()
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(len(taps)))) @ taps))
        bend = np.abs(phase - np.polyval(np.polyfit(w, phase, 1), w)).max()
        if best is None or bend < best[0] - 1e-9:
            best = bend, taps
    return best[1]


def session_wavelet(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, levels: int, low: np.ndarray, rows: int | None = None) -> DataFrame:
    """Keys, component (0 the approximation, then details from the coarsest), i and x of the wavelet transform of
    whole sessions of any length.

    A level works in blocks, each with its neighbours' next rows (the filter's length); ends are mirrored as
    in ``halved``.  ``low`` is an orthogonal low-pass filter of even length."""
    rows = rows or blocks.BLOCK_ROWS
    n, high = len(low), low[::-1] * np.where(np.arange(len(low)) % 2, 1.0, -1.0)
    placed, most = blocks.in_blocks(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, rows)
    rest, details = placed.select(*keys, "idx", F.col(value).cast("double").alias("x")), []
    names = ", ".join(f"`{k}` {t}" for k, t in rest.dtypes if k in keys)
    for _ in range(levels):
        sizes = rest.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        data = rest.join(sizes, same).select(*keys, "idx", "x", "_n").withColumn("block", F.floor(F.col("idx") / rows).cast("long"))
        data = blocks.with_halo(data, n, n, rows)

        def halves(table: pa.Table, edges: np.ndarray) -> pa.Table:
            x, idx, block, size, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("x", "idx", "block", "_n", "own"))
            head, out, lows, highs = [], [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if not own[a:b].any():
                    continue
                total, here = int(size[a]), int(block[a])
                ends = (total + n - 1) // 2
                first = -(-here * rows // 2)
                last = ends if here == (total - 1) // rows else min(ends, -(-(here + 1) * rows // 2))
                at = 2 * np.arange(first, last)[:, None] + np.arange(n) - (n - 2)
                at = at % (2 * total)
                at = np.where(at < total, at, 2 * total - 1 - at) - idx[a]
                part = x[a:b][at]
                lows.append(part @ low[::-1])
                highs.append(part @ high[::-1])
                head += [a] * (last - first)
                out.append(np.arange(first, last))
            joined = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]))
            return pa.table({**{k: table.column(k).take(pa.array(head, pa.int64())) for k in keys}, "idx": joined(out, np.int64), "x": joined(lows, float), "detail": joined(highs, float)})

        split = blocks.over_runs(data, [*keys, "block"], ["idx"], halves, f"{names}, idx long, x double, detail double")
        split = written(split, "wavelet") if most > 1 else split
        details.append(split.select(*keys, "idx", F.col("detail").alias("x")))
        rest = split.select(*keys, "idx", "x")
    parts = [rest, *details[::-1]]
    return reduce(DataFrame.unionByName, [p.select(*keys, F.lit(i).alias("component"), F.col("idx").alias("i"), "x") for i, p in enumerate(parts)])
