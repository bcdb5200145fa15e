"""Causal filters and peak detectors over sessions.

Recurrences need a session's samples in order, so each session is one group of
a grouped-map pandas function; sessions spread over the cluster.  The helpers
work on numpy arrays of one session and leave no per-sample Python where a
recurrence has a vector form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Smoothing factors, threshold scales and refractory times.
PPG = {"dc": 0.0025, "low_pass": 0.18, "scale": 0.45, "refractory_us": 280_000, "magnitude": False}
ECG = {"dc": 0.004, "low_pass": 0.24, "scale": 0.55, "refractory_us": 240_000, "magnitude": True}
ENVELOPE_KEEP = 0.995


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """y0 = x0, then y += alpha (x - y)."""
    return pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def dc_blocked(x: np.ndarray, alpha: float) -> np.ndarray:
    """x less its running level."""
    return np.asarray(x, float) - ema(x, alpha)


def preprocessed(x: np.ndarray, dc: float, low_pass: float, **_) -> np.ndarray:
    """the level taken off, then smoothed."""
    return ema(dc_blocked(x, dc), low_pass)


def refractory_filter(times: np.ndarray, gap: int) -> np.ndarray:
    """Which of some ascending times stay if each must be ``gap`` or more after the last that stayed."""
    keep, last = np.zeros(len(times), bool), None
    for i, t in enumerate(times.tolist()):
        if last is None or t - last >= gap:
            keep[i], last = True, t
    return keep


def peaks(x: np.ndarray, t: np.ndarray, scale: float, refractory_us: int, magnitude: bool, **_) -> tuple[np.ndarray, np.ndarray]:
    """numbers and heights of the peaks: higher than the sample before,
    not lower than the one after, above ``scale`` of the envelope as of the
    sample after, and not within the refractory time of the last peak."""
    v = np.abs(x) if magnitude else np.asarray(x, float)
    envelope = ema(np.concatenate([[1.0], np.abs(v)]), 1 - ENVELOPE_KEEP)[1:]
    at = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:]) & (v[1:-1] > envelope[2:] * scale)) + 1
    at = at[refractory_filter(np.asarray(t)[at], refractory_us)]
    return at, v[at]


def butterworth_sections(kind: str, order: int, cutoff: float, rate: float) -> np.ndarray:
    """second-order sections (b0 b1 b2 a1 a2) of a Butterworth low- or
    high-pass of even order, by the bilinear transform of each pole pair."""
    order += order % 2
    w = 2 * np.pi * min(max(cutoff, 0.001 * rate), 0.45 * rate) / rate
    cos, sin = np.cos(w), np.sin(w)
    rows = []
    for k in range(order // 2):
        alpha = sin * np.sin(np.pi * (2 * k + 1) / (2 * order))
        edge = (1 - cos) if kind == "low" else (1 + cos)
        b = np.array([edge / 2, edge if kind == "low" else -edge, edge / 2])
        rows.append([*(b / (1 + alpha)), -2 * cos / (1 + alpha), (1 - alpha) / (1 + alpha)])
    return np.array(rows)


def cascade(x: np.ndarray, sections: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """sections in series, each in transposed direct form II."""
    y = np.asarray(x, float)
    for k, (b0, b1, b2, a1, a2) in enumerate(sections.tolist()):
        z1, z2 = (0.0, 0.0) if state is None else state[k].tolist()
        out = []
        for v in y.tolist():
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            out.append(o)
        y = np.array(out)
    return y


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """the cascade forwards and backwards over the signal with odd
    extensions at both ends; a signal that is too short only loses its mean."""
    x = np.asarray(x, float)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 2)
    if len(x) < 12 or pad <= 0:
        return x - x.mean() if len(x) else x
    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])

    def settled(v: np.ndarray) -> np.ndarray:
        state, level = [], v[0]
        for b0, b1, b2, a1, a2 in sections.tolist():
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = b2 - a2 * gain
            state.append([(b1 - a1 * gain + z2) * level, z2 * level])
            level *= gain
        return cascade(v, sections, np.array(state))

    return settled(settled(longer)[::-1])[::-1][pad:-pad]


def gap_filled(x: np.ndarray, least_finite: float = 0.98) -> np.ndarray | None:
    """missing samples by linear interpolation, at the edges the nearest
    one; None if too few are finite."""
    ok = np.isfinite(x)
    if not len(x) or ok.mean() < least_finite:
        return None
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), np.asarray(x)[ok])


def band_ratio(x: np.ndarray, rate: float, inner: tuple[float, float] = (5.0, 20.0), outer: tuple[float, float] = (1.0, 40.0)) -> float:
    """power in ``inner`` over power in ``outer`` of the spectrum without mean."""
    power = np.abs(np.fft.rfft(np.asarray(x, float) - np.mean(x))) ** 2
    frequency = np.fft.rfftfreq(len(x), 1 / rate)
    total = power[(frequency >= outer[0]) & (frequency <= outer[1])].sum()
    return float(power[(frequency >= inner[0]) & (frequency <= inner[1])].sum() / total) if total > 1e-12 else 0.0


def forward_mean4(x: np.ndarray) -> np.ndarray:
    """each of all but the last four samples is the mean of itself and the
    next three, in place, as integers cut towards zero."""
    y = np.array(x, np.int64)
    n = len(y) - 4
    if n > 0:
        total = y[:n] + y[1 : n + 1] + y[2 : n + 2] + y[3 : n + 3]
        y[:n] = np.trunc(total / 4).astype(np.int64)
    return y


def plateau_peaks(x: Sequence[int], height: int, most: int = 15) -> list[int]:
    """left ends of peaks above ``height``, flat ones included; the first ``most``."""
    x, found, i = list(x), [], 1
    while i < len(x) - 1 and len(found) < most:
        if x[i] > height and x[i] > x[i - 1]:
            width = 1
            while i + width < len(x) and x[i] == x[i + width]:
                width += 1
            if i + width < len(x) and x[i] > x[i + width]:
                found.append(i)
                i += width + 1
            else:
                i += width
        else:
            i += 1
    return found


def spaced_peaks(x: Sequence[int], found: Sequence[int], distance: int) -> list[int]:
    """the highest first, those more than ``distance`` from all taken so far and from the place before the first sample."""
    taken: list[int] = []
    for i in sorted(found, key=lambda i: (-x[i], i)):
        if i + 1 > distance and all(abs(i - j) > distance for j in taken):
            taken.append(i)
    return sorted(taken)


def over_sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on the rows of each session in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return f(rows.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def filtered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, f: Callable[[np.ndarray], np.ndarray], id_column: str) -> DataFrame:
    """``id_column`` and the filtered ``value`` of each row."""
    return over_sessions(
        df.select(*dict.fromkeys([*keys, *order, id_column, value])), keys, order, lambda r: pd.DataFrame({id_column: r[id_column], "y": f(r[value].to_numpy())}), f"{id_column} long, y double"
    )
