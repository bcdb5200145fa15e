"""Oxygen estimate from 100 pairs of samples at 25 a second, for engineering use only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import signals
from sensorloom.operators.dsp import forward_mean4, over_sessions, plateau_peaks, spaced_peaks
from sensorloom.operators.series import last_rows, ordered

RATE, PAIRS, RAW_ROWS, KEEP_EVERY = 25, 100, 400, 4
FULL, MIN_IR = 262143, 10000
#: Percentages by a hundredth of the ratio: the published parabola, rounded; the last entry is 0.
_RATIO = np.arange(183) / 100
TABLE = np.append(np.floor(-45.060 * _RATIO**2 + 30.354 * _RATIO + 94.845 + 0.5).astype(int), 0)

STATUS_OF_FAULT = {1: "out_of_range", 2: "saturated", 3: "no_signal"}


def _cut(a: int, b: int) -> int:
    """Integer division towards zero."""
    q = abs(a) // abs(b)
    return q if (a >= 0) == (b >= 0) else -q


def valleys(ir: np.ndarray) -> list[int]:
    """Where the signal is lowest in each beat."""
    turned = forward_mean4(int(ir.sum()) // len(ir) - ir.astype(np.int64))
    height = min(60, max(30, _cut(int(turned.sum()), len(turned))))
    return spaced_peaks(turned, plateau_peaks(turned, height), 4)


def _above_line(x: np.ndarray, a: int, b: int, at: int, read: int) -> int:
    """x[read] over the straight line between the valleys a and b, taken at ``at``."""
    return int(x[read]) - (int(x[a]) + _cut((int(x[b]) - int(x[a])) * (at - a), b - a))


def beat_ratios(ir: np.ndarray, red: np.ndarray, lows: Sequence[int], most: int = 5) -> list[int]:
    """A hundred times the ratio of ratios of each beat, the first ``most``."""
    found: list[int] = []
    for a, b in zip(lows[:-1], lows[1:], strict=True):
        if b - a <= 3 or len(found) == most:
            continue
        top_ir, top_red = a + int(np.argmax(ir[a:b])), a + int(np.argmax(red[a:b]))
        # Both are read where red is highest; the published estimator does so.
        upper = (_above_line(red, a, b, top_red, top_red) * int(ir[top_ir])) >> 7
        lower = (_above_line(ir, a, b, top_ir, top_red) * int(red[top_red])) >> 7
        if lower > 0 and upper != 0 and (ratio := _cut(upper * 100, lower)) >= 0:
            found.append(ratio)
    return found


def estimate(ir: np.ndarray, red: np.ndarray) -> tuple[int | None, int | None]:
    """(percent, beats a minute), None where it can't be told."""
    lows = valleys(ir)
    rate = (RATE * 60) // ((lows[-1] - lows[0]) // (len(lows) - 1)) if len(lows) >= 2 else None
    ratios = sorted(beat_ratios(ir, red, lows))
    if not ratios:
        return None, rate
    middle = len(ratios) // 2
    ratio = (ratios[middle - 1] + ratios[middle]) // 2 if middle > 1 else ratios[middle]
    return (int(TABLE[ratio]) if 2 < ratio < 184 else None), rate


def evaluate(ir: np.ndarray, red: np.ndarray, good: bool = True, n: int | None = None) -> dict:
    """The last 400 samples: a fault anywhere rejects them, else one of
    four is used, counted from the session's first.  ``n`` is the session's length
    if only its last samples are given."""
    n = len(ir) if n is None else n
    if len(ir) < RAW_ROWS:
        return {"status": "not_ready", "percent": None, "bpm": None}
    if not good:
        return {"status": "quality_rejected", "percent": None, "bpm": None}
    kept = (n - 1) // KEEP_EVERY * KEEP_EVERY - KEEP_EVERY * np.arange(PAIRS)[::-1] - (n - len(ir))
    x, y = ir[-RAW_ROWS:], red[-RAW_ROWS:]
    faults = np.select([(x > FULL) | (y > FULL), (x == FULL) | (y == FULL), (x == 0) | (y == 0) | (x < MIN_IR)], [1, 2, 3], 0)
    if faults.any():
        return {"status": STATUS_OF_FAULT[int(faults[np.flatnonzero(faults)[0]])], "percent": None, "bpm": None}
    percent, bpm = estimate(ir[kept], red[kept])
    return {"status": "ok" if percent is not None else "algorithm_rejected", "percent": percent, "bpm": bpm}


def gate_status(df: DataFrame, keys: Sequence[str], order: Sequence[str], ir: str, red: str, good: Column, rows: int = RAW_ROWS) -> DataFrame:
    """O03 at each row: ``gate``, by the last ``rows`` rows: not_ready before there are
    so many, quality_rejected, the first fault's status, else ok."""
    w = ordered(keys, order)
    fault = signals.spo2_fault(F.col(ir), F.col(red), MIN_IR)
    first = F.first(F.when(fault > 0, fault), ignorenulls=True).over(w.rowsBetween(1 - rows, 0))
    status = F.when(F.col("_rn") < rows, "not_ready").when(~F.col("_good"), "quality_rejected")
    for code, name in STATUS_OF_FAULT.items():
        status = status.when(F.col("_fault") == code, name)
    return df.withColumns({"_rn": F.row_number().over(w), "_good": good, "_fault": first}).withColumn("gate", status.otherwise("ok")).drop("_rn", "_good", "_fault")


def session_oxygen(df: DataFrame, keys: Sequence[str], order: Sequence[str], ir: str, red: str) -> DataFrame:
    """status, percent and bpm of each session's last samples; Spark cuts to these,
    so that a session of any length is one small group."""
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", status string, percent int, bpm int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = evaluate(rows[ir].to_numpy(), rows[red].to_numpy(), n=int(rows["_n"].iloc[0]))
        out = pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, **found}])
        return out.astype({"percent": "Int32", "bpm": "Int32"})

    rows = df.select(*dict.fromkeys([*keys, *order, ir, red]))
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    last = last_rows(rows, keys, order, RAW_ROWS).join(sizes, same).select(*rows.columns, "_n")
    return over_sessions(last, keys, order, run, schema)
