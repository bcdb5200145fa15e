import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import resampling as R


@pytest.mark.parametrize("most", [1, 2, 7, 60])
def test_best_ratio_is_that_of_all_fractions(most):
    rng = random.Random(most)
    for x in [1.0, 0.5, 1 / 3, 0.2978, np.pi, 1e-9, 1e9, 48_000 / 44_100, *[rng.uniform(0, 5) for _ in range(60)]]:
        p, q = R.best_ratio(x, most)
        best = min(abs(Fraction(a, b) - Fraction(x)) for a in range(1, most + 1) for b in range(1, most + 1))
        assert abs(Fraction(p, q) - Fraction(x)) == best and max(p, q) <= most
    with pytest.raises(ValueError, match="rate"):
        R.best_ratio(0.0, 5)


def test_known_ratios():
    assert R.best_ratio(48_000 / 44_100, 1000) == (160, 147) and R.best_ratio(np.pi, 400) == (355, 113) and R.best_ratio(0.75, 10**9) == (3, 4)


def test_decimation_keeps_slow_waves_and_stops_fast_ones(spark):
    t = np.arange(2000)
    rows = [(k, int(i), float(np.sin(2 * np.pi * f * i))) for k, f in ((1, 0.01), (2, 0.31)) for i in t]
    got = R.decimated(spark.createDataFrame(rows, "k int, i long, v double").repartition(3), ["k"], ["i"], "v", 4).toPandas().sort_values(["k", "m"])
    slow, fast = (got.loc[got["k"] == k, "y"].to_numpy() for k in (1, 2))
    assert len(slow) == len(fast) == 500
    inner = slice(20, 480)
    assert np.abs(slow[inner] - np.sin(2 * np.pi * 0.01 * t[::4])[inner]).max() < 0.02 and np.abs(fast[inner]).max() < 0.01


@pytest.mark.parametrize("moments", [2, 3, 4, 6, 8])
def test_symlets_are_orthogonal_and_nearer_to_linear_phase(moments):
    taps = R.symlet(moments)
    assert len(taps) == 2 * moments and taps.sum() == pytest.approx(np.sqrt(2))
    for shift in range(moments):
        assert (taps[2 * shift :] * taps[: len(taps) - 2 * shift]).sum() == pytest.approx(float(shift == 0), abs=1e-6)
    high = taps[::-1] * np.where(np.arange(len(taps)) % 2, 1.0, -1.0)
    for k in range(moments):
        assert abs((high * np.arange(len(taps), dtype=float) ** k).sum()) < 1e-4 * len(taps) ** k
    lean = lambda x: abs((x**2 * np.arange(len(x))).sum() - (len(x) - 1) / 2)
    assert moments < 4 or lean(taps) < lean(R.daubechies(moments))


@pytest.mark.parametrize("rows", [16, 1 << 16])
@pytest.mark.parametrize(("low", "levels"), [(R.daubechies(1), 3), (R.daubechies(2), 2), (R.symlet(4), 3)])
def test_blocks_give_the_wavelets_of_whole_sessions(spark, rows, low, levels):
    rng = np.random.default_rng(4)
    signals = {1: rng.normal(size=500), 2: rng.normal(size=16), 3: rng.normal(size=33), 4: rng.normal(size=1), 5: rng.normal(size=48), None: rng.normal(size=131)}
    data = [(k, int(i), float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k int, t long, v double").repartition(4)
    got = R.session_wavelet(df, ["k"], ["t"], "v", levels, low, rows).toPandas()
    for k, x in signals.items():
        rest, parts = x[None], []
        for _ in range(levels):
            rest, detail = R.halved(rest, low)
            parts.append(detail[0])
        mine = got[got["k"].isna()] if k is None else got[got["k"] == k]
        for c, want in enumerate([rest[0], *parts[::-1]]):
            found = mine[mine["component"] == c].sort_values("i")
            assert found["i"].tolist() == list(range(len(want))) and np.allclose(found["x"], want, atol=1e-9), (k, c)
    assert df.filter(F.col("k") > 90).transform(lambda d: R.session_wavelet(d, ["k"], ["t"], "v", 1, low, rows)).collect() == []
