"""Boxes, tracks, scores, rates and wavelets against plain loops."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import detections, resampling, spectral
from sensorloom.plans import catalog
from sensorloom.sources import sinks
from sensorloom.streaming import sessions


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 9, (n, m)).astype(float)
        of = detections.assignment(cost)
        assert (of >= 0).sum() == len(set(of[of >= 0])) == min(n, m)
        short = cost if n <= m else cost.T
        assert sum(cost[i, j] for i, j in enumerate(of) if j >= 0) == min(sum(short[i, j] for i, j in enumerate(p)) for p in permutations(range(short.shape[1]), len(short)))


@pytest.mark.parametrize("top", [4, 1 << 40])
def test_assignments_side_by_side_are_those_of_each(top):
    """Ties too fall as in one frame alone."""
    rng = np.random.default_rng(top)
    for n, m in ((1, 1), (3, 3), (2, 5), (6, 4), (8, 8)):
        costs = rng.integers(0, top, (80, n, m)).astype(float)
        assert (detections.assignments(costs) == [detections.assignment(c) for c in costs]).all()


def test_frames_are_paired_many_in_a_call(spark):
    """Two thousand frames of different shapes take as many costs as there are shapes in a batch, not one a frame."""
    rng = np.random.default_rng(8)
    rows = [(f, side, i, *map(float, rng.integers(0, 20, 4))) for f in range(2000) for side in (0, 1) for i in range(rng.integers(0, 4))]
    df = spark.createDataFrame(rows, "frame long, side int, id long, x1 double, y1 double, x2 double, y2 double")
    calls = spark.sparkContext.accumulator(0)

    def cost(a, b):
        calls.add(1)
        return detections.squared_distance(a, b)

    got = detections.aligned(df.filter("side = 0").drop("side"), df.filter("side = 1").drop("side"), ["frame"], cost)
    found, expected = sorted(map(tuple, got.collect())), []
    assert calls.value <= 9 * 2 * spark.sparkContext.defaultParallelism
    for f in range(2000):
        a, b = ([r for r in rows if r[0] == f and r[1] == side] for side in (0, 1))
        if a and b:
            c = detections.squared_distance(np.array([r[3:] for r in a]), np.array([r[3:] for r in b]))
            expected += [(f, i, int(j), c[i, j]) for i, j in enumerate(detections.assignment(c)) if j >= 0]
    assert found == expected


def test_overlaps_of_odd_boxes():
    others = np.array([[0, 0, 2, 2], [2, 2, 0, 0], [1, 1, 3, 3], [5, 5, 6, 6], [1, 1, 1, 3]], float)
    assert np.allclose(detections.overlaps(others[0], others), [1, 1, 1 / 7, 0, 0])


def test_aligned_frames(spark):
    """A frame without tracks or without boxes has no pair; far ones go."""
    schema = "frame long, id long, x1 double, y1 double, x2 double, y2 double"
    tracks = spark.createDataFrame([(1, 10, 0.0, 0.0, 2.0, 2.0), (1, 11, 10.0, 0.0, 12.0, 2.0), (2, 12, 0.0, 0.0, 1.0, 1.0)], schema)
    found = spark.createDataFrame([(1, 1, 10.0, 0.0, 12.0, 2.0), (1, 2, 0.0, 0.0, 2.0, 1.0), (1, 3, 50.0, 50.0, 51.0, 51.0), (3, 4, 0.0, 0.0, 1.0, 1.0)], schema)
    assert sorted(map(tuple, detections.aligned(tracks, found, ["frame"]).collect())) == [(1, 10, 2, 0.5), (1, 11, 1, 0.0)]
    assert detections.aligned(tracks, found, ["frame"], most_cost=0.1).count() == 1
    assert detections.aligned(tracks.limit(0), found, ["frame"]).count() == 0


def test_calibrated_events(spark):
    rng = np.random.default_rng(5)
    scores = rng.random((200, 3))
    df = spark.createDataFrame([(i % 2, i, *map(float, s)) for i, s in enumerate(scores)], "k int, i int, a double, b double, c double")
    got = sorted((r["k"], r["i"], r["label"]) for r in detections.calibrated_events(df, ["k"], ["i"], ["a", "b", "c"], 3, 0.6, 4).collect())
    expected = []
    for k in range(2):
        own, wait = scores[k::2], 0
        for i in range(len(own)):
            mean = own[max(0, i - 2) : i + 1].mean(0)
            if wait:
                wait -= 1
            elif mean.max() >= 0.6:
                expected.append((k, 2 * i + k, "abc"[int(mean.argmax())]))
                wait = 4
    assert got == expected and expected


def test_filters_keep_constants_and_stop_them():
    low, high = resampling.sinc_taps(100.0, 31, low_pass=10.0), resampling.sinc_taps(100.0, 31, high_pass=40.0)
    gain = lambda taps, f: abs(np.exp(-2j * np.pi * f / 100 * np.arange(len(taps))) @ taps)
    assert gain(low, 0) == pytest.approx(1) and gain(low, 30) < 0.01
    assert gain(high, 50) == pytest.approx(1) and gain(high, 1) < 0.01
    with pytest.raises(ValueError):
        resampling.sinc_taps(100.0, 31)


@pytest.mark.parametrize(("up", "down"), [(3, 2), (1, 4), (4, 2), (5, 7)])
def test_resampled(spark, up, down):
    x, taps = np.random.default_rng(1).random(40), np.random.default_rng(2).random(9)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    got = resampling.resampled(df, ["k"], ["i"], "v", up, down, taps.tolist()).orderBy("m").toPandas()["y"].to_numpy()
    u, d = up // np.gcd(up, down), down // np.gcd(up, down)
    wide = np.zeros(len(x) * u)
    wide[::u] = x
    expected = np.convolve(wide, taps * u)[4 : 4 + len(wide)][::d]
    assert np.allclose(got, expected)


@pytest.mark.parametrize("moments", [1, 2, 4, 8])
def test_wavelets_are_orthonormal(moments):
    """Even shifts of the filter are orthogonal, and the detail of a polynomial of lower degree vanishes."""
    low = resampling.daubechies(moments)
    for s in range(moments):
        assert low[2 * s :] @ low[: len(low) - 2 * s] == pytest.approx(float(s == 0), abs=1e-6)
    line = (np.arange(64.0)[None] / 64) ** (moments - 1)
    detail = resampling.halved(line, low)[1][0]
    assert np.abs(detail[moments:-moments]).max() < 1e-5


def test_wavelet_features(spark):
    rng = np.random.default_rng(4)
    x = rng.random((2, 64))
    df = spark.createDataFrame([(k, 0, i, float(v)) for k in range(2) for i, v in enumerate(x[k])], "k int, w long, i long, x double")
    parts = resampling.wavelet_components(df, ["k"], "x", 2, 2)
    got = spectral.component_features(parts, ["k", "w", "component"]).toPandas().set_index(["k", "component"])
    rest, fine = resampling.halved(x, resampling.daubechies(2))
    rest, coarse = resampling.halved(rest, resampling.daubechies(2))
    for k in range(2):
        for i, part in enumerate((rest[k], coarse[k], fine[k])):
            row, z = got.loc[(k, i)], (part - part.mean()) / part.std()
            share = np.histogram(part, 100)[0] / len(part)
            expected = {
                "mean": part.mean(), "std": part.std(), "variance": part.var(), "rms": np.sqrt((part**2).mean()), "skew": (z**3).mean(), "kurtosis": (z**4).mean() - 3,
                "p05": np.percentile(part, 5), "p25": np.percentile(part, 25), "p50": np.percentile(part, 50), "p75": np.percentile(part, 75), "p95": np.percentile(part, 95),
                "zero_crossings": (part[1:] * part[:-1] < 0).sum() / len(part), "mean_crossings": (z[1:] * z[:-1] < 0).sum() / len(part), "entropy": -(share[share > 0] * np.log(share[share > 0])).sum(),
            }
            assert {n: row[n] for n in expected} == pytest.approx(expected, abs=1e-9)


def test_model_matches_newtons_method(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").filter("l_orderkey % 5 <> 0").toPandas()
    x = rows[["l_quantity", "l_discount", "l_tax"]].astype(float).to_numpy()
    y = (rows["l_linestatus"] == "F").to_numpy(float)
    mean, scale = x.mean(0), x.std(0, ddof=1)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b, ridge = np.zeros(4), 0.01 * np.diag([1, 1, 1, 0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T * (p * (1 - p)) @ z / len(y) + ridge, z.T @ (p - y) / len(y) + ridge @ b)
    parameters = catalog.queries()["k13_model_parameters"](spark, small)
    got = parameters.orderBy("pos").toPandas()
    assert np.allclose(got["coef"], b, atol=1e-4) and np.allclose(got["mean"][:3], mean) and np.allclose(got["scale"][:3], scale)
    scored = catalog.queries()["m04_trained_model"](spark, small).toPandas()
    tested = spark.read.parquet(f"{small}/lineitem.parquet").filter("l_orderkey % 5 = 0").toPandas()[["l_quantity", "l_discount", "l_tax"]].astype(float)
    expected = 1 / (1 + np.exp(-(((tested - mean) / scale) @ b[:3] + b[3])))
    assert np.allclose(np.sort(scored["p"]), np.sort(expected), atol=1e-4)
    sinks.write_model(parameters, str(tmp_path / "model"))
    assert spark.read.option("header", True).csv(str(tmp_path / "model/csv")).count() == 4 == spark.read.json(str(tmp_path / "model/json")).count()


def test_rhythm_gates(spark):
    from sensorloom.functions import signals as fn

    rows = [(False, 64, "ready", True, 0.9), (True, 0, "not_ready", True, 0.9), (True, 0, "quality_rejected", True, 0.9), (True, 0, "other", True, 0.9), (True, 0, "ready", False, 0.9),
            (True, 0, "ready", True, None), (True, 0, "ready", True, float("nan")), (True, 0, "ready", True, 0.9), (True, 0, "ready", True, 0.5)]
    df = spark.createDataFrame(rows, "good boolean, reasons int, vector string, model boolean, p double")
    branch = fn.rhythm_branch(*[F.col(x) for x in df.columns])
    got = [(r["status"], r["reason_flags"], r["label"], r["alert"]) for r in df.coalesce(1).select(*[v.alias(k) for k, v in branch.items()]).collect()]
    assert got == [("quality_rejected", 64, None, False), ("not_ready", 1, None, False), ("quality_rejected", 2, None, False), ("invalid_input", 0, None, False), ("not_ready", 4, None, False),
                   ("error", 8, None, False), ("error", 8, None, False), ("valid", 0, "AF", True), ("valid", 0, "nonAF", False)]
