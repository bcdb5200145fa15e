import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import intervals, quantiles, series



def groups(seed=4):
    rng = np.random.default_rng(seed)
    made = {
        1: rng.normal(size=3000),
        2: np.round(rng.normal(size=2000), 1),  # few values
        3: np.full(900, 7.25),
        4: 10.0 ** rng.uniform(-300, 300, 1500),  # many orders of magnitude
        5: rng.normal(size=40),
        6: np.concatenate([np.full(700, -1.0), rng.normal(size=300), [1.7e308, -1.7e308]]),
        None: rng.integers(0, 50, 800).astype(float),
    }
    rows = [(k, i, float(x) if i % 11 else None) for k, v in made.items() for i, x in enumerate(v)]
    return rows


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(groups(), "k int, i long, v double").repartition(5)


def shares():
    return {"low": (F.col("v"), 0.25), "mid": (F.col("v"), 0.5), "most": (F.abs("v"), 0.9), "top": (F.col("v"), 1.0), "none": (F.when(F.col("v") > 1.79e308, 1.0), 0.5)}


@pytest.mark.parametrize(("limit", "bins"), [(100, 64), (10, 4)])
def test_searched_percentiles_are_the_aggregate_ones(spark, frame, monkeypatch, limit, bins):
    expected = sorted(map(tuple, quantiles.aggregated(frame, ["k"], {"n": F.count("*")}, shares(), None).collect()), key=repr)
    monkeypatch.setattr(quantiles, "RANGE_ROWS", limit)
    monkeypatch.setattr(quantiles, "BINS", bins)
    large = quantiles.large_groups(frame, ["k"])
    assert large.count() == (7 if limit == 10 else 6)
    got = sorted(map(tuple, quantiles.aggregated(frame, ["k"], {"n": F.count("*")}, shares(), large).collect()), key=repr)
    assert got == expected


def test_each_pass_leaves_a_bin_of_its_range(spark, frame, monkeypatch):
    """After the passes no rank's range has more rows than a task may hold, unless they are one value."""
    monkeypatch.setattr(quantiles, "RANGE_ROWS", 60)
    seen = []
    picked = quantiles._picked
    monkeypatch.setattr(quantiles, "_picked", lambda rows, targets, names: (seen.append(targets.toPandas()), picked(rows, targets, names))[1])
    rows = frame.filter("k <> 4")
    quantiles.percentiles(rows, ["k"], {"mid": (F.col("v"), 0.5)}, quantiles.large_groups(rows, ["k"])).collect()
    left = seen[0][seen[0]["lo"] < seen[0]["hi"]]
    assert len(seen[0]) and (left["rows"] <= 60).all()


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_prefix_sums(spark, limit):
    rng = np.random.default_rng(8)
    rows = [(None if k == 3 else k, float(i) / 7, int(rng.integers(0, 5))) for k in range(4) for i in range(10 + 300 * k)]
    df = spark.createDataFrame(rows, "k int, s double, n long").repartition(3)
    got = quantiles.prefix_sums(df, ["k"], ["s"], "n", "before", limit).toPandas().sort_values("s")
    for k in (0, 1, 2, None):
        mine = got[got["k"].isna()] if k is None else got[got["k"] == k]
        assert mine["before"].tolist() == [0, *mine["n"].cumsum().tolist()[:-1]]


def test_features_of_large_groups_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(u, i, float(rng.normal(800, 90)), i * 5000 + int(rng.integers(0, 900)), i) for u in (1, 2) for i in range(400 * u)]
    df = spark.createDataFrame(rows, "user_id long, i long, rr_ms double, ts_us long, seq long").repartition(4)
    scored = df.select("user_id", (F.col("i") % 3 == 0).cast("int").alias("y"), (F.floor(F.col("rr_ms")) / 1000).alias("p"))
    keys, order = ["user_id"], ["i"]
    runs = [
        lambda: intervals.stress_features(df, keys, order, "rr_ms"),
        lambda: intervals.af_features(df, keys, order, "rr_ms"),
        lambda: intervals.median_rate(df, keys, "rr_ms"),
        lambda: intervals.interval_summary(df.withColumn("s", F.col("rr_ms") / 1000), keys, order, "s"),
        lambda: series.stream_validation(df, keys, ["seq"], "ts_us", "seq"),
        lambda: series.classification_metrics(scored, keys, "y", "p"),
    ]
    whole = [f().toPandas().sort_values("user_id").reset_index(drop=True) for f in runs]
    monkeypatch.setattr(quantiles, "RANGE_ROWS", 100)
    for f, expected in zip(runs, whole, strict=True):
        pd.testing.assert_frame_equal(f().toPandas().sort_values("user_id").reset_index(drop=True), expected)
