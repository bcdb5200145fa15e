import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import blocks as B
from sensorloom.operators import dsp

KEYS, ORDER = ["user_id"], ["ts_us", "event_id"]
SECTIONS = dsp.butterworth_sections("low", 4, 20.0, 200.0)


def sessions(sizes, seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for user, n in sizes.items():
        t = np.sort(rng.integers(0, 3 * n + 1, n))  # ties in time
        frames.append(pd.DataFrame({"user_id": user, "ts_us": t, "value": 50 + np.cumsum(rng.normal(size=n))}))
    rows = pd.concat(frames, ignore_index=True)
    rows["user_id"] = rows["user_id"].astype("Int64")
    rows["event_id"] = rng.permutation(len(rows))
    return rows.sort_values(["user_id", "ts_us", "event_id"]).reset_index(drop=True)


SIZES = {1: 1, 2: 2, 3: 49, 4: 50, 5: 51, 6: 13, 7: 1234, 8: 100, None: 77}


def frame(spark, rows):
    shuffled = rows.sample(frac=1, random_state=3)
    data = [(None if pd.isna(u) else int(u), int(t), float(v), int(e)) for u, t, v, e in shuffled.itertuples(index=False)]
    return spark.createDataFrame(data, "user_id long, ts_us long, value double, event_id long").repartition(5)


def by_session(rows):
    return [g for _, g in rows.groupby("user_id", dropna=False)]


FILTERS = {
    "smooth": (B.ema(0.18), lambda x: dsp.ema(x, 0.18)),
    "level": (B.ema(0.05, of_level=True), lambda x: dsp.dc_blocked(x, 0.05)),
    "both": (B.level_then_smooth(0.0025, 0.18), lambda x: dsp.preprocessed(x, 0.0025, 0.18)),
    "envelope": (B.ema(0.005, begins=1.0), lambda x: dsp.ema(np.concatenate([[1.0], x]), 0.005)[1:]),
    "cascade": (B.sections(SECTIONS), lambda x: dsp.cascade(x, SECTIONS)),
    "one": (B.sections(SECTIONS[:1]), lambda x: dsp.cascade(x, SECTIONS[:1])),
}


@pytest.mark.parametrize(("rows", "scan"), [(50, 4096), (20, 3)])
def test_blocks_give_what_whole_sessions_give(spark, rows, scan, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 200)
    data = sessions(SIZES)
    got = B.recurrence(frame(spark, data), KEYS, ORDER, "value", {n: f for n, (f, _) in FILTERS.items()}, ["event_id"], rows, scan).toPandas().set_index("event_id")
    assert len(got) == len(data)
    for g in by_session(data):
        mine = got.loc[g["event_id"]]
        assert mine["idx"].tolist() == list(range(len(g)))
        for name, (_, plain) in FILTERS.items():
            assert np.allclose(mine[name], plain(g["value"].to_numpy()), rtol=0, atol=1e-9), name


@pytest.mark.parametrize("rows", [50, 1 << 16])
def test_zero_phase_over_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 200)
    data = sessions(SIZES, 5)
    got = B.zero_phase(frame(spark, data), KEYS, ORDER, "value", SECTIONS, ["event_id"], rows).toPandas().set_index("event_id")
    assert len(got) == len(data)
    for g in by_session(data):
        assert np.allclose(got.loc[g["event_id"], "y"], dsp.zero_phase(g["value"].to_numpy(), SECTIONS), rtol=0, atol=1e-9)


def test_lanes_of_one_block():
    rng = np.random.default_rng(2)
    edges = np.array([0, 1, 1000, 1256, 1512, 4000])
    x = rng.normal(size=4000)
    f = B.sections(SECTIONS, settled=True)
    y, ends = f.run(x, edges, f.start(x[edges[:-1]]))
    for a, b, end in zip(edges[:-1], edges[1:], ends, strict=True):
        state = f.start(x[a : a + 1])[0]
        for i in range(a, b):
            assert abs(y[i] - (f.c @ state + f.d * x[i])) < 1e-9
            state = f.a @ state + f.b * x[i]
        assert np.allclose(end, state, atol=1e-9)


def test_numbers_from_one_range_sort(spark):
    data = sessions(SIZES, 7)
    got = B.numbered(frame(spark, data), KEYS, ORDER, "pos", rows_per_range=100).toPandas().set_index("event_id")
    for g in by_session(data):
        assert got.loc[g["event_id"], "pos"].tolist() == list(range(len(g)))
    assert B.numbered(frame(spark, data).limit(0), KEYS, ORDER).collect() == []


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 1), (3, 0), (0, 10), (10, 10)])
def test_halo(spark, before, after):
    placed, _ = B.in_blocks(frame(spark, sessions({1: 95, 2: 10, 3: 21})), KEYS, ORDER, 10)
    got, sizes = B.with_halo(placed, before, after, 10).toPandas(), {1: 95, 2: 10, 3: 21}
    for (user, block), g in got.groupby(["user_id", "block"]):
        if g["own"].any():
            assert sorted(g["idx"]) == [i for i in range(block * 10 - before, (block + 1) * 10 + after) if i >= 0 and i < sizes[user]]
    with pytest.raises(ValueError, match="halo"):
        B.with_halo(placed, 11, 0, 10)


@pytest.mark.parametrize(("gap", "width", "scan"), [(5, 40, 3), (90, 100, 4096), (1, 50, 3), (17, None, 5)])
def test_refractory_time_over_blocks(spark, gap, width, scan):
    data = sessions({1: 700, 2: 1, 3: 40, None: 300}, 9)
    got = B.spaced(frame(spark, data), KEYS, "ts_us", gap, width, scan).toPandas()
    for g in by_session(data):
        user = g["user_id"].iloc[0]
        mine = got[got["user_id"].isna()] if pd.isna(user) else got[got["user_id"] == user]
        g = g.sort_values(["ts_us", "value", "event_id"])
        assert sorted(mine["ts_us"]) == g["ts_us"].to_numpy()[dsp.refractory_filter(g["ts_us"].to_numpy(), gap)].tolist()
    assert B.spaced(frame(spark, data).limit(0), KEYS, "ts_us", gap).collect() == []


def test_a_long_session_is_many_tasks_work(spark):
    """Ten million rows of one session: no task sees more than a block or a range, and the filter's steps stay exact."""
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("ts_us"), F.col("id").alias("event_id"), F.sin(F.col("id") * 0.01).alias("value"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        seen = B.recurrence(df, KEYS, ORDER, "value", {"y": B.ema(0.18)}, ["ts_us"])
        seen = seen.withColumn("task", F.spark_partition_id())
        spread = seen.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).agg(F.max("n"), F.max("tasks"), F.count("*")).first()
        assert tuple(spread) == (B.BLOCK_ROWS, 1, -(-n // B.BLOCK_ROWS))
        x = np.sin(np.arange(n) * 0.01)
        expected = dsp.ema(x, 0.18)
        got = seen.filter("ts_us % 9973 = 0").select("ts_us", "y").toPandas()
        assert len(got) == len(range(0, n, 9973))
        assert np.abs(got["y"] - expected[got["ts_us"]]).max() < 1e-9
        assert seen.select("task").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("settings", [dsp.PPG, dsp.ECG])
@pytest.mark.parametrize("rows", [40, 1 << 16])
def test_peaks_over_blocks(spark, settings, rows):
    data = sessions({1: 900, 2: 2, 3: 40, 4: 41, None: 333}, 13)
    data["ts_us"] *= 30_000
    data["value"] = 4 * np.sin(data["ts_us"] / 3e5) + 0.3 * (data["value"] - data["value"].mean())
    got = B.session_peaks(frame(spark, data), KEYS, ORDER, "ts_us", "value", settings, rows).toPandas()
    assert got.columns.tolist() == ["user_id", "peak_us", "amplitude"] and len(got) > 40
    for g in by_session(data):
        user = g["user_id"].iloc[0]
        mine = (got[got["user_id"].isna()] if pd.isna(user) else got[got["user_id"] == user]).sort_values("peak_us")
        at, height = dsp.peaks(g["value"].to_numpy(), g["ts_us"].to_numpy(), **settings)
        assert mine["peak_us"].tolist() == g["ts_us"].to_numpy()[at].tolist() and np.allclose(mine["amplitude"], height)
