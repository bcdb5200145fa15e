"""Values worked out by hand or by a plain loop, and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import signals as fn
from sensorloom.operators import dsp, intervals, series
from sensorloom.sources import logs, sinks
from sensorloom.streaming import processors, sessions


def test_variability_of_four_intervals(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([800.0, 1000.0, 900.0, 1100.0])], "k int, i int, v double")
    got = intervals.variability(rows, ["k"], ["i"], "v").first()
    assert (got["n_intervals"], got["mean_ms"], got["pnn50_pct"]) == (4, 950.0, 100.0)
    assert got["sdnn_ms"] == pytest.approx(np.std([800, 1000, 900, 1100], ddof=1))
    assert got["rmssd_ms"] == pytest.approx(np.sqrt((200**2 + 100**2 + 200**2) / 3))


def test_bridging_differs_from_adjacent(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([800.0, 9000.0, 900.0, 910.0])], "k int, i int, v double")
    bridged = intervals.variability(rows, ["k"], ["i"], "v").first()["rmssd_ms"]
    adjacent = intervals.variability(rows, ["k"], ["i"], "v", bridging=False).first()["rmssd_ms"]
    assert bridged == pytest.approx(np.sqrt((100**2 + 10**2) / 2)) and adjacent == pytest.approx(10.0)


def test_af_features_of_regular_beats(spark):
    rows = spark.createDataFrame([(1, i, 800.0) for i in range(20)], "k int, i int, v double")
    got = intervals.af_features(rows, ["k"], ["i"], "v").first()
    assert [got[c] for c in ("mean_rr", "sdnn", "rmssd", "pnn50", "iqr_rr")] == pytest.approx([0.8, 0, 0, 0, 0])


def test_stress_features_reject_few_beats(spark):
    rows = spark.createDataFrame([(1, i, 800.0) for i in range(10)], "k int, i int, v double")
    got = intervals.stress_features(rows, ["k"], ["i"], "v").first()
    assert got["status"] == "quality_rejected" and got["mean_hr_bpm"] is None


def test_ema_matches_the_recurrence():
    x = np.random.default_rng(1).normal(size=200)
    y = [x[0]]
    for v in x[1:]:
        y.append(y[-1] + 0.1 * (v - y[-1]))
    assert np.allclose(dsp.ema(x, 0.1), y)
    assert dsp.ema([800, 1000, 900, 1100], 0.1)[-1] == pytest.approx(855.2)


@pytest.mark.parametrize("settings", [dsp.PPG, dsp.ECG])
def test_peaks_match_a_sample_loop(settings):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=3000).cumsum() % 7 - 3, np.arange(1, 3001) * 5000
    envelope, p1, p2, t1, last, expected = 1.0, 0.0, 0.0, 0, 0, []
    for i, (v, now) in enumerate(zip(np.abs(x) if settings["magnitude"] else x, t, strict=True)):
        envelope = 0.995 * envelope + 0.005 * abs(v)
        if i >= 2 and p1 > p2 and p1 >= v and p1 > envelope * settings["scale"] and (last == 0 or t1 - last >= settings["refractory_us"]):
            expected.append(i - 1)
            last = t1
        p2, p1, t1 = p1, v, now
    assert dsp.peaks(x, t, **settings)[0].tolist() == expected


def test_butterworth_gain():
    low, high = dsp.butterworth_sections("low", 4, 5.0, 100.0), dsp.butterworth_sections("high", 4, 5.0, 100.0)

    def gain(sections, f):
        z = np.exp(-2j * np.pi * f / 100.0)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))

    assert gain(low, 0.001) == pytest.approx(1, abs=1e-6) and gain(low, 5.0) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(low, 40.0) < 1e-3
    assert gain(high, 49.9) == pytest.approx(1, abs=1e-6) and gain(high, 5.0) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(high, 0.1) < 1e-3


def test_zero_phase_keeps_a_slow_sine_in_place():
    t = np.arange(1000) / 100.0
    x = np.sin(2 * np.pi * 0.5 * t)
    assert np.abs(dsp.zero_phase(x, dsp.butterworth_sections("low", 4, 10.0, 100.0)) - x).max() < 1e-3
    assert dsp.zero_phase(np.array([1.0, 3.0]), dsp.butterworth_sections("low", 2, 10.0, 100.0)).tolist() == [-1.0, 1.0]


def test_small_helpers():
    assert dsp.plateau_peaks([0, 3, 3, 1, 5, 0, 2, 2], 1) == [1, 4]
    assert dsp.spaced_peaks([0, 3, 3, 1, 5, 0], [1, 4], 2) == [4]
    assert dsp.forward_mean4([4, 8, 4, 8, 9, 9]).tolist() == [6, 7, 4, 8, 9, 9]
    assert dsp.gap_filled(np.array([np.nan, 1.0])) is None
    assert dsp.gap_filled(np.array([1.0, np.nan, 3.0] + [3.0] * 97)).tolist()[:3] == [1.0, 2.0, 3.0]
    assert dsp.band_ratio(np.sin(2 * np.pi * 10 * np.arange(500) / 100.0), 100.0) == pytest.approx(1.0)


def test_crc_and_frames(spark):
    assert logs.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0x29B1
    records = pd.DataFrame({"schema": [2], "record_type": [1], "timestamp_us": [5], "sequence": [6], "value_a": [-7], "value_b": [8], "flags": [9]})
    content = logs.encoded(records)
    assert len(content) == 28 and logs.decoded(content).iloc[0].tolist() == [2, 1, 5, 6, -7, 8, 9]
    with pytest.raises(ValueError):
        logs.decoded(content + b"x")
    with pytest.raises(ValueError):
        logs.decoded(content[:-1] + bytes([content[-1] ^ 1]))


def test_batch_timestamps(spark):
    batches = spark.createDataFrame([(1, 0, 10_000, 4), (1, 1, 60_000, 2)], "k int, i int, poll long, n int")
    got = [r["timestamp_us"] for r in logs.batch_timestamps(batches, ["k"], ["i"], "poll", "n", 5000).orderBy("i", "sample").collect()]
    assert got == [0, 5000, 10_000, 15_000, 20_000, 25_000]


def test_flags_and_zones(spark):
    row = spark.createDataFrame([(500, 60_000)], "red int, ir int").select(
        fn.ppg_flags(F.col("red"), F.col("ir"), F.lit(False), F.lit(True)).alias("flags"),
        fn.spo2_zone(F.lit(94.5), F.lit(True)).alias("zone"),
        fn.quantize(F.lit(1000.0), 1.0, 0).alias("q"),
        fn.dequantize(F.lit(127)).alias("p"),
    ).first()
    assert (row["flags"], row["zone"], row["q"], row["p"]) == (1 + 2 + 8 + 32, "normal", 127, 255 / 256)


def test_quality_of_empty_window(spark):
    zero = F.lit(0)
    q = fn.ppg_quality(zero, F.lit(0.0), zero, zero, zero, zero, F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(0.0), zero)
    got = spark.range(1).select(*[v.alias(k) for k, v in q.items()]).first()
    assert got["status"] == "poor" and got["reasons"] == 1 + 4 + 8 + 16 + 32 + 256


def test_session_machine_and_late_rows():
    m = sessions.Machine()
    seconds = [m.step(t * 100_000, True, t == 0) for t in range(1200)]
    assert seconds[0] == "contact_wait" and seconds[5] == "warmup" and seconds[35] == "measuring" and seconds[635] == "result" and seconds[1085] == "idle"
    rows = pd.DataFrame({"session": 1, "timestamp_us": [10, 20, 20, 15, 30, 90], "value": 0.0})
    marked, last = sessions.mark_late(rows, None, 10)
    assert marked["late"].tolist() == [False, False, True, True, False, False] and marked["gap"].tolist() == [False, False, True, True, False, True] and last == 90
    marked, _ = sessions.mark_late(rows.head(1), 50, 10)
    assert marked["late"].tolist() == [True]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, t * 100_000, 2 * t + k, t % 7 != 3 or t > 30, t == 1 and k == 1) for s in (1, 2) for t in range(60) for k in (1, 0)]
    df = spark.createDataFrame(rows, "session long, timestamp_us long, sequence long, contact boolean, start boolean")
    for part in range(3):
        df.filter(F.floor(F.col("timestamp_us") / 2_000_000) == part).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = processors.replayed(sessions.state_stream(stream, None), "states")
    expected = sorted(map(tuple, sessions.state_batch(df).collect()))
    assert sorted(map(tuple, found.collect())) == expected


def test_late_stream_follows_arrival(spark, tmp_path):
    """Files hold rows in another order than they arrived in."""
    times = [10, 20, 20, 15, 30, 90, 80, 100, 100, 130]
    rows = [(s, i, t + s, float(t)) for s in (1, 2) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "session long, arrival long, timestamp_us long, value double")
    for part in range(2):
        df.filter(F.floor(F.col("arrival") / 5) == part).orderBy(F.desc("timestamp_us")).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = processors.replayed(sessions.late_marked_stream(stream, 10, None), "late")
    got = {(r["session"], r["arrival"]): (r["late"], r["gap"]) for r in found.collect()}
    for s in (1, 2):
        marked, _ = sessions.mark_late(pd.DataFrame({"timestamp_us": [t + s for t in times]}), None, 10)
        assert [got[s, i] for i in range(len(times))] == list(zip(marked["late"].tolist(), marked["gap"].tolist(), strict=True))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, i int, v double")
    assert intervals.stress_features(empty, ["k"], ["i"], "v").count() == 0
    assert series.runs(empty, ["k"], ["i"], "v").count() == 0
    assert series.count_windows(empty, ["k"], ["i"], 10, 5).count() == 0


def test_oxygen_of_the_synthetic_fixture():
    from sensorloom.operators import oxygen

    t = np.arange(800)
    red, ir = (40000 + 500 * np.sin(2 * np.pi * t / 40)).astype(np.int64), (60000 + 1200 * np.sin(2 * np.pi * t / 40)).astype(np.int64)
    red, ir = ((x[::2] + x[1::2] + 1) // 2 for x in (red, ir))
    got = oxygen.evaluate(ir, red)
    assert got["status"] == "ok" and got["percent"] == 96
    assert oxygen.evaluate(ir[:399], red[:399])["status"] == "not_ready" and oxygen.evaluate(ir, red, good=False)["status"] == "quality_rejected"
    ir[10] = 300_000
    assert oxygen.evaluate(ir, red)["status"] == "out_of_range"
    assert oxygen.TABLE[[0, 20, 33, 44, 100, 182, 183]].tolist() == [95, 99, 100, 99, 80, 1, 0]


def test_bandpass_and_peaks():
    from sensorloom.operators import waveforms as w

    s = w.bandpass_sections(4, 0.5, 4.0, 64)

    def gain(f):
        z = np.exp(-2j * np.pi * f / 64)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in s]))

    assert len(s) == 4 and gain(0.5) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(4.0) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert gain(1.5) == pytest.approx(1, abs=1e-2) and gain(0.05) < 1e-3 and gain(20) < 1e-3
    x = np.array([0, 1, 0, 3, 3, 0, 2, 1, 2.5, 0])
    assert w.find_peaks(x).tolist() == [1, 3, 6, 8] and w.find_peaks(x, height=2.2).tolist() == [3, 8]
    assert w.find_peaks(x, distance=3).tolist() == [3, 8] and w.find_peaks(x, prominence=1.5).tolist() == [3, 8]


def test_pulse_window_features(spark):
    from sensorloom.operators import dsp, waveforms as w

    t = np.arange(3840) / 64
    rng = np.random.default_rng(3)
    beat_at = np.cumsum(0.8 + 0.08 * rng.standard_normal(80))
    pulse = -sum(np.exp(-(((t - b) / 0.08) ** 2)) for b in beat_at)
    windows = {1: np.sin(2 * np.pi * 1.25 * t), 2: np.ones(3840), 3: t[:10], 4: np.where(t < 5, np.nan, t), 5: pulse, 6: np.sin(2 * np.pi * 0.55 * t)}
    rows = pd.DataFrame([(k, i, float(v)) for k, x in windows.items() for i, v in enumerate(x)], columns=["k", "i", "v"])
    got = w.window_features(spark.createDataFrame(rows.sample(frac=1, random_state=1)), ["k"], ["i"], "v").toPandas().set_index("k").to_dict("index")
    assert {k: r["reason"] for k, r in got.items()} == {1: "", 2: "flat", 3: "wrong_length", 4: "too_many_gaps", 5: "", 6: "too_few_beats"}
    assert got[1]["mean_hr_bpm"] == pytest.approx(75, abs=1) and got[1]["valid_rr_ratio"] > 0.95 and np.isnan(got[2]["mean_hr_bpm"]) and len(got[1]) == 21

    def plainly(y):
        at = w.find_peaks(y, distance=21, prominence=0.2 * y.std())
        ms = [1000 * (b - a) / 64 for a, b in zip(at, at[1:], strict=False) if 1 / 3 <= (b - a) / 64 <= 1.5]
        middle = np.median(ms)
        ms = np.array([v for v in ms if abs(v - middle) <= 0.3 * middle])
        rises = np.array([y[b] - min(y[a:b]) for a, b in zip(at, at[1:], strict=False)])
        return {
            "valid_rr_ratio": len(ms) / (len(at) - 1), "beat_count": len(at), "mean_hr_bpm": (60000 / ms).mean(), "sdnn_ms": ms.std(ddof=1), "median_pp_ms": np.median(ms),
            "rmssd_ms": np.sqrt((np.diff(ms) ** 2).mean()), "sdsd_ms": np.diff(ms).std(ddof=1), "pnn50_pct": 100 * (abs(np.diff(ms)) > 50).mean(),
            "mean_pulse_amplitude": rises.mean(), "std_pulse_amplitude": rises.std(ddof=1),
        }

    y = dsp.zero_phase(pulse, w.bandpass_sections(4, 0.5, 4.0, 64))
    up, down = plainly(y), plainly(-y)
    assert up["valid_rr_ratio"] != down["valid_rr_ratio"]
    expected = max(up, down, key=lambda e: e["valid_rr_ratio"])
    expected |= {"filtered_std": y.std(), "signal_range": np.ptp(y), "signal_skewness": float(pd.Series(y).skew()), "signal_kurtosis": float(pd.Series(y).kurt())}
    assert {k: got[5][k] for k in expected} == pytest.approx(expected)


def test_windows_are_filtered_once_and_their_samples_stay_together(spark, monkeypatch):
    from sensorloom.operators import dsp, waveforms as w

    calls = spark.sparkContext.accumulator(0)

    def counted(x, sections):
        calls.add(1)
        return dsp.zero_phase(x, sections)

    monkeypatch.setattr(w, "zero_phase", counted)
    rows = [(k, i, float(np.sin(i / (5 + k)))) for k in range(12) for i in range(256 if k else 99)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(5)
    assert w.window_features(df, ["k"], ["i"], "v", samples=256, min_beats=1).count() == 12
    assert calls.value == 11  # each whole window once
    assert w.marked_windows(df, ["k"], ["i"], "v", 256).count() == 12  # a row for each window, not for each sample


def test_sinks(spark, tmp_path):
    from sensorloom.sources import sinks

    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", float("nan")), (3, "a", None)], "i long, split string, v double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert logs.read_csv(spark, str(tmp_path / "csv"), "i long, split string, v double").count() == 3
    sinks.write_partitioned(df, str(tmp_path / "parts"), "split")
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"split=a", "split=b"} and spark.read.parquet(str(tmp_path / "parts")).count() == 3
    sinks.write_summary(df, str(tmp_path / "json"))
    assert spark.read.schema("i long, v double").json(str(tmp_path / "json")).filter("v IS NULL").count() == 2
    send = sinks.upload_batches(str(tmp_path / "up"))
    for _ in range(2):
        send(df, 7)
    assert spark.read.parquet(str(tmp_path / "up")).count() == 3


def test_binary_files(spark, tmp_path):
    records = pd.DataFrame({"schema": 2, "record_type": [1, 2], "timestamp_us": [5, 6], "sequence": [6, 7], "value_a": [-7, 1], "value_b": [8, 9], "flags": [9, 0]})
    (tmp_path / "x.bin").write_bytes(logs.encoded(records))
    assert logs.read_binary_logs(spark, str(tmp_path / "*.bin")).toPandas().equals(records.astype({c: "int32" for c in ("schema", "record_type", "value_a", "value_b", "flags")}))


def test_windowed_means(spark):
    rows = spark.createDataFrame([(1_000_000, 1.0), (1_500_000, 3.0), (61_000_000, 5.0)], "t long, v double")
    got = sessions.windowed_means(rows, "t", "v", "60 seconds", "60 seconds", "10 seconds").select("n", "mean").collect()
    assert sorted(map(tuple, got)) == [(1, 5.0), (2, 2.0)]


def test_windows_spectra_and_crossings(spark):
    from sensorloom.operators import spectral

    x = 3 + np.sin(2 * np.pi * 4 * np.arange(32) / 32)
    rows = [(k, i, float(v)) for k, values in ((1, x), (2, np.full(32, 5.0)), (3, x[:20])) for i, v in enumerate(values)]
    windows = spectral.row_windows(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], ["t"], 32)
    power = {(r["k"], r["bin"]): r["power"] for r in spectral.periodogram(windows, ["k"], "v", 32, 32.0).collect()}
    assert len(power) == 2 * 17 and power[1, 4] == pytest.approx(0.5) and sum(abs(p) for key, p in power.items() if key != (1, 4)) < 1e-9
    flat = {r["k"]: r for r in spectral.flattened(windows, ["k"], "v", 2).collect()}
    assert flat[2]["std"] == flat[2]["skew"] == flat[2]["kurtosis"] == 0 and flat[1]["mean"] == pytest.approx(3) and flat[1]["rms"] == pytest.approx(np.sqrt(9.5))
    crossed = {r["k"]: r for r in spectral.crossings_and_entropy(windows, ["k"], "v").collect()}
    assert crossed[2]["entropy"] == 0 and crossed[1]["zero_crossings"] == 0 and crossed[1]["mean_crossings"] > 0
    back = spark.range(1).select(spectral.hertz(spectral.mel(F.lit(440.0))).alias("f")).first()["f"]
    assert back == pytest.approx(440)


def test_split_check_and_model_result(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "train"), ("b", "test")], "s string, split string")
    checked = series.split_check(rows, "s", "split", {"train": 2, "test": 1, "validation": 1})
    assert {r["split"]: (r["n_subjects"], r["n_shared"], r["ok"]) for r in checked.collect()} == {"train": (2, 1, False), "test": (1, 1, False), "validation": (0, 0, False)}
    with pytest.raises(Exception, match="in another split too 1"):
        series.verified(checked).collect()
    assert all(r["ok"] for r in series.verified(series.split_check(rows.filter("split = 'train'"), "s", "split", {"train": 2})).collect())
    df = spark.createDataFrame([(1.0, 0.25), (float("nan"), 0.25), (float("inf"), 0.25), (None, 0.25), (1.0, None)], "x double, p double")
    got = df.select(*[v.alias(k) for k, v in fn.model_result({"x": F.col("x")}, ["x"], F.col("p")).items()]).collect()
    assert [(r["model_available"], r["valid"], r["probability"]) for r in got] == [(True, True, 0.25), (False, False, None), (False, False, None), (False, False, None), (True, False, None)]
    with pytest.raises(ValueError):
        fn.model_result({"y": F.col("x")}, ["x"], F.col("p"))


def test_a_large_value_is_several_files(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 'a' WHEN id < 990 THEN 'b' END AS split")
    sinks.write_partitioned(rows, str(tmp_path / "p"), "split", rows_per_file=100)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "p").iterdir() if d.is_dir()}
    assert files["split=a"] > 1 and files["split=b"] == 1 and spark.read.parquet(str(tmp_path / "p")).count() == 1000
