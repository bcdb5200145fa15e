"""Queries over windows of samples, session headers, splits and model results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import signals as fn
from sensorloom.operators import intervals, series, spectral, waveforms
from sensorloom.plans.catalog import KEYS, ORDER, rounded, samples
from sensorloom.plans.register import FRAGMENTS, SAMPLES_SQL, SQL, query
from sensorloom.sources import logs


c = F.col
SIZE = 16
FRAGMENTS["$W"] = SAMPLES_SQL + f""", v AS (SELECT user_id, event_id, idx AS i, idx // {SIZE} AS w, value * 0.7310585786e0 AS x, count(*) OVER (PARTITION BY user_id, idx // {SIZE}) AS n FROM s),
    x AS (SELECT * FROM v WHERE n = {SIZE})"""
FRAGMENTS["$V"] = FRAGMENTS["$W"].replace("WITH s AS", "WITH RECURSIVE s AS")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of rows; scaled to values without short decimals, so that no rounded result is a tie."""
    scaled = (c("value") * 0.7310585786).alias("x")
    return spectral.row_windows(samples(spark, sf_dir).select("user_id", "event_id", "ts_us", scaled), KEYS, ORDER, SIZE)


# ---------------------------------------------------------------------- windows
@query(
    "v19_flatten",
    """$W, m AS (SELECT user_id, w, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS low, max(x) AS high, sqrt(avg(x * x)) AS rms FROM x GROUP BY user_id, w),
    k AS (SELECT user_id, w, avg(power((x - m) / sd, 3)) AS skew, avg(power((x - m) / sd, 4)) - 3 AS kurtosis FROM x JOIN m USING (user_id, w) WHERE high > low GROUP BY user_id, w)
    SELECT user_id, w, round(m, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(rms, 6) AS rms, round(CASE WHEN high = low THEN 0 ELSE sd END, 6) AS std, round(coalesce(skew, 0), 6) AS skew,
      round(coalesce(kurtosis, 0), 6) AS kurtosis, round(avg(m) OVER (PARTITION BY user_id ORDER BY w ROWS 2 PRECEDING), 6) AS moving_mean FROM m LEFT JOIN k USING (user_id, w)""",
)
def _(spark, d_):
    return rounded(spectral.flattened(windows(spark, d_), KEYS, "x", 3))


@query(
    "v23_threshold_peaks",
    """$S, n AS (SELECT event_id, raw, lag(raw) OVER o AS a, lead(raw) OVER o AS b FROM s WINDOW o AS (PARTITION BY user_id ORDER BY idx))
    SELECT event_id, raw FROM n WHERE raw > a AND raw > b AND 2 * raw - a - b > 100""",
)
def _(spark, d_):
    return spectral.threshold_peaks(samples(spark, d_), KEYS, ORDER, "raw", 100).select("event_id", "raw")


POWER_SQL = f"""$W, m AS (SELECT user_id, w, avg(x) AS m FROM x GROUP BY user_id, w),
    t AS (SELECT user_id, w, CAST(k AS INTEGER) AS bin, sum((x - m) * cos(2 * pi() * k * (i % {SIZE}) / {SIZE})) AS re, sum((x - m) * sin(2 * pi() * k * (i % {SIZE}) / {SIZE})) AS im
      FROM x JOIN m USING (user_id, w), range(0, {SIZE // 2 + 1}) r(k) GROUP BY user_id, w, k),
    p AS (SELECT user_id, w, bin, bin * 2.0e0 / {SIZE} AS frequency, (re * re + im * im) / (2.0e0 * {SIZE}) * CASE WHEN bin = {SIZE // 2} THEN 1 ELSE 2 END AS power FROM t)"""


@query("v26_periodogram", POWER_SQL + " SELECT user_id, w, bin, round(frequency, 6) AS frequency, round(power, 6) + 0.0 AS power FROM p")
def _(spark, d_):
    return rounded(spectral.periodogram(windows(spark, d_), KEYS, "x", SIZE, 2.0))


@query(
    "v25_band_power",
    POWER_SQL
    + """ SELECT user_id, w, round(coalesce(avg(power) FILTER (WHERE frequency < 0.25), 0), 6) + 0.0 AS band0, round(coalesce(avg(power) FILTER (WHERE frequency >= 0.25 AND frequency < 0.8), 0), 6) AS band1,
    round(coalesce(avg(power) FILTER (WHERE frequency >= 0.8 AND frequency < 0.85), 0), 6) AS band2 FROM p GROUP BY user_id, w""",
)
def _(spark, d_):
    return rounded(spectral.band_power(spectral.periodogram(windows(spark, d_), KEYS, "x", SIZE, 2.0), KEYS, [0.0, 0.25, 0.8, 0.85]))


@query(
    "v27_centred",
    "$W SELECT event_id, round((x - avg(x) OVER (PARTITION BY user_id, w)) * 0.5, 6) + 0.0 AS y FROM x",
)
def _(spark, d_):
    w = Window.partitionBy("user_id", "w")
    return rounded(windows(spark, d_).select("event_id", ((c("x") - F.avg("x").over(w)) * 0.5).alias("y")))


@query(
    "v32_crossings_entropy",
    """$W, l AS (SELECT user_id, w, x - 36 AS x, lag(x - 36) OVER (PARTITION BY user_id, w ORDER BY i) AS b, min(x - 36) OVER g AS low, max(x - 36) OVER g AS high, avg(x - 36) OVER g AS m FROM x WINDOW g AS (PARTITION BY user_id, w)),
    h AS (SELECT user_id, w, CASE WHEN high > low THEN least(floor((x - low) / ((high - low) / 100)), 99) ELSE 0 END AS bin, count(*) AS n, count(*) FILTER (WHERE x * b < 0) AS z, count(*) FILTER (WHERE (x - m) * (b - m) < 0) AS mc FROM l GROUP BY ALL)
    SELECT user_id, w, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, round(sum(z) / sum(n), 6) AS zero_crossings, round(sum(mc) / sum(n), 6) AS mean_crossings FROM h GROUP BY user_id, w""",
)
def _(spark, d_):
    return rounded(spectral.crossings_and_entropy(windows(spark, d_).withColumn("x", c("x") - 36), KEYS, "x"))


@query(
    "v32_nearest_rank",
    f"""$W, r AS (SELECT user_id, w, x, row_number() OVER (PARTITION BY user_id, w ORDER BY x) - 1 AS r FROM x)
    SELECT user_id, w, max(x) FILTER (WHERE r = floor(0.05 * {SIZE - 1} + 0.5)) AS p05, max(x) FILTER (WHERE r = floor(0.5 * {SIZE - 1} + 0.5)) AS p50, max(x) FILTER (WHERE r = floor(0.95 * {SIZE - 1} + 0.5)) AS p95 FROM r GROUP BY user_id, w""",
)
def _(spark, d_):
    return spectral.nearest_rank(windows(spark, d_), KEYS, "x", [0.05, 0.5, 0.95])


@query(
    "v33_mel",
    """SELECT event_id, round(1127.0 * ln(1 + value * 40 / 700.0), 6) AS mel, round(CASE WHEN value > 20 AND value < 60 THEN (value - 20) / 40 WHEN value >= 60 AND value < 100 THEN (100 - value) / 40 ELSE 0 END, 6) AS weight
    FROM events WHERE user_id IS NOT NULL""",
)
def _(spark, d_):
    return rounded(samples(spark, d_).select("event_id", spectral.mel(c("value") * 40).alias("mel"), spectral.triangle(c("value"), 20.0, 60.0, 100.0).alias("weight")))


@query("a17_window_features")
def _(spark, d_):
    """Windows of 512 rows (8 s) of each supplier's lines; a rest that is shorter is rejected."""
    rows = spark.read.parquet(f"{d_}/lineitem.parquet").select(c("l_suppkey").alias("stream"), "l_orderkey", "l_linenumber", c("l_quantity").cast("double").alias("x"))
    order = ["l_orderkey", "l_linenumber", "x"]  # the first two may repeat
    numbered = series.positions(rows, ["stream"], order).withColumn("window", F.floor(c("pos") / 512))
    return rounded(waveforms.window_features(numbered, ["stream", "window"], order, "x", samples=512, min_beats=8, min_ratio=0.3))


# ------------------------------------------------------------- headers and splits
_COMMIT = "00112233445566778899aabbccddeeff01020304"
_PARTS = [int.from_bytes(bytes.fromhex(_COMMIT)[a:b], "little", signed=True) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20))]


@query(
    "k04_session_header",
    f"""WITH u AS (SELECT DISTINCT user_id, user_id + 1000 AS session, user_id * 4294967297 AS device FROM events WHERE user_id IS NOT NULL)
    SELECT user_id, 16 AS record_type, session AS timestamp_us, device % 4294967296 AS sequence, CAST(device // 4294967296 AS INTEGER) AS value_a, CAST(500 * 65536 + 100 AS INTEGER) AS value_b, 1 AS flags FROM u
    UNION ALL SELECT user_id, 17, session, 7, CAST(3 * 65536 + 2 AS INTEGER), CAST(4 * 65536 + 1 AS INTEGER), 1 FROM u
    UNION ALL SELECT user_id, 18, session, 36 + 36 * 256, 4096, 60000, 411 FROM u
    UNION ALL SELECT user_id, 19, {_PARTS[0]}, {_PARTS[1]}, {_PARTS[2]}, {_PARTS[3]}, 0 FROM u""",
)
def _(spark, d_):
    rows = samples(spark, d_).select("user_id").distinct().withColumn("session", c("user_id") + 1000).withColumn("device", c("user_id") * F.lit((1 << 32) + 1))
    versions = {"firmware": 7, "ppg": 3, "ecg": 2, "quality": 4, "oxygen": 1, "calibration": 1, "features": 1}
    hardware = {"red": 36, "ir": 36, "range": 4096, "window_ms": 60000, "width_us": 411}
    return logs.session_header(rows, ["user_id"], "session", "device", (500, 100), versions, hardware, _COMMIT)


@query(
    "m03_split_check",
    """WITH e AS (SELECT DISTINCT user_id % 15 AS subject, CASE WHEN user_id % 15 < 11 THEN 'train' WHEN user_id % 15 < 13 THEN 'validation' ELSE 'test' END AS split FROM events WHERE user_id IS NOT NULL),
    x AS (SELECT * FROM (VALUES ('train', 11), ('validation', 2), ('test', 2)) t(split, expected)),
    m AS (SELECT subject FROM e GROUP BY subject HAVING count(*) > 1)
    SELECT split, expected, count(subject) AS n_subjects, count(subject) FILTER (WHERE subject IN (FROM m)) AS n_shared, count(subject) = expected AND count(subject) FILTER (WHERE subject IN (FROM m)) = 0 AS ok
    FROM x LEFT JOIN e USING (split) GROUP BY split, expected""",
)
def _(spark, d_):
    subject = c("user_id") % 15
    split = F.when(subject < 11, "train").when(subject < 13, "validation").otherwise("test")
    return series.split_check(samples(spark, d_).select(subject.alias("subject"), split.alias("split")), "subject", "split", {"train": 11, "validation": 2, "test": 2})


# ----------------------------------------------------------------- model results
@query(
    "m05_offline_predict",
    f"""WITH f AS ({SQL["a04_stress_features"].replace("round(mean_pp_ms, 6)", "mean_pp_ms").replace("round(rmssd_ms, 6)", "rmssd_ms")}),
    p AS (SELECT user_id, status, CASE WHEN status = 'ready' THEN 1 / (1 + exp(-(0.1 + (mean_pp_ms - 700.0) / 80.0 * -0.8 + (rmssd_ms - 250.0) / 60.0 * 0.5))) END AS p FROM f)
    SELECT user_id, status, round(p, 6) AS probability, CASE WHEN p >= 0.5 THEN 'stress' WHEN p < 0.5 THEN 'baseline' END AS label FROM p""",
)
def _(spark, d_):
    f = intervals.stress_features(samples(spark, d_), KEYS, ORDER, "rr_ms", min_ratio=0.5)
    p = F.when(c("status") == "ready", fn.logistic_score([c("mean_pp_ms"), c("rmssd_ms")], [700.0, 250.0], [80.0, 60.0], [-0.8, 0.5], 0.1))
    return rounded(f.select("user_id", "status", p.alias("probability")).withColumn("label", F.when(c("probability") >= 0.5, "stress").when(c("probability") < 0.5, "baseline")))


@query(
    "o14_model_result",
    """$S, g AS (SELECT user_id, avg(rr_ms) AS m, CASE WHEN count(*) FILTER (WHERE bad) > 8 THEN CAST('inf' AS DOUBLE) ELSE stddev_samp(rr_ms) END AS sd FROM s GROUP BY user_id),
    z AS (SELECT user_id, coalesce(isfinite(m) AND isfinite(sd), false) AS ok, 0.1 + (m - 700.0) / 80.0 * -0.8 + (sd - 250.0) / 60.0 * 0.5 AS z FROM g)
    SELECT user_id, ok AS model_available, ok AS valid, CASE WHEN ok THEN round(1 / (1 + exp(-z)), 6) END AS probability, CASE WHEN ok THEN round(1 - 1 / (1 + exp(-z)), 6) END AS complement FROM z""",
)
def _(spark, d_):
    spread = F.when(F.count(F.when(c("bad"), 1)) > 8, F.lit(float("inf"))).otherwise(F.stddev_samp("rr_ms"))
    g = samples(spark, d_).groupBy("user_id").agg(F.avg("rr_ms").alias("m"), spread.alias("sd"))
    p = fn.logistic_score([c("m"), c("sd")], [700.0, 250.0], [80.0, 60.0], [-0.8, 0.5], 0.1)
    return rounded(g.select("user_id", *[v.alias(k) for k, v in fn.model_result({"m": c("m"), "sd": c("sd")}, ["m", "sd"], p).items()]))
