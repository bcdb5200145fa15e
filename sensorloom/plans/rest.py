"""Queries over single statistics, branches, parameters and small arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import signals as fn
from sensorloom.operators import intervals, oxygen, quantiles, series
from sensorloom.plans.catalog import KEYS, ORDER, rounded, samples
from sensorloom.plans.register import QUERIES, SQL, query
from sensorloom.sources import logs


c = F.col


# ------------------------------------------------------------------- statistics
@query(
    "a03_prv",
    """$S, d AS (SELECT user_id, rr_ms, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM s WHERE rr_ms BETWEEN 250 AND 2000 AND event_type = 'view')
    SELECT user_id, count(*) AS n_intervals, round(avg(rr_ms), 6) AS mean_ms, round(stddev_samp(rr_ms), 6) AS sdnn_ms, round(sqrt(avg(diff * diff)), 6) AS rmssd_ms,
      round(100.0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 50 THEN 1 ELSE 0 END), 6) AS pnn50_pct FROM d GROUP BY user_id HAVING count(*) >= 2""",
)
def _(spark, d_):
    return rounded(intervals.variability(samples(spark, d_).filter("event_type = 'view'"), KEYS, ORDER, "rr_ms"))


# The order of the features is that of their bits in the mask.
_PPG_FEATURES = """red_mean red_std red_min red_max ir_mean ir_std ir_min ir_max red_ac red_dc ir_ac ir_dc red_perfusion ir_perfusion red_ir_corr pulse_rate mean_ppi sdnn_ppi rmssd_ppi pnn50_ppi
    peak_count mean_pulse_amplitude pulse_amplitude_variation red_range ir_range spo2_ratio completeness clipping_fraction""".split()

_HRV_SQL = """$S, f AS (SELECT s.*, CASE WHEN rr_ms BETWEEN 250 AND 2000 THEN rr_ms END AS x FROM s),
    v AS (SELECT *, x - last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS diff FROM f)"""
_HRV_COLUMNS = """CASE WHEN count(x) >= 2 THEN avg(x) END AS mean_{0}, CASE WHEN count(x) >= 2 THEN stddev_samp(x) END AS sdnn_{0}, CASE WHEN count(x) >= 2 THEN sqrt(avg(diff * diff)) END AS rmssd_{0},
      CASE WHEN count(x) >= 2 THEN 100.0e0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 50 THEN 1 ELSE 0 END) END AS pnn50_{0}"""


@query(
    "a07_channel_features",
    _HRV_SQL
    + f""", g AS (SELECT user_id, avg(red) AS red_mean, stddev_samp(red) AS red_std, min(red) AS red_min, max(red) AS red_max, avg(ir) AS ir_mean, stddev_samp(ir) AS ir_std, min(ir) AS ir_min, max(ir) AS ir_max,
      corr(red, ir) AS red_ir_corr, CASE WHEN count(*) FILTER (WHERE rr_ms BETWEEN 333.33 AND 1500) >= 4 THEN 60000.0 / quantile_cont(rr_ms, 0.5) FILTER (WHERE rr_ms BETWEEN 333.33 AND 1500) END AS pulse_rate,
      {_HRV_COLUMNS.format("ppi")}, count(*) FILTER (WHERE event_type = 'purchase') AS peak_count, avg(abs(raw)) FILTER (WHERE event_type = 'purchase') AS mean_pulse_amplitude,
      stddev_samp(abs(raw)) FILTER (WHERE event_type = 'purchase') AS pulse_amplitude_variation, least(1.0, count(*) / 60.0e0) AS completeness,
      count(*) FILTER (WHERE red <= 1000 OR red >= 260000 OR ir <= 1000 OR ir >= 260000) / count(*) AS clipping_fraction FROM v GROUP BY user_id),
    r AS (SELECT *, red_max - red_min AS red_range, ir_max - ir_min AS ir_range, red_std AS red_ac, red_mean AS red_dc, ir_std AS ir_ac, ir_mean AS ir_dc, CASE WHEN red_mean > 0 THEN red_std / red_mean END AS red_perfusion,
      CASE WHEN ir_mean > 0 THEN ir_std / ir_mean END AS ir_perfusion, CASE WHEN red_mean > 0 AND ir_mean > 0 AND ir_std > 0 THEN (red_std / red_mean) / (ir_std / ir_mean) END AS spo2_ratio FROM g)
    SELECT user_id, {", ".join(f if f.endswith(("min", "max", "range", "count")) else f"round({f}, 4) AS {f}" for f in _PPG_FEATURES)},
      {" + ".join(f"CASE WHEN coalesce(isfinite(CAST({f} AS DOUBLE)), false) THEN {1 << i} ELSE 0 END" for i, f in enumerate(_PPG_FEATURES))} AS feature_mask FROM r""",
)
def _(spark, d_):
    rows = samples(spark, d_)
    diff, hrv = intervals.variability_aggregates("rr_ms", KEYS, ORDER)
    amplitude = F.when(c("event_type") == "purchase", F.abs("raw"))
    beats = F.when(c("rr_ms").between(333.33, 1500.0), c("rr_ms"))
    levels = [f(x).alias(f"{x}_{n}") for x in ("red", "ir") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    g = rows.withColumn("diff", diff).groupBy("user_id").agg(
        *levels, F.corr("red", "ir").alias("red_ir_corr"), F.when(F.count(beats) >= 4, 60000.0 / F.percentile(beats, F.lit(0.5))).alias("pulse_rate"),
        *[v.alias(f"{k}_ppi") for k, v in hrv.items()], F.count(amplitude).alias("peak_count"), F.avg(amplitude).alias("mean_pulse_amplitude"),
        F.stddev_samp(amplitude).alias("pulse_amplitude_variation"), F.least(F.lit(1.0), F.count("*") / 60.0).alias("completeness"),
        F.avg(fn.has_bit(fn.ppg_flags(c("red"), c("ir"), F.lit(False), F.lit(False)), 2).cast("int")).alias("clipping_fraction"),
    )
    for x in ("red", "ir"):
        g = g.withColumns({
            f"{x}_range": c(f"{x}_max") - c(f"{x}_min"), f"{x}_ac": c(f"{x}_std"), f"{x}_dc": c(f"{x}_mean"),
            f"{x}_perfusion": F.when(c(f"{x}_mean") > 0, c(f"{x}_std") / c(f"{x}_mean")),
        })
    g = g.withColumn("spo2_ratio", fn.ratio_of_ratios(c("red_ac"), c("red_dc"), c("ir_ac"), c("ir_dc"))[0])
    mask = fn.bitmask({1 << i: F.coalesce(fn.finite(c(f).cast("double")), F.lit(False)) for i, f in enumerate(_PPG_FEATURES)})
    return rounded(g.select("user_id", *_PPG_FEATURES, mask.alias("feature_mask")), 4)


@query(
    "a08_ecg_features",
    _HRV_SQL
    + f""", g AS (SELECT user_id, avg(raw) AS mean, stddev_samp(raw) AS std, max(raw) - min(raw) AS value_range, 60000.0 / quantile_cont(x, 0.5) AS heart_rate, {_HRV_COLUMNS.format("rr")},
      avg(CASE WHEN event_type = 'purchase' THEN abs(raw) END) AS peak_amplitude, count(*) FILTER (WHERE event_type = 'purchase') AS peak_count, CASE WHEN count(x) >= 2 THEN 10 ELSE 4 END AS n_valid FROM v GROUP BY user_id)
    SELECT user_id, round(mean, 4) AS mean, round(std, 4) AS std, value_range, round(heart_rate, 4) AS heart_rate, round(mean_rr, 4) AS mean_rr, round(sdnn_rr, 4) AS sdnn_rr, round(rmssd_rr, 4) AS rmssd_rr,
      round(pnn50_rr, 4) AS pnn50_rr, round(peak_amplitude, 4) AS peak_amplitude, peak_count, n_valid FROM g""",
)
def _(spark, d_):
    diff, hrv = intervals.variability_aggregates("rr_ms", KEYS, ORDER)
    peak, beats = F.when(c("event_type") == "purchase", F.abs("raw")), F.when(c("rr_ms").between(250, 2000), c("rr_ms"))
    g = samples(spark, d_).withColumn("diff", diff).groupBy("user_id").agg(
        F.avg("raw").alias("mean"), F.stddev_samp("raw").alias("std"), (F.max("raw") - F.min("raw")).alias("value_range"), (60000.0 / F.percentile(beats, F.lit(0.5))).alias("heart_rate"),
        *[v.alias(f"{k}_rr") for k, v in hrv.items()], F.avg(peak).alias("peak_amplitude"), F.count(peak).alias("peak_count"), F.when(F.count(beats) >= 2, 10).otherwise(4).alias("n_valid"),
    )
    return rounded(g, 4)


@query(
    "a09_fusion_features",
    """$S, g AS (SELECT user_id, 60000.0 / quantile_cont(rr_ms, 0.5) FILTER (WHERE event_type = 'view') AS a, 60000.0 / quantile_cont(rr_ms, 0.5) FILTER (WHERE event_type = 'click') AS b,
      max(ts_us // 500000) FILTER (WHERE event_type = 'view') AS e, max(ts_us // 500000) FILTER (WHERE event_type = 'click') AS p FROM s GROUP BY user_id),
    d AS (SELECT user_id, abs(a - b) AS rate_difference, CASE WHEN e > 0 AND p > e AND (p - e) / 1000.0e0 BETWEEN 50 AND 600 THEN (p - e) / 1000.0e0 END AS arrival_ms FROM g)
    SELECT user_id, round(rate_difference, 6) AS rate_difference, round(arrival_ms, 6) AS arrival_ms, arrival_ms IS NOT NULL AS arrival_valid, CASE WHEN arrival_ms IS NULL THEN 0 ELSE 1 END AS matched_beats FROM d""",
)
def _(spark, d_):
    """Views stand for R peaks and clicks for pulses."""
    of = lambda kind, x: F.when(c("event_type") == kind, x)
    rate = lambda kind: 60000.0 / F.percentile(of(kind, c("rr_ms")), F.lit(0.5))
    last = lambda kind: F.max(of(kind, F.floor(c("ts_us") / 500000)))
    g = samples(spark, d_).groupBy("user_id").agg(F.abs(rate("view") - rate("click")).alias("rate_difference"), fn.pulse_arrival(last("view"), last("click")).alias("arrival_ms"))
    valid = c("arrival_ms").isNotNull()
    return rounded(g.select("*", valid.alias("arrival_valid"), valid.cast("int").alias("matched_beats")))


@query(
    "a19_clean_share",
    """$S, m AS (SELECT user_id, quantile_cont(rr_ms, 0.5) AS m FROM s WHERE rr_ms BETWEEN 400 AND 1400 GROUP BY user_id)
    SELECT user_id, round(count(*) FILTER (WHERE rr_ms BETWEEN 400 AND 1400 AND rr_ms BETWEEN m * (1 - 0.3) AND m * (1 + 0.3)) / count(*), 6) AS valid_ratio FROM s JOIN m USING (user_id) GROUP BY user_id""",
)
def _(spark, d_):
    rows = intervals.median_cleaned(samples(spark, d_), KEYS, "rr_ms", 400, 1400, 0.3, quantiles.large_groups(samples(spark, d_), KEYS))
    g = rows.groupBy("user_id").agg(F.avg(F.coalesce("clean", F.lit(False)).cast("int")).alias("valid_ratio"), F.count(F.when(c("rr_ms").between(400, 1400), 1)).alias("n"))
    return rounded(g.filter("n > 0").drop("n"))


@query(
    "f05_level_and_pulse",
    "$S SELECT user_id, round(avg(red), 4) AS red_dc, round(stddev_samp(red), 4) AS red_ac, round(avg(ir), 4) AS ir_dc, round(stddev_samp(ir), 4) AS ir_ac, round(corr(red, ir), 6) AS correlation FROM s GROUP BY user_id",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(
        *[F.round(f(x), 4).alias(f"{x}_{n}") for x in ("red", "ir") for n, f in (("dc", F.avg), ("ac", F.stddev_samp))], F.round(F.corr("red", "ir"), 6).alias("correlation")
    )
    return g


@query(
    "f08_running_statistics",
    "$S SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, min(value) AS low, max(value) AS high FROM s GROUP BY ALL",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return rounded(g)


@query(
    "f09_running_correlation",
    """$S, g AS (SELECT user_id, count(*) AS n, corr(value, event_id) AS r FROM s GROUP BY user_id) SELECT user_id, round(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END, 6) AS r FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.corr("value", "event_id").alias("r"))
    return rounded(g.select("user_id", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r")))


@query(
    "w01_differences",
    "$S, d AS (SELECT event_id, ts_us - lag(ts_us) OVER w AS dt, raw - lag(raw) OVER w AS dv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)) SELECT * FROM d WHERE dt IS NOT NULL",
)
def _(spark, d_):
    w = series.ordered(KEYS, ORDER)
    rows = samples(spark, d_).select("event_id", (c("ts_us") - F.lag("ts_us").over(w)).alias("dt"), (c("raw") - F.lag("raw").over(w)).alias("dv"))
    return rows.filter("dt IS NOT NULL")


# ------------------------------------------------------------ gates and branches
@query(
    "p08_quality_gate",
    f"""WITH p AS ({SQL["a10_ppg_quality"]}), e AS ({SQL["a11_ecg_quality"]})
    SELECT user_id, coalesce(p.status = 'good', false) AS permits_ppg, coalesce(e.status = 'good', false) AS permits_ecg, coalesce(p.status = 'good', false) AND coalesce(e.status = 'good', false) AS permits_fusion
    FROM p FULL JOIN e USING (user_id)""",
)
def _(spark, d_):
    """Pulse figures need a good pulse, beat figures a good electrocardiogram, fused ones both."""
    side = lambda name, column: QUERIES[name](spark, d_).select("user_id", (c("status") == "good").alias(column))
    both = side("a10_ppg_quality", "ppg").join(side("a11_ecg_quality", "ecg"), "user_id", "full")
    ppg, ecg = (F.coalesce(c(x), F.lit(False)) for x in ("ppg", "ecg"))
    return both.select("user_id", ppg.alias("permits_ppg"), ecg.alias("permits_ecg"), (ppg & ecg).alias("permits_fusion"))


@query(
    "o07_oxygen_status",
    """$S, f AS (SELECT *, CASE WHEN ir > 262143 OR red > 262143 THEN 1 WHEN ir = 262143 OR red = 262143 THEN 2 WHEN ir = 0 OR red = 0 OR ir < 10000 THEN 3 END AS fault FROM s),
    g AS (SELECT event_id, user_id, CASE WHEN idx < 7 THEN 'not_ready' WHEN bad THEN 'quality_rejected' ELSE coalesce(CASE first_value(fault IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS 7 PRECEDING)
      WHEN 1 THEN 'out_of_range' WHEN 2 THEN 'saturated' WHEN 3 THEN 'no_signal' END, 'ok') END AS gate FROM f)
    SELECT event_id, gate, CASE WHEN user_id % 10 = 9 THEN 'Error' WHEN gate = 'ok' THEN 'Valid' WHEN gate = 'not_ready' THEN 'NotAvailable' WHEN gate = 'out_of_range' THEN 'Error' ELSE 'InvalidSignal' END AS status,
      false AS clinically_validated FROM g""",
)
def _(spark, d_):
    """The estimator's gate over eight rows instead of its 400; one user in ten has rejected settings."""
    rows = oxygen.gate_status(samples(spark, d_), KEYS, ORDER, "ir", "red", ~c("bad"), rows=8)
    return rows.select("event_id", "gate", fn.oxygen_value_status(c("gate"), c("user_id") % 10 == 9).alias("status"), F.lit(False).alias("clinically_validated"))


@query(
    "o11_rhythm_branch",
    f"""WITH q AS ({SQL["a11_ecg_quality"]}), f AS ({SQL["a05_af_features"].replace("round(avg(x), 6) AS mean_rr", "avg(x) AS mean_rr").replace("round(stddev_samp(x) / avg(x), 6) AS cv_rr", "stddev_samp(x) / avg(x) AS cv_rr")}),
    b AS (SELECT q.user_id, q.status = 'good' AS good, reasons, interval_count, coalesce(interval_count < 75, false) AS no_model, 1 / (1 + exp(-(0.1 + (mean_rr - 0.6) / 0.1 * -0.4 + (cv_rr - 0.4) / 0.1 * 0.7))) AS p FROM q LEFT JOIN f USING (user_id)),
    r AS (SELECT *, CASE WHEN NOT good THEN 'quality_rejected' WHEN interval_count IS NULL THEN 'not_ready' WHEN interval_count < 30 THEN 'quality_rejected' WHEN no_model THEN 'not_ready' ELSE 'valid' END AS status FROM b)
    SELECT user_id, status, CASE WHEN NOT good THEN reasons WHEN interval_count IS NULL THEN 1 WHEN interval_count < 30 THEN 2 WHEN no_model THEN 4 ELSE 0 END AS reason_flags, CASE WHEN status = 'valid' THEN round(p, 6) END AS score,
      CASE WHEN status = 'valid' THEN round(greatest(p, 1 - p), 6) END AS confidence, status = 'valid' AND p > 1 - p AS alert, CASE WHEN status = 'valid' THEN CASE WHEN p > 1 - p THEN 'AF' ELSE 'nonAF' END END AS label,
      false AS negative_conclusive FROM r""",
)
def _(spark, d_):
    """The gates of quality and intervals; the network's weights aren't published, so a
    logistic score of two features stands in, for sessions of 75 intervals or more."""
    quality = QUERIES["a11_ecg_quality"](spark, d_).select("user_id", (c("status") == "good").alias("good"), "reasons")
    f = intervals.af_features(samples(spark, d_), KEYS, ORDER, "rr_ms").select("user_id", "interval_count", "mean_rr", "cv_rr")
    vector = F.when(c("interval_count").isNull(), "not_ready").when(c("interval_count") < 30, "quality_rejected").otherwise("ready")
    p = fn.logistic_score([c("mean_rr"), c("cv_rr")], [0.6, 0.4], [0.1, 0.1], [-0.4, 0.7], 0.1)
    branch = fn.rhythm_branch(c("good"), c("reasons"), vector, F.coalesce(c("interval_count") >= 75, F.lit(True)), p)
    return rounded(quality.join(f, "user_id", "left").select("user_id", *[v.alias(k) for k, v in branch.items()]))


@query("o12_low_oxygen_rule", "$S SELECT event_id, 86 + value / 35 < 92 AS below, false AS alert FROM s")
def _(spark, d_):
    # The rule is off until it is validated, so it never alerts.
    return samples(spark, d_).select("event_id", (86 + c("value") / 35 < 92).alias("below"), F.lit(False).alias("alert"))


@query(
    "o17_pulse_rate",
    "$S SELECT user_id, count(*) AS n_valid, round(60000.0 / quantile_cont(rr_ms, 0.5), 6) AS bpm FROM s WHERE rr_ms BETWEEN 333.33 AND 1500 GROUP BY user_id HAVING count(*) >= 4",
)
def _(spark, d_):
    return rounded(intervals.median_rate(samples(spark, d_), KEYS, "rr_ms", 333.33, 1500.0, 4).filter("bpm IS NOT NULL"))


@query("v07_dequantized", "$S SELECT event_id, (CAST(raw % 256 AS INTEGER)) / 256.0 AS p FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", fn.dequantize(c("raw") % 256 - 128).alias("p"))


# ----------------------------------------------------------- parameters and arrays
@query(
    "j08_positional_parameters",
    """$S, g AS (SELECT user_id, avg(rr_ms) AS a, stddev_samp(rr_ms) AS b, max(rr_ms) AS m FROM s GROUP BY user_id)
    SELECT user_id, round(0.1 + (a - 700) / 80 * -0.8 + (b - 250) / 60 * 0.5 + (m - 1900) / 200 * 0.25, 6) AS z FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.array(F.avg("rr_ms"), F.stddev_samp("rr_ms"), F.max("rr_ms")).alias("x"))
    parameters = {"mean": [700.0, 250.0, 1900.0], "scale": [80.0, 60.0, 200.0], "coef": [-0.8, 0.5, 0.25]}
    zipped = F.arrays_zip("x", *[F.array(*[F.lit(v) for v in p]).alias(n) for n, p in parameters.items()])
    term = lambda acc, r: acc + (r["x"] - r["mean"]) / r["scale"] * r["coef"]
    return rounded(g.select("user_id", F.aggregate(zipped, F.lit(0.1), term).alias("z")))


@query("j06_split_overlap", "SELECT count(*) AS n_shared FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N')")
def _(spark, d_):
    rows = spark.read.parquet(f"{d_}/lineitem.parquet")
    return rows.filter("l_returnflag = 'A'").select("l_suppkey").intersect(rows.filter("l_returnflag = 'N'").select("l_suppkey")).agg(F.count("*").alias("n_shared"))


@query("t02_ascending", "$S SELECT user_id, event_id, raw, row_number() OVER (PARTITION BY user_id ORDER BY raw, ts_us, event_id) - 1 AS pos FROM s")
def _(spark, d_):
    return series.positions(samples(spark, d_), KEYS, [F.asc("raw"), *ORDER]).select("user_id", "event_id", "raw", "pos")


@query("t06_preferred_first", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def _(spark, d_):
    rows = spark.read.parquet(f"{d_}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return series.best_window(rows, ["l_orderkey"], [(c("l_returnflag") == "R").desc(), F.desc("l_quantity"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("t09_bounded_list", "$S SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS rn FROM s WHERE raw > 500) WHERE rn <= 15")
def _(spark, d_):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return samples(spark, d_).filter("raw > 500").withColumn("rn", F.row_number().over(w)).filter("rn <= 15").select("user_id", "event_id")
