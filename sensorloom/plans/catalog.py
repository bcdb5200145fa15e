"""The engine's queries by name, and the equivalent SQL.

Names begin with the operator's id in the inventory.  The tables hold no sensor
streams, so ``events`` stands in for one: a user is a session, an event a
sample; raw channels and beat intervals are taken from its value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import signals as fn
from sensorloom.operators import intervals, quantiles, series
from sensorloom.plans.register import QUERIES, SQL, query


KEYS, ORDER = ["user_id"], ["ts_us", "event_id"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("user_id").isNotNull())
    return events.select(
        "user_id", "event_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.floor(F.col("value") * 8).alias("raw"), F.floor(F.col("value") * 400).alias("red"), F.floor(F.col("value") * 600).alias("ir"),
        (200 + F.col("value") * 4).alias("rr_ms"), (F.col("event_type") == "error").alias("bad"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("idx", (F.row_number().over(series.ordered(KEYS, ORDER)) - 1).cast("long"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in the last bits; -0 becomes 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def d(x: Column | str, name: str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double").alias(name)


# ------------------------------------------------------------ flags and gates
_CLIP = "red <= 1000 OR red >= 260000 OR ir <= 1000 OR ir >= 260000"
_PPG_FLAGS = f"(1 + CASE WHEN {_CLIP} THEN 2 ELSE 0 END + CASE WHEN bad THEN 8 ELSE 0 END + CASE WHEN ir >= 50000 THEN 32 ELSE 0 END)"
_ECG_FLAGS = "(1 + CASE WHEN raw <= 8 OR raw >= 4087 THEN 2 ELSE 0 END + CASE WHEN bad THEN 16 ELSE 0 END)"


def _ppg_flags() -> Column:
    return fn.ppg_flags(F.col("red"), F.col("ir"), F.lit(False), F.col("bad"))


@query("p01_ppg_flags", f"$S SELECT event_id, CAST({_PPG_FLAGS} AS INTEGER) AS flags FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", _ppg_flags().alias("flags"))


@query("p02_ecg_flags", f"$S SELECT event_id, CAST({_ECG_FLAGS} AS INTEGER) AS flags FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", fn.ecg_flags(F.col("raw"), F.col("bad"), F.lit(False)).alias("flags"))


@query("p03_completeness", "$S SELECT user_id, round(least(1.0, count(*) FILTER (WHERE NOT bad) / 60.0), 6) AS completeness FROM s GROUP BY user_id")
def _(spark, d_):
    received = F.count(F.when(~F.col("bad"), 1))
    return rounded(samples(spark, d_).groupBy("user_id").agg(fn.completeness(received, F.lit(60.0)).alias("completeness")))


@query("p04_interval_range", "$S SELECT event_id, rr_ms FROM s WHERE rr_ms BETWEEN 333.33 AND 1500")
def _(spark, d_):
    return samples(spark, d_).filter(F.col("rr_ms").between(333.33, 1500)).select("event_id", "rr_ms")


@query("p05_finite", "$S SELECT event_id, CASE WHEN raw = 0 THEN NULL ELSE round(value / raw, 6) END AS ratio FROM s WHERE raw <> 0")
def _(spark, d_):
    ratio = F.try_divide(F.col("value"), F.col("raw"))
    return rounded(samples(spark, d_).withColumn("ratio", ratio).filter(fn.finite(F.col("ratio"))).select("event_id", "ratio"))


@query(
    "p06_median_cleaned",
    """$S, m AS (SELECT user_id, quantile_cont(rr_ms, 0.5) AS m FROM s WHERE rr_ms BETWEEN 333.33 AND 1500 GROUP BY user_id)
    SELECT s.user_id, count(*) AS n_raw, count(*) FILTER (WHERE rr_ms BETWEEN 333.33 AND 1500 AND rr_ms BETWEEN m * 0.7 AND m * 1.3) AS n_clean
    FROM s LEFT JOIN m ON s.user_id = m.user_id GROUP BY s.user_id""",
)
def _(spark, d_):
    rows = intervals.median_cleaned(samples(spark, d_), KEYS, "rr_ms", 333.33, 1500, 0.3, quantiles.large_groups(samples(spark, d_), KEYS))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_raw"), F.count(F.when(F.col("clean"), 1)).alias("n_clean"))


@query("p10_rails", "$S SELECT user_id, round(avg(CASE WHEN raw <= 10 OR raw >= 3900 THEN 1.0 ELSE 0.0 END), 6) AS rail_fraction FROM s GROUP BY user_id")
def _(spark, d_):
    return rounded(samples(spark, d_).groupBy("user_id").agg(F.avg(fn.rail(F.col("raw"), 10, 3900).cast("int")).alias("rail_fraction")))


@query(
    "p11_spo2_fault",
    """$S, f AS (SELECT CASE WHEN ir > 262143 OR red > 262143 THEN 1 WHEN ir = 262143 OR red = 262143 THEN 2 WHEN ir = 0 OR red = 0 OR ir < 10000 THEN 3 ELSE 0 END AS fault FROM s)
    SELECT fault, count(*) AS n FROM f GROUP BY fault""",
)
def _(spark, d_):
    return samples(spark, d_).groupBy(fn.spo2_fault(F.col("ir"), F.col("red")).alias("fault")).agg(F.count("*").alias("n"))


@query(
    "p12_spo2_zone",
    """$S SELECT event_id, CASE WHEN bad THEN 'unknown' WHEN round(86 + value / 35) >= 95 THEN 'normal' WHEN round(86 + value / 35) >= 93 THEN 'attention' ELSE 'low' END AS zone FROM s""",
)
def _(spark, d_):
    return samples(spark, d_).select("event_id", fn.spo2_zone(86 + F.col("value") / 35, ~F.col("bad")).alias("zone"))


@query(
    "p13_bpm_zone",
    """$S SELECT event_id, CASE WHEN bad THEN 'unknown' WHEN 60000 / rr_ms < 60 THEN 'low' WHEN 60000 / rr_ms <= 100 THEN 'normal' ELSE 'high' END AS zone FROM s""",
)
def _(spark, d_):
    return samples(spark, d_).select("event_id", fn.bpm_zone(60000 / F.col("rr_ms"), ~F.col("bad")).alias("zone"))


@query("v05_quantize", "$S SELECT event_id, CAST(greatest(-128, least(127, round(value / 2.0) - 100)) AS INTEGER) AS q FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", fn.quantize(F.col("value"), 2.0, -100).alias("q"))


# ------------------------------------------------------ intervals and features
@query(
    "a01_median_rate",
    "$S SELECT user_id, count(*) AS n_valid, round(60000.0 / quantile_cont(rr_ms, 0.5), 6) AS bpm FROM s WHERE rr_ms BETWEEN 250 AND 2000 GROUP BY user_id",
)
def _(spark, d_):
    return rounded(intervals.median_rate(samples(spark, d_), KEYS, "rr_ms").filter("n_valid > 0"))


def _hrv_sql(source: str) -> str:
    return f"""$S, d AS ({source})
    SELECT user_id, count(*) AS n_intervals, round(avg(rr_ms), 6) AS mean_ms, round(stddev_samp(rr_ms), 6) AS sdnn_ms,
           round(sqrt(avg(diff * diff)), 6) AS rmssd_ms, round(100.0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 50 THEN 1 ELSE 0 END), 6) AS pnn50_pct
    FROM d GROUP BY user_id HAVING count(*) >= 2"""


@query(
    "a02_hrv",
    _hrv_sql("SELECT user_id, rr_ms, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM s WHERE rr_ms BETWEEN 250 AND 2000"),
)
def _(spark, d_):
    return rounded(intervals.variability(samples(spark, d_), KEYS, ORDER, "rr_ms"))


@query(
    "a29_hrv_adjacent",
    _hrv_sql(
        """SELECT user_id, rr_ms, diff FROM (SELECT user_id, rr_ms, rr_ms - lag(CASE WHEN rr_ms BETWEEN 300 AND 2000 THEN rr_ms END)
           OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM s) WHERE rr_ms BETWEEN 300 AND 2000"""
    ),
)
def _(spark, d_):
    return rounded(intervals.variability(samples(spark, d_), KEYS, ORDER, "rr_ms", 300.0, 2000.0, bridging=False))


@query(
    "a04_stress_features",
    """$S, m AS (SELECT user_id, quantile_cont(rr_ms, 0.5) AS m FROM s WHERE rr_ms BETWEEN 333.33 AND 1500 GROUP BY user_id),
    c AS (SELECT s.*, rr_ms BETWEEN 333.33 AND 1500 AND rr_ms BETWEEN m * (1 - 0.30) AND m * (1 + 0.30) AS clean FROM s JOIN m USING (user_id)),
    x AS (SELECT user_id, rr_ms AS x, 60000.0 / rr_ms AS h, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM c WHERE clean),
    n AS (SELECT user_id, count(*) AS n_raw FROM s GROUP BY user_id),
    g AS (SELECT user_id, count(*) AS n_clean, count(diff) AS n_diff, avg(h) AS mean_hr_bpm, stddev_samp(h) AS std_hr_bpm, min(h) AS min_hr_bpm, max(h) AS max_hr_bpm,
          avg(x) AS mean_pp_ms, quantile_cont(x, 0.5) AS median_pp_ms, stddev_samp(x) AS sdnn_ms, sqrt(avg(diff * diff)) AS rmssd_ms, stddev_samp(diff) AS sdsd_ms,
          100.0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 20 THEN 1 ELSE 0 END) AS pnn20_pct,
          100.0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 50 THEN 1 ELSE 0 END) AS pnn50_pct, stddev_samp(x) / avg(x) AS cvnn FROM x GROUP BY user_id),
    r AS (SELECT n.user_id, n_raw + 1 AS beat_count, coalesce(n_clean, 0) / n_raw AS valid_rr_ratio,
          n_raw + 1 >= 40 AND n_clean >= 3 AND n_diff >= 2 AND n_clean / n_raw >= 0.5 AS ok, g.* EXCLUDE (user_id) FROM n LEFT JOIN g USING (user_id))
    SELECT user_id, CASE WHEN ok THEN 'ready' ELSE 'quality_rejected' END AS status, beat_count, round(valid_rr_ratio, 6) AS valid_rr_ratio,
      CASE WHEN ok THEN round(mean_hr_bpm, 6) END AS mean_hr_bpm, CASE WHEN ok THEN round(std_hr_bpm, 6) END AS std_hr_bpm,
      CASE WHEN ok THEN round(min_hr_bpm, 6) END AS min_hr_bpm, CASE WHEN ok THEN round(max_hr_bpm, 6) END AS max_hr_bpm,
      CASE WHEN ok THEN round(mean_pp_ms, 6) END AS mean_pp_ms, CASE WHEN ok THEN round(median_pp_ms, 6) END AS median_pp_ms,
      CASE WHEN ok THEN round(sdnn_ms, 6) END AS sdnn_ms, CASE WHEN ok THEN round(rmssd_ms, 6) END AS rmssd_ms, CASE WHEN ok THEN round(sdsd_ms, 6) END AS sdsd_ms,
      CASE WHEN ok THEN round(pnn20_pct, 6) END AS pnn20_pct, CASE WHEN ok THEN round(pnn50_pct, 6) END AS pnn50_pct, CASE WHEN ok THEN round(cvnn, 6) END AS cvnn FROM r""",
)
def _(spark, d_):
    return rounded(intervals.stress_features(samples(spark, d_), KEYS, ORDER, "rr_ms", min_ratio=0.5))


@query(
    "a05_af_features",
    """$S, v AS (SELECT user_id, rr_ms / 1000.0 AS x, ts_us, event_id FROM s WHERE rr_ms BETWEEN 200 AND 2000),
    d AS (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM v)
    SELECT user_id, count(*) AS interval_count, round(avg(x), 6) AS mean_rr, round(quantile_cont(x, 0.5), 6) AS median_rr, round(stddev_samp(x), 6) AS sdnn,
      round(sqrt(avg(diff * diff)), 6) AS rmssd, round(100.0 * avg(CASE WHEN diff IS NULL THEN NULL WHEN abs(diff) > 0.050 THEN 1 ELSE 0 END), 6) AS pnn50,
      round(stddev_samp(x) / avg(x), 6) AS cv_rr, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr_rr, round(min(x), 6) AS min_rr, round(max(x), 6) AS max_rr
    FROM d GROUP BY user_id HAVING count(*) >= 3""",
)
def _(spark, d_):
    return rounded(intervals.af_features(samples(spark, d_), KEYS, ORDER, "rr_ms"))


@query(
    "a18_interval_summary",
    """$S, v AS (SELECT user_id, rr_ms / 1000.0 AS x, ts_us, event_id FROM s), d AS (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS diff FROM v WHERE x BETWEEN 0.30 AND 2.0),
    g AS (SELECT user_id, count(*) AS n_valid, round(60.0 / quantile_cont(x, 0.5), 6) AS median_bpm, round(coalesce(stddev_samp(x), 0.0), 6) AS sdnn_s,
          CASE WHEN count(*) > 2 THEN round(sqrt(avg(diff * diff)), 6) END AS rmssd_s FROM d GROUP BY user_id)
    SELECT n.user_id, n_raw, coalesce(n_valid, 0) AS n_valid, median_bpm, sdnn_s, rmssd_s FROM (SELECT user_id, count(*) AS n_raw FROM s GROUP BY user_id) n LEFT JOIN g USING (user_id)""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("x", F.col("rr_ms") / 1000.0)
    return rounded(intervals.interval_summary(rows, KEYS, ORDER, "x"))


_WINDOW_SQL = """$S, g AS (SELECT user_id, count(*) AS received, count(*) FILTER (WHERE bad) AS dropped, count(*) FILTER (WHERE {clip}) AS clipped,
  bool_or(ir >= 50000) AS contact, stddev_samp(ir) AS ir_ac, avg(ir) AS ir_dc, corr(red, ir) AS correlation, stddev_samp(raw) AS std, count(*) FILTER (WHERE event_type = 'purchase') AS peaks
  FROM s GROUP BY user_id), q AS (SELECT *, least(1.0, received / 60.0) AS complete, clipped / received AS clipping, CASE WHEN ir_dc > 0 THEN ir_ac / ir_dc ELSE 0 END AS perfusion FROM g), """


def _windows(df: DataFrame, clipped: Column) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.count("*").alias("received"), F.count(F.when(F.col("bad"), 1)).alias("dropped"), F.count(F.when(clipped, 1)).alias("clipped"),
        F.bool_or(F.col("ir") >= fn.CONTACT_IR).alias("contact"), F.stddev_samp("ir").alias("ir_ac"), F.avg("ir").alias("ir_dc"), F.corr("red", "ir").alias("correlation"),
        F.stddev_samp("raw").alias("std"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("peaks"),
    )


@query(
    "a10_ppg_quality",
    _WINDOW_SQL.replace("{clip}", _CLIP)
    + """r AS (SELECT *, CAST((CASE WHEN complete < 0.98 OR dropped > 0 THEN 1 ELSE 0 END) + (CASE WHEN clipping > 0.01 THEN 4 ELSE 0 END) + (CASE WHEN NOT contact THEN 8 ELSE 0 END)
      + (CASE WHEN perfusion < 0.001 THEN 16 ELSE 0 END) + (CASE WHEN abs(correlation) < 0.5 THEN 32 ELSE 0 END) + (CASE WHEN peaks < 3 THEN 256 ELSE 0 END) AS INTEGER) AS reasons FROM q)
    SELECT user_id, reasons, round(0.25 * (greatest(0.0, least(1.0, complete)) + greatest(0.0, least(1.0, 1 - clipping * 20)) + greatest(0.0, least(1.0, perfusion / 0.003))
      + greatest(0.0, least(1.0, abs(correlation)))), 6) AS score, CASE WHEN reasons = 0 THEN 'good' ELSE 'poor' END AS status FROM r""",
)
def _(spark, d_):
    rows = samples(spark, d_)
    g, c = _windows(rows, fn.has_bit(_ppg_flags(), 2)), F.col
    q = fn.ppg_quality(c("received"), F.lit(60.0), c("dropped"), F.lit(0), F.lit(0), c("clipped"), c("contact"), c("ir_ac"), c("ir_dc"), c("correlation"), c("peaks"))
    return rounded(g.select("user_id", *[v.alias(k) for k, v in q.items()]))


@query(
    "a11_ecg_quality",
    _WINDOW_SQL.replace("{clip}", "raw <= 8 OR raw >= 4087")
    + """r AS (SELECT *, CAST((CASE WHEN complete < 0.98 THEN 1 ELSE 0 END) + (CASE WHEN clipping > 0.01 THEN 4 ELSE 0 END) + (CASE WHEN dropped > 5 THEN 64 ELSE 0 END)
      + (CASE WHEN std < 4.0 THEN 128 ELSE 0 END) + (CASE WHEN peaks < 3 THEN 256 ELSE 0 END) AS INTEGER) AS reasons FROM q)
    SELECT user_id, reasons, round(0.25 * (greatest(0.0, least(1.0, complete)) + greatest(0.0, least(1.0, 1 - clipping * 20)) + greatest(0.0, least(1.0, std / 16.0))
      + CASE WHEN dropped <= 5 THEN 1 ELSE 0 END), 6) AS score, CASE WHEN reasons = 0 THEN 'good' ELSE 'poor' END AS status FROM r""",
)
def _(spark, d_):
    rows = samples(spark, d_)
    g, c = _windows(rows, fn.has_bit(fn.ecg_flags(F.col("raw"), F.lit(False), F.lit(False)), 2)), F.col
    off = F.greatest(F.lit(0), c("dropped") - 5)
    q = fn.ecg_quality(c("received"), F.lit(60.0), F.lit(0), F.lit(0), c("clipped"), off, c("std"), c("peaks"))
    return rounded(g.select("user_id", *[v.alias(k) for k, v in q.items()]))


@query(
    "a14_flat_ratio",
    """$S, f AS (SELECT user_id, raw = lag(raw) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS same FROM s)
    SELECT user_id, coalesce(round(avg(CASE WHEN same IS NULL THEN NULL WHEN same THEN 1 ELSE 0 END), 6), 1.0) AS flat_ratio FROM f GROUP BY user_id""",
)
def _(spark, d_):
    same = F.col("raw") == F.lag("raw").over(series.ordered(KEYS, ORDER))
    rows = samples(spark, d_).withColumn("same", same)
    return rounded(rows.groupBy("user_id").agg(F.coalesce(F.avg(F.col("same").cast("int")), F.lit(1.0)).alias("flat_ratio")))


@query(
    "a15_moments",
    """$S, m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY user_id)
    SELECT user_id, round(CASE WHEN max(sd) <= 1e-12 THEN 0 ELSE avg(power((value - m) / sd, 3)) END, 6) AS skew, round(CASE WHEN max(sd) <= 1e-12 THEN 0 ELSE avg(power((value - m) / sd, 4)) END, 6) AS kurtosis
    FROM s JOIN m USING (user_id) WHERE sd > 1e-12 GROUP BY user_id""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.stddev_pop("value").alias("sd"), F.skewness("value").alias("skew"), (F.kurtosis("value") + 3).alias("kurtosis"))
    return rounded(g.filter("sd > 1e-12").drop("sd"))


@query(
    "a20_stream_validation",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS step FROM s)
    SELECT user_id, count(*) AS n_rows, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS n_missing, count(*) FILTER (WHERE step <= 0) AS n_regressions,
      round((max(ts_us) - min(ts_us)) / 1e6, 6) AS duration_s, quantile_cont(step, 0.5) AS median_step_us, round(CASE WHEN quantile_cont(step, 0.5) > 0 THEN 1e6 / quantile_cont(step, 0.5) END, 12) AS rate_hz
    FROM t GROUP BY user_id""",
)
def _(spark, d_):
    v = series.stream_validation(samples(spark, d_), KEYS, ORDER, "ts_us", "event_id")
    return v.withColumn("duration_s", F.round("duration_s", 6)).withColumn("rate_hz", F.round("rate_hz", 12))


@query(
    "a21_replay_summary",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER w AS dt, event_id - lag(event_id) OVER w AS dn FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts_us, event_id))
    SELECT event_type, count(*) AS n_rows, CAST(coalesce(sum(greatest(0, dn - 1)), 0) AS BIGINT) AS n_lost, count(*) FILTER (WHERE dt <= 0) AS n_not_forward, round(sum(dt) / count(dt), 3) AS mean_period_us,
      count(*) FILTER (WHERE raw <= 8 OR raw >= 4087) AS n_clipped FROM t GROUP BY event_type""",
)
def _(spark, d_):
    """Each session's stream of a type by itself, then added up, so that no window spans sessions."""
    clipped, c = fn.rail(F.col("raw"), *fn.ECG_CLIP), F.col
    streams = series.replay_summary(samples(spark, d_), ["event_type", "user_id"], ORDER, "ts_us", "event_id", clipped)
    sums = [F.sum(n).alias(n) for n in ("n_rows", "n_lost", "n_not_forward", "n_clipped")]
    period = F.sum("span_us") / F.nullif(F.sum(c("n_rows") - 1), F.lit(0))
    return rounded(streams.groupBy("event_type").agg(*sums, period.alias("mean_period_us")), 3)


@query("a22_record_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d_):
    return samples(spark, d_).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a24_split_summary", "SELECT l_returnflag AS split, l_linestatus AS label, count(*) AS n, count(DISTINCT l_suppkey) AS n_subjects FROM lineitem GROUP BY ALL")
def _(spark, d_):
    rows = spark.read.parquet(f"{d_}/lineitem.parquet")
    return rows.groupBy(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("label")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_subjects"))


@query(
    "a25_pivot",
    """$S SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
    count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM s GROUP BY user_id""",
)
def _(spark, d_):
    return samples(spark, d_).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("a26_leakage", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_splits FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def _(spark, d_):
    return series.leakage(spark.read.parquet(f"{d_}/lineitem.parquet"), "l_suppkey", "l_returnflag")


@query(
    "a27_classification",
    """WITH p AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_discount * 5 + l_tax * 6.25 AS sc FROM lineitem),
    c AS (SELECT l_returnflag, count(*) FILTER (WHERE y = 1 AND sc >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND sc >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND sc < 0.5) AS fn,
      count(*) FILTER (WHERE y = 0 AND sc < 0.5) AS tn FROM p GROUP BY l_returnflag),
    b AS (SELECT l_returnflag, sc, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM p GROUP BY ALL),
    w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
    a AS (SELECT l_returnflag, sum(p * (below + n / 2)) AS wins FROM w GROUP BY l_returnflag)
    SELECT l_returnflag, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS balanced_accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
      CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1,
      CASE WHEN (tp + fn) * (fp + tn) > 0 THEN round(wins / ((tp + fn) * (fp + tn)), 6) END AS auc FROM c JOIN a USING (l_returnflag)""",
)
def _(spark, d_):
    rows = spark.read.parquet(f"{d_}/lineitem.parquet").select(
        "l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_discount") * 5 + F.col("l_tax") * 6.25).alias("sc")
    )
    return rounded(series.classification_metrics(rows, ["l_returnflag"], "y", "sc"))


# ------------------------------------------------------------ order and windows
@query(
    "w03_continuity",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER w AS step FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
    g AS (SELECT *, sum(CASE WHEN step > 43200000000 OR step <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM t)
    SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM g GROUP BY ALL""",
)
def _(spark, d_):
    rows = series.continuity(samples(spark, d_), KEYS, ORDER, "ts_us", 43_200_000_000)
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


_RUNS = """$S, c AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) THEN 1 ELSE 0 END AS changed FROM s),
    r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c),
    u AS (SELECT user_id, run, event_type, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_rows FROM r GROUP BY ALL)"""


@query("w04_runs", _RUNS + " SELECT * FROM u")
def _(spark, d_):
    rows = series.runs(samples(spark, d_), KEYS, ORDER, "event_type")
    return rows.select("user_id", "run", "event_type", F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"), "n_rows")


@query("j02_windows_in_runs", _RUNS + " SELECT user_id, event_type, unnest(range(first_idx, last_idx - 2 + 2, 1)) AS start_idx FROM u WHERE last_idx - first_idx >= 1".replace("last_idx - 2 + 2", "last_idx"))
def _(spark, d_):
    rows = series.runs(samples(spark, d_), KEYS, ORDER, "event_type")
    return series.windows_in_runs(rows, 2, 1).select("user_id", "event_type", "start_idx")


@query(
    "w05_rolling",
    """$S, r AS (SELECT user_id, event_id, idx + 1 AS rn, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, sqrt(avg(value * value) OVER w) AS rms FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms FROM r WHERE rn >= 10 AND (rn - 10) % 5 = 0""",
)
def _(spark, d_):
    return rounded(series.rolling(samples(spark, d_), KEYS, ORDER, "value", 10, 5).select("user_id", "event_id", "mean", "std", "rms"))


@query(
    "w06_local_maxima",
    """$S, m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, max(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM s)
    SELECT user_id, event_id, value FROM m WHERE value > b AND value >= a""",
)
def _(spark, d_):
    return series.local_maxima(samples(spark, d_), KEYS, ORDER, "value", 3).select("user_id", "event_id", "value")


@query(
    "w07_centred_mean",
    "$S SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS mean FROM s",
)
def _(spark, d_):
    return rounded(samples(spark, d_).select("event_id", series.centred_mean("value", KEYS, ORDER, 5).alias("mean")))


@query("w08_decimated", "$S SELECT user_id, event_id FROM s WHERE (idx + 1) % 4 = 0")
def _(spark, d_):
    return series.decimated(samples(spark, d_), KEYS, ORDER, 4).select("user_id", "event_id")


@query("w09_last_rows", "$S SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) AS n FROM s) WHERE n <= 16")
def _(spark, d_):
    return series.last_rows(samples(spark, d_), KEYS, ORDER, 16).select("user_id", "event_id")


@query("f10_pair_means", "$S SELECT user_id, idx // 2 AS pair, CAST((sum(raw) + 1) // 2 AS BIGINT) AS mean FROM s GROUP BY user_id, idx // 2 HAVING count(*) = 2")
def _(spark, d_):
    return series.pair_means(samples(spark, d_), KEYS, ORDER, "raw").select("user_id", "pair", "mean")


_SESSION = "$S, f AS (SELECT *, min(ts_us) OVER (PARTITION BY user_id) AS t0 FROM s)"


def _from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("t0", F.min("ts_us").over(Window.partitionBy("user_id")))


@query(
    "r05_tumbling",
    _SESSION + " SELECT user_id, (ts_us - t0) // 86400000000 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY ALL",
)
def _(spark, d_):
    rows = _from_start(spark, d_)
    rows = series.session_windows(rows, KEYS, "ts_us", F.col("t0"), 86_400_000_000, 86_400_000_000)
    return rounded(rows.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(
    "r06_sliding_candidates",
    _SESSION
    + """, w AS (SELECT user_id, k, count(*) AS n, round(avg(value), 6) AS mean FROM f, range(0, 7) r(k) WHERE ts_us - t0 >= k * 86400000000 AND ts_us - t0 < k * 86400000000 + 518400000000 GROUP BY ALL) SELECT * FROM w""",
)
def _(spark, d_):
    rows = _from_start(spark, d_)
    rows = series.session_windows(rows, KEYS, "ts_us", F.col("t0"), 6 * 86_400_000_000, 86_400_000_000, 7)
    return rounded(rows.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(
    "t01_best_window",
    _SESSION
    + """, w AS (SELECT user_id, k, count(*) AS n, avg(value) AS mean FROM f, range(0, 7) r(k) WHERE ts_us - t0 >= k * 86400000000 AND ts_us - t0 < k * 86400000000 + 518400000000 GROUP BY ALL)
    SELECT user_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean > 100 DESC, n DESC, k) AS rn FROM w) WHERE rn = 1""",
)
def _(spark, d_):
    rows = _from_start(spark, d_)
    rows = series.session_windows(rows, KEYS, "ts_us", F.col("t0"), 6 * 86_400_000_000, 86_400_000_000, 7)
    w = rows.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return series.best_window(w, KEYS, [(F.col("mean") > 100).desc(), F.desc("n"), F.asc("k")]).select("user_id", "k", "n")


@query(
    "r07_count_windows",
    """$S, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s)
    SELECT user_id, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM n, range(0, 2000) r(k) WHERE k * 5 + 10 <= n AND idx >= k * 5 AND idx < k * 5 + 10 GROUP BY ALL""",
)
def _(spark, d_):
    rows = series.count_windows(samples(spark, d_), KEYS, ORDER, 10, 5)
    return rounded(rows.groupBy("user_id", "k").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


# ----------------------------------------------------------------- join shapes
@query(
    "j05_as_of",
    """SELECT * FROM ($S, l AS (SELECT * FROM s WHERE event_type = 'purchase'), r AS (SELECT user_id, ts_us AS m FROM s WHERE event_type = 'view')
    SELECT l.user_id, l.ts_us, CASE WHEN l.ts_us - max(m) BETWEEN 1000000 AND 86400000000 THEN l.ts_us - max(m) END AS delay_us, count(DISTINCT l.event_id) AS n
    FROM l LEFT JOIN r ON l.user_id = r.user_id AND m < l.ts_us GROUP BY l.user_id, l.ts_us) WHERE delay_us IS NOT NULL""",
)
def _(spark, d_):
    rows = samples(spark, d_)
    views, buys = rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'")
    found = series.as_of(buys, views, KEYS, "ts_us", 1_000_000, 86_400_000_000)
    return found.filter("delay_us IS NOT NULL").groupBy("user_id", "ts_us").agg(F.max("delay_us").alias("delay_us"), F.count("*").alias("n"))


@query(
    "j09_refine_peaks",
    """$S, p AS (SELECT user_id, idx AS peak_idx FROM s WHERE event_type = 'signup'),
    c AS (SELECT p.user_id, peak_idx, s.idx, s.value, row_number() OVER (PARTITION BY p.user_id, peak_idx ORDER BY abs(s.value) DESC, s.idx) AS rn FROM p JOIN s ON p.user_id = s.user_id AND s.idx BETWEEN peak_idx - 2 AND peak_idx + 2)
    SELECT user_id, peak_idx, idx AS refined_idx, value AS amplitude FROM c WHERE rn = 1""",
)
def _(spark, d_):
    rows = indexed(spark, d_)
    return series.refine_peaks(rows, rows.filter("event_type = 'signup'"), KEYS, "idx", "value", 2)


@query("j01_broadcast_lookup", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d_):
    # Spark broadcasts the lookup by its known size, and shuffles it if it outgrows the threshold.
    customer, nation = spark.read.parquet(f"{d_}/customer.parquet"), spark.read.parquet(f"{d_}/nation.parquet")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query("u02_intersect", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d_):
    rows = samples(spark, d_)
    return rows.filter("event_type = 'error'").select("user_id").intersect(rows.filter("event_type = 'purchase'").select("user_id"))


@query("u03_except", "SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(spark, d_):
    left = spark.read.parquet(f"{d_}/customer.parquet").select(F.col("c_nationkey").alias("k"))
    right = spark.read.parquet(f"{d_}/supplier.parquet").filter("s_acctbal > 5000").select("s_nationkey")
    return left.subtract(right)


@query(
    "t07_balanced_sample",
    """SELECT user_id, event_type, least(min(n) OVER (PARTITION BY user_id), 15) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)""",
)
def _(spark, d_):
    picked = series.balanced_sample(samples(spark, d_), ["user_id"], "event_type", "event_id", 15)
    return picked.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# -------------------------------------------------------------- scores, decision
_RATIO = "(stddev_samp(red) / avg(red)) / (stddev_samp(ir) / avg(ir))"


@query(
    "o01_ratio_of_ratios",
    f"""$S, g AS (SELECT user_id, avg(red) AS rd, avg(ir) AS idc, stddev_samp(ir) AS ia, {_RATIO} AS ratio FROM s GROUP BY user_id)
    SELECT user_id, CASE WHEN rd > 0 AND idc > 0 AND ia > 0 THEN round(ratio, 6) END AS ratio,
      CASE WHEN rd > 0 AND idc > 0 AND ia > 0 AND ratio BETWEEN 0.2 AND 1.8 THEN round(greatest(0.0, least(100.0, -25 * ratio + 110)), 6) END AS percent FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.stddev_samp("red").alias("ra"), F.avg("red").alias("rd"), F.stddev_samp("ir").alias("ia"), F.avg("ir").alias("id"))
    ratio, percent = fn.ratio_of_ratios(F.col("ra"), F.col("rd"), F.col("ia"), F.col("id"))
    return rounded(g.select("user_id", ratio.alias("ratio"), percent.alias("percent")))


@query(
    "o08_logistic_score",
    """$S, g AS (SELECT user_id, avg(rr_ms) AS m, stddev_samp(rr_ms) AS sd FROM s GROUP BY user_id), z AS (SELECT user_id, 0.1 + (m - 700.0) / 80.0 * -0.8 + (sd - 250.0) / 60.0 * 0.5 AS z FROM g)
    SELECT user_id, CASE WHEN z IS NULL THEN NULL ELSE round(1 / (1 + exp(-z)), 6) END AS p FROM z""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.avg("rr_ms").alias("m"), F.stddev_samp("rr_ms").alias("sd"))
    return rounded(g.select("user_id", fn.logistic_score([F.col("m"), F.col("sd")], [700.0, 250.0], [80.0, 60.0], [-0.8, 0.5], 0.1).alias("p")))


@query(
    "o10_stress_branch",
    """$S, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE bad) AS nb, avg(rr_ms) AS m FROM s GROUP BY user_id),
    p AS (SELECT *, 1 / (1 + exp(-(0.1 + (m - 700.0) / 80.0 * -0.8))) AS p, nb <= 10 AS good, CASE WHEN n >= 60 THEN 'ready' WHEN n >= 40 THEN 'quality_rejected' ELSE 'not_ready' END AS vs FROM g),
    b AS (SELECT user_id, good, nb, p, CASE WHEN NOT good THEN 'quality_rejected' WHEN vs = 'not_ready' THEN 'not_ready' WHEN vs = 'quality_rejected' THEN 'quality_rejected' ELSE 'valid' END AS status FROM p)
    SELECT user_id, status, CASE WHEN NOT good THEN nb ELSE 0 END AS reason_flags, CASE WHEN status = 'valid' THEN round(p, 6) END AS score,
      CASE WHEN status = 'valid' THEN round(greatest(p, 1 - p), 6) END AS confidence, status = 'valid' AND p >= 0.5 AS alert,
      CASE WHEN status = 'valid' THEN CASE WHEN p >= 0.5 THEN 'stress' ELSE 'baseline' END END AS label FROM b""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("nb"), F.avg("rr_ms").alias("m"))
    status = F.when(F.col("n") >= 60, "ready").when(F.col("n") >= 40, "quality_rejected").otherwise("not_ready")
    branch = fn.stress_branch(F.col("nb") <= 10, F.col("nb"), status, fn.logistic_score([F.col("m")], [700.0], [80.0], [-0.8], 0.1))
    return rounded(g.select("user_id", *[v.alias(k) for k, v in branch.items()]))


@query(
    "o15_decision",
    """$S, g AS (SELECT user_id, count(*) FILTER (WHERE bad) AS nb, avg(value) AS m FROM s GROUP BY user_id)
    SELECT user_id, nb <= 10 AND NOT (m > 100) AS normal, nb > 20 OR nb > 10 AS remeasure FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.count(F.when(F.col("bad"), 1)).alias("nb"), F.avg("value").alias("m"))
    status = F.when(F.col("nb") <= 10, "valid").otherwise("quality_rejected")
    out = fn.decision([status], [F.col("m") > 100], [F.lit(True)], F.col("nb") > 20)
    return g.select("user_id", *[v.alias(k) for k, v in out.items()])


# --------------------------------------------------------------- the flagship
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision row for each session: quality, interval features, score and
    branch, from one pass over the samples and one shuffle by session."""
    rows = samples(spark, sf_dir)
    c = F.col
    g = _windows(rows, fn.has_bit(_ppg_flags(), 2))
    quality = fn.ppg_quality(c("received"), F.lit(60.0), c("dropped"), F.lit(0), F.lit(0), c("clipped"), c("contact"), c("ir_ac"), c("ir_dc"), c("correlation"), c("peaks"))
    features = intervals.stress_features(rows, KEYS, ORDER, "rr_ms", min_ratio=0.5)
    joined = g.select("user_id", *[v.alias(f"quality_{k}") for k, v in quality.items()]).join(features, "user_id", "left")
    p = fn.logistic_score([c("mean_pp_ms"), c("rmssd_ms")], [700.0, 250.0], [80.0, 60.0], [-0.8, 0.5], 0.1)
    branch = fn.stress_branch(c("quality_status") == "good", c("quality_reasons"), c("status"), p)
    return rounded(joined.select("user_id", "quality_reasons", "quality_score", "beat_count", *[v.alias(f"stress_{k}") for k, v in branch.items()]))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""WITH q AS ({SQL["a10_ppg_quality"]}),
    f AS ({SQL["a04_stress_features"].replace("round(mean_pp_ms, 6)", "mean_pp_ms").replace("round(rmssd_ms, 6)", "rmssd_ms")}),
    b AS (SELECT q.user_id, reasons, score, q.status = 'good' AS good, beat_count, f.status AS vs,
      1 / (1 + exp(-(0.1 + (mean_pp_ms - 700.0) / 80.0 * -0.8 + (rmssd_ms - 250.0) / 60.0 * 0.5))) AS p FROM q LEFT JOIN f USING (user_id)),
    r AS (SELECT *, good AND vs = 'ready' AS reached FROM b)
    SELECT user_id, reasons AS quality_reasons, score AS quality_score, beat_count,
      CASE WHEN NOT good THEN 'quality_rejected' WHEN NOT reached THEN vs ELSE 'valid' END AS stress_status, CASE WHEN NOT good THEN reasons ELSE 0 END AS stress_reason_flags,
      CASE WHEN reached THEN round(p, 6) END AS stress_score, CASE WHEN reached THEN round(greatest(p, 1 - p), 6) END AS stress_confidence,
      reached AND p >= 0.5 AS stress_alert, CASE WHEN reached THEN CASE WHEN p >= 0.5 THEN 'stress' ELSE 'baseline' END END AS stress_label FROM r"""


def _loaded() -> None:
    from sensorloom.plans import blocks, detections, extra, more, rest  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(SQL)
