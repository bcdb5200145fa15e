"""Queries over sources, sinks, filters and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import storage
from sensorloom.functions import signals as fn
from sensorloom.operators import blocks, dsp, oxygen, series, waveforms
from sensorloom.plans.catalog import KEYS, ORDER, rounded, samples
from sensorloom.plans.register import query
from sensorloom.sources import logs
from sensorloom.sources.log_source import LogSource
from sensorloom.streaming import processors, sessions


def _ema_sql(output: str, alpha: float) -> str:
    return f"""$R, r AS (SELECT user_id, idx, event_id, value * 0.7310585786e0 AS x, value * 0.7310585786e0 AS y FROM s WHERE idx = 0
    UNION ALL SELECT s.user_id, s.idx, s.event_id, s.value * 0.7310585786e0, r.y + {alpha} * (s.value * 0.7310585786e0 - r.y) FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1)
    SELECT event_id, round({output}, 6) + 0.0 AS y FROM r"""


def _scaled(spark, d_) -> DataFrame:
    """Scaled to values without short decimals, so that no rounded result is a tie."""
    return samples(spark, d_).withColumn("x", F.col("value") * 0.7310585786)


def _filtered(rows: DataFrame, value: str, f: blocks.Affine) -> DataFrame:
    return rounded(blocks.recurrence(rows, KEYS, ORDER, value, {"y": f}, ["event_id"]).select("event_id", "y"))


@query("f01_dc_blocker", _ema_sql("x - y", 0.05))
def _(spark, d_):
    return _filtered(_scaled(spark, d_), "x", blocks.ema(0.05, of_level=True))


@query("f02_low_pass", _ema_sql("y", 0.18))
def _(spark, d_):
    return _filtered(_scaled(spark, d_), "x", blocks.ema(0.18))


@query(
    "f04_preprocess",
    """$R, r AS (SELECT user_id, idx, event_id, value * 0.7310585786e0 AS d, CAST(0 AS DOUBLE) AS z FROM s WHERE idx = 0
    UNION ALL SELECT s.user_id, s.idx, s.event_id, r.d + 0.0025 * (s.value * 0.7310585786e0 - r.d), r.z + 0.18 * (s.value * 0.7310585786e0 - (r.d + 0.0025 * (s.value * 0.7310585786e0 - r.d)) - r.z) FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1)
    SELECT event_id, round(z, 6) + 0.0 AS y FROM r""",
)
def _(spark, d_):
    return _filtered(_scaled(spark, d_), "x", blocks.level_then_smooth(dsp.PPG["dc"], dsp.PPG["low_pass"]))


def _peaks_sql(height: str, scale: float, refractory_us: int) -> str:
    """Each session's samples in order with the two heights before, the envelope and the last peak; ``height`` is of a sample {t}value."""
    first, following = height.format(t=""), height.format(t="s.")
    return f"""$R, r AS (SELECT user_id, idx, {first} AS p1, CAST(0 AS DOUBLE) AS p2, ts_us AS t1, 0.995 + 0.005 * {first} AS env, CAST(0 AS BIGINT) AS last_us, false AS hit, CAST(0 AS DOUBLE) AS amp FROM s WHERE idx = 0
    UNION ALL SELECT user_id, idx, x, p1, t, e, CASE WHEN hit THEN t1 ELSE last_us END, hit, p1 FROM (
      SELECT user_id, idx, x, t, p1, t1, last_us, e, idx >= 2 AND p1 > p2 AND p1 >= x AND p1 > e * {scale} AND (last_us = 0 OR t1 - last_us >= {refractory_us}) AS hit
      FROM (SELECT s.user_id, s.idx, {following} AS x, s.ts_us AS t, r.p1, r.p2, r.t1, r.last_us, 0.995 * r.env + 0.005 * {following} AS e FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1)))
    SELECT user_id, last_us AS peak_us, amp AS amplitude FROM r WHERE hit"""


@query("f06_ppg_peaks", _peaks_sql("{t}value", 0.45, 280_000))
def _(spark, d_):
    return blocks.session_peaks(samples(spark, d_), KEYS, ORDER, "ts_us", "value", dsp.PPG)


@query("f07_r_peaks", _peaks_sql("abs({t}value - 70)", 0.55, 240_000))
def _(spark, d_):
    centred = samples(spark, d_).withColumn("x", F.col("value") - 70)
    return blocks.session_peaks(centred, KEYS, ORDER, "ts_us", "x", dsp.ECG)


_SECTIONS = dsp.butterworth_sections("low", 4, 20.0, 200.0)


def _cascade_pass(name: str, source: str, starts: list[float]) -> str:
    """A recursive table: two sections in series over the samples x of a table; z11 to z22 are what each keeps from
    a sample to the next, and begin as ``starts`` times the first sample."""
    (b0, b1, b2, a1, a2), (d0, d1, d2, c1, c2) = ([f"({x:.17e})" for x in row] for row in _SECTIONS.tolist())
    kept = ["z11", "z12", "z21", "z22"]

    def step(rows: str) -> str:
        return f"""SELECT user_id, idx, event_id, o2 AS y, {b1} * x - {a1} * o1 + z12 AS z11, {b2} * x - {a2} * o1 AS z12, {d1} * o1 - {c1} * o2 + z22 AS z21, {d2} * o1 - {c2} * o2 AS z22
        FROM (SELECT *, {d0} * o1 + z21 AS o2 FROM (SELECT *, {b0} * x + z11 AS o1 FROM ({rows})))"""

    first = "SELECT user_id, idx, event_id, x, " + ", ".join(f"({v:.17e}) * x AS {z}" for v, z in zip(starts, kept, strict=True)) + f" FROM {source} WHERE idx = 0"
    following = f"SELECT t.user_id, t.idx, t.event_id, t.x, {', '.join(kept)} FROM {name} JOIN {source} t ON t.user_id = {name}.user_id AND t.idx = {name}.idx + 1"
    return f"{name} AS ({step(first)} UNION ALL {step(following)})"


def _zero_phase_sql() -> str:
    """Odd extensions at both ends of sessions of 12 samples or more, a pass forwards, a pass backwards."""
    reach, starts = 3 * (2 * len(_SECTIONS) + 1), blocks.sections(_SECTIONS, settled=True).first.tolist()
    return f"""$R, n AS (SELECT user_id, count(*) AS n, avg(value) AS mean, arg_min(value, idx) AS x0, arg_max(value, idx) AS x1, least({reach}, count(*) - 2) AS pad FROM s GROUP BY user_id),
    k AS (SELECT s.user_id, s.idx, s.event_id, value, n, mean, x0, x1, pad FROM s JOIN n USING (user_id)),
    e AS (SELECT user_id, pad + idx AS idx, event_id, value AS x FROM k WHERE n >= 12 UNION ALL SELECT user_id, pad - idx, NULL, 2 * x0 - value FROM k WHERE n >= 12 AND idx BETWEEN 1 AND pad
      UNION ALL SELECT user_id, pad + 2 * (n - 1) - idx, NULL, 2 * x1 - value FROM k WHERE n >= 12 AND n - 1 - idx BETWEEN 1 AND pad),
    {_cascade_pass("f", "e", starts)},
    b AS (SELECT user_id, max(idx) OVER (PARTITION BY user_id) - idx AS idx, event_id, y AS x FROM f),
    {_cascade_pass("g", "b", starts)}
    SELECT event_id, round(y, 6) + 0.0 AS y FROM g WHERE event_id IS NOT NULL UNION ALL SELECT event_id, round(value - mean, 6) + 0.0 FROM k WHERE n < 12"""


@query("f12_biquad_cascade", f"$R, x AS (SELECT user_id, idx, event_id, value AS x FROM s), {_cascade_pass('r', 'x', [0.0] * 4)} SELECT event_id, round(y, 6) + 0.0 AS y FROM r")
def _(spark, d_):
    return _filtered(samples(spark, d_), "value", blocks.sections(_SECTIONS))


@query(
    "r10_warm_up",
    _ema_sql("y", 0.18).split("SELECT event_id, round(y, 6)")[0] + "SELECT user_id, count(*) AS n, round(avg(y), 6) AS mean, round(max(y), 6) AS top FROM r WHERE idx >= 5 GROUP BY user_id",
)
def _(spark, d_):
    """The filter keeps its state over the warm-up, the first 5 samples; statistics begin after it."""
    smooth = blocks.recurrence(_scaled(spark, d_), KEYS, ORDER, "x", {"y": blocks.ema(0.18)})
    return rounded(smooth.filter("idx >= 5").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max("y").alias("top")))


@query("f15_zero_phase", _zero_phase_sql())
def _(spark, d_):
    return rounded(blocks.zero_phase(samples(spark, d_), KEYS, ORDER, "value", _SECTIONS, ["event_id"]).select("event_id", "y"))


@query(
    "f23_forward_mean4",
    """$S, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, sum(raw) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS t FROM s)
    SELECT event_id, CAST(CASE WHEN idx < n - 4 THEN t // 4 ELSE raw END AS DOUBLE) AS y FROM n""",
)
def _(spark, d_):
    return dsp.filtered(samples(spark, d_), KEYS, ORDER, "raw", lambda x: dsp.forward_mean4(x).astype(float), "event_id")


@query(
    "f14_look_ahead_peaks",
    """$R, c AS (SELECT *, max(value) OVER b AS top, max(value) OVER a AS following, (sum(value) OVER b + sum(value) OVER a) / 4 AS mean, count(*) OVER b + count(*) OVER a AS n FROM s
      WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
    k AS (SELECT user_id, idx, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS rn FROM c WHERE n = 4 AND value > top AND value >= following AND value - mean >= 5),
    r AS (SELECT user_id, rn, event_id, value, true AS kept, idx AS last FROM k WHERE rn = 1
      UNION ALL SELECT k.user_id, k.rn, k.event_id, k.value, k.idx - r.last >= 4, CASE WHEN k.idx - r.last >= 4 THEN k.idx ELSE r.last END FROM r JOIN k ON k.user_id = r.user_id AND k.rn = r.rn + 1)
    SELECT event_id, value FROM r WHERE kept""",
)
def _(spark, d_):
    return waveforms.look_ahead_peaks(samples(spark, d_), KEYS, ORDER, "value", 2, 5.0, 4, carry=["event_id", "value"]).select("event_id", "value")


@query("f18_r_peaks")
def _(spark, d_):
    """Beats of each user's values at 20 rows a second."""
    return waveforms.r_peaks(samples(spark, d_), KEYS, ORDER, "value", "value", 20.0, ["event_id"])


@query("f19_pulse_peaks")
def _(spark, d_):
    """Pulses between 0.5 and 4 Hz of each user's values at 64 rows a second."""
    return rounded(waveforms.pulse_peaks(samples(spark, d_), KEYS, ORDER, "value", waveforms.bandpass_sections(4, 0.5, 4.0, 64.0), 4, ["event_id"]))


@query("o05_oxygen")
def _(spark, d_):
    """Users with fewer samples than an estimate needs are not_ready."""
    c = F.col
    rows = samples(spark, d_).select("user_id", "ts_us", "event_id", (c("raw") + 60000).alias("ir"), (F.floor(c("raw") / 2) + 40000).alias("red"))
    return oxygen.session_oxygen(rows, KEYS, ORDER, "ir", "red")


# ------------------------------------------------------------- sources and sinks
def _records(spark, d_) -> DataFrame:
    c = F.col
    return samples(spark, d_).select(
        F.lit(2).alias("schema"), F.when(c("event_type") == "view", 1).otherwise(2).alias("record_type"), c("ts_us").alias("timestamp_us"), c("event_id").alias("sequence"),
        c("raw").cast("int").alias("value_a"), c("ir").cast("int").alias("value_b"), c("bad").cast("int").alias("flags"),
    )


_RECORDS_SQL = """$S SELECT CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS INTEGER) AS record_type, ts_us AS timestamp_us, event_id AS sequence, CAST(raw AS INTEGER) AS value_a, CAST(ir AS INTEGER) AS value_b,
    CAST(CASE WHEN bad THEN 1 ELSE 0 END AS INTEGER) AS flags FROM s"""


@query("s08_binary_log", _RECORDS_SQL)
def _(spark, d_):
    return logs.decode_frames(logs.encode_frames(_records(spark, d_))).drop("schema")


@query("s08_log_source", _RECORDS_SQL.replace("END AS INTEGER) AS flags", "END AS INTEGER) AS flags, CAST(NULL AS VARCHAR) AS reason"))
def _(spark, d_):
    """The records written as a log of many files, which many tasks read in byte ranges; damaged bytes would be rows with a reason."""
    folder = f"{storage.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    spark.dataSource.register(LogSource)
    _records(spark, d_).write.format("sensor_log").mode("append").save(folder)
    return spark.read.format("sensor_log").load(folder).drop("path", "offset", "n_bytes", "schema")


@query(
    "s05_batch_timestamps",
    """$S, b AS (SELECT *, 1 + event_id % 4 AS n, greatest(0, first_value(ts_us - (event_id % 4) * 5000) OVER (PARTITION BY user_id ORDER BY idx)) AS t0 FROM s),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
    SELECT event_id, CAST(k AS INTEGER) AS sample, CAST(t0 + (before + k) * 5000 AS BIGINT) AS timestamp_us FROM c, range(0, 4) r(k) WHERE k < n""",
)
def _(spark, d_):
    batches = samples(spark, d_).withColumn("n", 1 + F.col("event_id") % 4)
    return logs.batch_timestamps(batches, KEYS, ORDER, "ts_us", "n", 5000).select("event_id", "sample", "timestamp_us")


@query("s15_serial_lines", "$S SELECT ts_us AS timestamp_us, raw AS ecg_raw, red AS red_raw, ir AS ir_raw FROM s WHERE NOT bad")
def _(spark, d_):
    line = F.when(F.col("bad"), F.concat_ws(",", F.lit("LOG"), "ts_us")).when(F.col("event_id") % 2 == 0, F.concat_ws(",", F.lit("S"), "ts_us", "raw", "red", "ir"))
    return logs.parse_serial(samples(spark, d_).select(line.otherwise(F.concat_ws(",", F.lit("SAMPLE"), "ts_us", "event_id", "raw", "red", "ir")).alias("value")))


@query(
    "k03_result_fan_out",
    """$S, g AS (SELECT user_id, count(*) AS n, max(raw) AS top, count(*) FILTER (WHERE bad) AS nb FROM s GROUP BY user_id)
    SELECT user_id, 32 AS record_type, CAST(n AS DOUBLE) AS value FROM g UNION ALL SELECT user_id, 33, CAST(top AS DOUBLE) FROM g UNION ALL SELECT user_id, 34, CAST(nb AS DOUBLE) FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.count("*").alias("n"), F.max("raw").alias("top"), F.count(F.when(F.col("bad"), 1)).alias("nb"))
    return logs.fanned_out(g, ["user_id"], {32: F.col("n"), 33: F.col("top"), 34: F.col("nb")})


@query(
    "k08_telemetry",
    """$S, g AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE bad) > 12 THEN NULL ELSE max(raw) END AS top FROM s GROUP BY user_id)
    SELECT user_id, to_json({'user_id': user_id, 'n': n, 'top': top}) AS body FROM g""",
)
def _(spark, d_):
    g = samples(spark, d_).groupBy("user_id").agg(F.count("*").alias("n"), F.when(F.count(F.when(F.col("bad"), 1)) > 12, F.lit(None)).otherwise(F.max("raw")).alias("top"))
    return logs.telemetry(g, ["user_id", "n", "top"]).select("user_id", "body")


# ------------------------------------------------------------------- streaming
def _stream(spark, d_) -> DataFrame:
    """The events as a stream of files."""
    table = spark.read.parquet(f"{d_}/events.parquet")
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(d_).filter("user_id IS NOT NULL")
    return rows.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"), "value")


@query(
    "r03_late_samples",
    """$S, l AS (SELECT event_id, user_id, coalesce(ts_us <= max(ts_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM s)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM l GROUP BY user_id""",
)
def _(spark, d_):
    """Rows in the order of their arrival, through the stream's operator."""
    c = F.col
    rows = _stream(spark, d_).select(c("user_id").alias("session"), c("event_id").alias("arrival"), "timestamp_us", "value")
    marked = processors.replayed(sessions.late_marked_stream(rows, 1_000_000, None), "late")
    return marked.groupBy(c("session").alias("user_id")).agg(F.count("*").alias("n"), F.count(F.when(c("late"), 1)).alias("n_late"))


@query(
    "r01_two_watermarks",
    """$S, w AS (SELECT least(max(CASE WHEN event_type = 'view' THEN ts_us END), max(CASE WHEN event_type <> 'view' THEN ts_us END)) // 1000 - 3600000 AS ms FROM s)
    SELECT day, n, mean FROM (SELECT CAST(ts_us // 86400000000 AS BIGINT) AS day, count(*) AS n, round(avg(value * 0.7310585786e0), 6) AS mean FROM s GROUP BY ALL), w WHERE (day + 1) * 86400000 <= ms""",
)
def _(spark, d_):
    """Views and all other events as two streams: a day comes out when both are an hour past its end."""
    rows = _stream(spark, d_).withColumn("value", F.col("value") * 0.7310585786)
    views, others = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")
    days = processors.replayed(processors.two_stream_windows(views, others, "timestamp_us", "value", "1 day", "1 hour").select("w.start", "n", "mean"), "two-streams")
    return rounded(days.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", "mean"))


@query(
    "r02_drained_windows",
    """$S, t AS (SELECT user_id, least(max(CASE WHEN event_type = 'view' THEN ts_us END), max(CASE WHEN event_type <> 'view' THEN ts_us END)) AS top,
      count(DISTINCT event_type = 'view') AS streams FROM s GROUP BY user_id)
    SELECT user_id AS session, CAST(ts_us // 86400000000 AS BIGINT) AS "window", count(*) AS n, round(sum(value), 6) AS total, 'drained' AS reason
    FROM s JOIN t USING (user_id) WHERE streams = 2 AND ts_us // 86400000000 < top // 86400000000 GROUP BY ALL""",
)
def _(spark, d_):
    """Days of each session that both of its streams have passed when the replay ends."""
    rows = _stream(spark, d_).select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "view", 0).otherwise(1).cast("long").alias("stream"), "timestamp_us", "value")
    return rounded(processors.replayed(sessions.closed_windows_stream(rows, 2, 86_400_000_000, idle_ms=None), "drained"))


_STATES_SQL = """$R, e AS (SELECT user_id AS session, idx, ts_us // 100000 AS t, NOT bad AS contact, event_type = 'signup' AS start FROM s),
    r AS (SELECT session, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS t, 'idle' AS state, CAST(0 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS held FROM e WHERE idx = 0
    UNION ALL SELECT session, idx, t, following, CASE WHEN following <> state THEN t ELSE since END, held FROM (
      SELECT *, CASE WHEN state = 'idle' AND start THEN 'contact_wait' WHEN state = 'contact_wait' AND held >= 0 AND t - held >= 500000 THEN 'warmup'
        WHEN state = 'contact_wait' AND t - since >= 120000000 THEN 'error' WHEN state = 'warmup' AND t - since >= 3000000 THEN 'measuring'
        WHEN state = 'measuring' AND t - since >= 60000000 THEN 'result' WHEN state IN ('result', 'error') AND t - since >= 45000000 THEN 'idle' ELSE state END AS following
      FROM (SELECT e.session, e.idx, e.t, e.start, r.state, r.since, CASE WHEN NOT e.contact THEN -1 WHEN r.held < 0 THEN e.t ELSE r.held END AS held
        FROM r JOIN e ON e.session = r.session AND e.idx = r.idx + 1)))
    SELECT session, t AS timestamp_us, state FROM r WHERE idx >= 0"""


@query("r09_session_states", _STATES_SQL)
def _(spark, d_):
    c = F.col
    events = samples(spark, d_).select(
        c("user_id").alias("session"), F.floor(c("ts_us") / 100000).alias("timestamp_us"), c("event_id").alias("sequence"), (~c("bad")).alias("contact"), (c("event_type") == "signup").alias("start")
    )
    return sessions.state_batch(events)


@query(
    "v08_smoothed_votes",
    """$S SELECT a.event_id, CAST(count(*) AS INTEGER) AS votes FROM s a JOIN s b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx - 4 AND a.idx AND a.event_type = b.event_type GROUP BY a.event_id""",
)
def _(spark, d_):
    w = series.ordered(KEYS, ORDER).rowsBetween(-4, 0)
    return samples(spark, d_).select("event_id", fn.smoothed_votes(F.col("event_type"), w).alias("votes"))
