"""More queries: window quality, captures, lookups, sets, sorts, debouncing, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions import signals as fn
from sensorloom.operators import blocks, series
from sensorloom.plans.catalog import KEYS, ORDER, indexed, rounded, samples
from sensorloom.plans.register import query
from sensorloom.sources import logs, sinks


c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------- windows and their quality
_COUNT_WINDOWS = """$S, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s),
    w AS (SELECT n.*, k FROM n, unnest(range(0, n // 5 + 1)) r(k) WHERE k * 5 + 10 <= n AND idx >= k * 5 AND idx < k * 5 + 10)"""


def _count_windows(spark, sf_dir) -> DataFrame:
    rows = series.count_windows(samples(spark, sf_dir), KEYS, ORDER, 10, 5)
    return rows.withColumn("same", c("raw") == F.lag("raw").over(Window.partitionBy(*KEYS, "k").orderBy("idx")))


@query(
    "a12_ecg_windows",
    _COUNT_WINDOWS
    + """, f AS (SELECT *, raw = lag(raw) OVER (PARTITION BY user_id, k ORDER BY idx) AS same FROM w),
    g AS (SELECT user_id, k, avg(CASE WHEN bad THEN 0 ELSE 1 END) AS clean, avg(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS invalid, avg(CASE WHEN raw <= 10 OR raw >= 3000 THEN 1 ELSE 0 END) AS rail,
      avg(CASE WHEN same IS NULL THEN NULL WHEN same THEN 1 ELSE 0 END) AS flat, min(idx) AS start_sample FROM f GROUP BY ALL)
    SELECT user_id, k, start_sample, round(clean, 6) AS clean_fraction, round(invalid, 6) AS adc_invalid_fraction, round(rail, 6) AS rail_fraction, round(flat, 6) AS flat_ratio,
      clean >= 0.8 AND invalid <= 0.3 AND rail <= 0.005 AS reference_good, clean >= 0.8 AND invalid <= 0.3 AND rail <= 0.005 AND flat <= 0.05 AS ecg_good FROM g""",
)
def _(spark, d_):
    g = _count_windows(spark, d_).groupBy("user_id", "k").agg(
        F.min("idx").cast("long").alias("start_sample"), F.avg((~c("bad")).cast("int")).alias("clean_fraction"), F.avg((c("event_type") == "signup").cast("int")).alias("adc_invalid_fraction"),
        F.avg(fn.rail(c("raw"), 10, 3000).cast("int")).alias("rail_fraction"), F.avg(c("same").cast("int")).alias("flat_ratio"),
    )
    good = (c("clean_fraction") >= 0.8) & (c("adc_invalid_fraction") <= 0.3) & (c("rail_fraction") <= 0.005)
    return rounded(g.withColumn("reference_good", good).withColumn("ecg_good", good & (c("flat_ratio") <= 0.05)))


@query(
    "a13_ppg_windows",
    _COUNT_WINDOWS
    + """ SELECT user_id, k, round(stddev_pop(red) / (avg(red) + 1e-9), 6) AS slot0_perfusion, round(stddev_pop(ir) / (avg(ir) + 1e-9), 6) AS slot1_perfusion,
      CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS peaks FROM w GROUP BY ALL""",
)
def _(spark, d_):
    perfusion = lambda x: F.stddev_pop(x) / (F.avg(x) + 1e-9)
    return rounded(
        _count_windows(spark, d_).groupBy("user_id", "k").agg(
            perfusion("red").alias("slot0_perfusion"), perfusion("ir").alias("slot1_perfusion"), F.count(F.when(c("event_type") == "purchase", 1)).alias("peaks")
        )
    )


@query("a16_corrected_moments", "$S SELECT user_id, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS excess_kurtosis FROM s GROUP BY user_id HAVING count(*) > 3")
def _(spark, d_):
    n = c("n")
    g = samples(spark, d_).groupBy("user_id").agg(F.count("*").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).filter("n > 3")
    skew = c("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    excess = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c("g2") + 6)
    return rounded(g.select("user_id", skew.alias("skew"), excess.alias("excess_kurtosis")))


@query("a23_window_decode", "$S SELECT event_id, (raw & 255) AS quality, (raw >> 8) AS peaks FROM s WHERE event_type IN ('view', 'click', 'error')")
def _(spark, d_):
    rows = samples(spark, d_).filter(c("event_type").isin("view", "click", "error"))
    return rows.select("event_id", c("raw").bitwiseAND(255).alias("quality"), F.shiftright("raw", 8).alias("peaks"))


@query(
    "a30_capture_report",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS dt FROM s)
    SELECT user_id, min(dt) AS dt_min, quantile_cont(dt, 0.5) AS dt_median, max(dt) AS dt_max, min(red) AS red_min, max(red) AS red_max, round(stddev_pop(red), 4) AS red_std, min(ir) AS ir_min, max(ir) AS ir_max,
      round(stddev_pop(ir), 4) AS ir_std FROM t GROUP BY user_id""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("dt", c("ts_us") - F.lag("ts_us").over(series.ordered(KEYS, ORDER)))
    g = rows.groupBy("user_id").agg(
        F.min("dt").alias("dt_min"), F.percentile("dt", F.lit(0.5)).alias("dt_median"), F.max("dt").alias("dt_max"),
        *[f(x).alias(f"{x}_{n}") for x in ("red", "ir") for n, f in (("min", F.min), ("max", F.max), ("std", F.stddev_pop))],
    )
    return rounded(g, 4)


@query(
    "a31_capture_summary",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM s)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE dt < 0) AS n_reversals, min(raw) AS raw_min, max(raw) AS raw_max FROM t GROUP BY user_id""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("dt", c("ts_us") - F.lag("ts_us").over(series.ordered(KEYS, ["event_id"])))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(c("dt") < 0, 1)).alias("n_reversals"), F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"))


def _judged(spark, d_) -> DataFrame:
    """Every line with its actual and predicted class."""
    actual, predicted = c("l_linestatus") == "F", c("l_discount") * 5 + c("l_tax") * 6.25 >= 0.5
    return table(spark, d_, "lineitem").select("l_orderkey", "l_linenumber", actual.alias("actual"), predicted.alias("predicted"))


@query(
    "a32_wrong_predictions",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'false_negative' ELSE 'false_positive' END AS kind FROM lineitem
    WHERE (l_linestatus = 'F') <> (l_discount * 5 + l_tax * 6.25 >= 0.5)""",
)
def _(spark, d_):
    wrong = _judged(spark, d_).filter("actual != predicted")
    return wrong.select("l_orderkey", "l_linenumber", F.when(c("actual"), "false_negative").otherwise("false_positive").alias("kind"))


@query(
    "a32_prediction_counts",
    """WITH j AS (SELECT l_linestatus = 'F' AS actual, l_discount * 5 + l_tax * 6.25 >= 0.5 AS predicted FROM lineitem)
    SELECT count(*) FILTER (WHERE actual IS NOT NULL AND predicted IS NOT NULL) AS total, count(*) FILTER (WHERE actual = predicted) AS correct,
      count(*) FILTER (WHERE NOT actual AND predicted) AS false_positive, count(*) FILTER (WHERE actual AND NOT predicted) AS false_negative FROM j""",
)
def _(spark, d_):
    n = lambda condition: F.count(F.when(F.expr(condition), 1))
    return _judged(spark, d_).agg(
        n("actual IS NOT NULL AND predicted IS NOT NULL").alias("total"), n("actual = predicted").alias("correct"),
        n("NOT actual AND predicted").alias("false_positive"), n("actual AND NOT predicted").alias("false_negative"),
    )


@query(
    "m02_candidate_windows",
    """$S, f AS (SELECT *, min(ts_us) OVER (PARTITION BY user_id) AS t0 FROM s), w AS (SELECT user_id, (ts_us - t0) // 86400000000 AS k, count(*) AS n, count(*) FILTER (WHERE bad) AS nb FROM f GROUP BY ALL)
    SELECT user_id, k, CASE WHEN n < 2 OR nb > 0 THEN 'REJECT' ELSE 'PASS' END AS qc_status, CASE WHEN n < 2 THEN 'too_few_samples' WHEN nb > 0 THEN 'bad_samples' ELSE '' END AS reason FROM w""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("t0", F.min("ts_us").over(Window.partitionBy("user_id")))
    w = series.session_windows(rows, KEYS, "ts_us", c("t0"), 86_400_000_000, 86_400_000_000).groupBy("user_id", "k").agg(F.count("*").alias("n"), F.count(F.when(c("bad"), 1)).alias("nb"))
    reason = F.when(c("n") < 2, "too_few_samples").when(c("nb") > 0, "bad_samples").otherwise("")
    return w.select("user_id", "k", F.when(reason == "", "PASS").otherwise("REJECT").alias("qc_status"), reason.alias("reason"))


# ------------------------------------------------------------------ flags and text
@query("p07_half_open_window", "$S SELECT event_id FROM s WHERE ts_us >= 1704844800000000 AND ts_us < 1705449600000000")
def _(spark, d_):
    return samples(spark, d_).filter((c("ts_us") >= 1_704_844_800_000_000) & (c("ts_us") < 1_705_449_600_000_000)).select("event_id")


@query("p09_flag_fraction", "$S SELECT user_id, round(avg(CASE WHEN event_type <> 'error' AND event_type <> 'signup' THEN 1 ELSE 0 END), 6) AS clean FROM s GROUP BY user_id")
def _(spark, d_):
    return rounded(samples(spark, d_).groupBy("user_id").agg(F.avg((~c("event_type").isin("error", "signup")).cast("int")).alias("clean")))


@query("p14_status_text", "$S SELECT event_type, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Waiting' ELSE 'Valid' END AS text, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d_):
    text = F.when(c("event_type") == "error", "Error").when(c("event_type") == "view", "Waiting").otherwise("Valid")
    return samples(spark, d_).groupBy("event_type", text.alias("text")).agg(F.count("*").alias("n"))


@query(
    "p15_debounce",
    """$S, c AS (SELECT *, CASE WHEN bad <> lag(bad) OVER (PARTITION BY user_id ORDER BY idx) THEN 1 ELSE 0 END AS ch FROM s),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM c),
    u AS (SELECT user_id, run, bad, min(ts_us) AS start_us, max(ts_us) - min(ts_us) AS held_us FROM r GROUP BY ALL)
    SELECT user_id, start_us, held_us FROM u WHERE bad AND held_us >= 3600000000""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("level", c("bad").cast("string"))
    w = series.ordered(KEYS, ORDER)
    changed = F.coalesce((c("bad") != F.lag("bad").over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("ch", changed).withColumn("run", F.sum("ch").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.groupBy("user_id", "run", "bad").agg(F.min("ts_us").alias("start_us"), (F.max("ts_us") - F.min("ts_us")).alias("held_us"))
    return held.filter("bad AND held_us >= 3600000000").select("user_id", "start_us", "held_us")


@query("k07_text_lines", "$S SELECT event_id, 'id=' || event_id || ' raw=' || raw || ' type=' || upper(event_type) AS line FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", F.format_string("id=%d raw=%d type=%s", "event_id", "raw", F.upper("event_type")).alias("line"))


# ----------------------------------------------------------- joins, sets and sorts
@query("s13_preferred_file", "SELECT key, path FROM (SELECT c_nationkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'a/' || c_nationkey || '/' || c_name ELSE 'a/b/' || c_name END AS path, "
    "row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN c_custkey % 3 = 0 THEN 'a/' || c_nationkey || '/' || c_name ELSE 'a/b/' || c_name END) AS rn FROM customer) WHERE rn = 1")  # fmt: skip
def _(spark, d_):
    key = c("c_nationkey").cast("string")
    path = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("a/"), key, F.lit("/"), c("c_name"))).otherwise(F.concat(F.lit("a/b/"), c("c_name")))
    files = table(spark, d_, "customer").select(key.alias("key"), path.alias("path"))
    return logs.preferred_file(files, "key").select(c("key").cast("int").alias("key"), "path")


@query("s14_split_map", "SELECT DISTINCT upper(c_name) AS subject, lower(c_mktsegment) AS split FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def _(spark, d_):
    rows = table(spark, d_, "customer").select(F.upper(F.trim("c_name")).alias("subject"), F.lower(F.trim("c_mktsegment")).alias("split"))
    return rows.filter(c("split").isin("building", "machinery")).dropDuplicates()


@query(
    "j03_peaks_in_windows",
    """$S, f AS (SELECT *, min(ts_us) OVER (PARTITION BY user_id) AS t0 FROM s)
    SELECT user_id, k, count(*) AS n_peaks FROM f, range(0, 40) r(k) WHERE event_type = 'purchase' AND ts_us - t0 >= k * 86400000000 AND ts_us - t0 < k * 86400000000 + 172800000000 GROUP BY ALL""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("t0", F.min("ts_us").over(Window.partitionBy("user_id"))).filter("event_type = 'purchase'")
    return series.session_windows(rows, KEYS, "ts_us", c("t0"), 2 * 86_400_000_000, 86_400_000_000).groupBy("user_id", "k").agg(F.count("*").alias("n_peaks"))


@query("j04_positional_join", "$S SELECT a.user_id, a.idx, a.raw, b.ir FROM s a JOIN s b ON a.user_id = b.user_id AND a.idx = b.idx")
def _(spark, d_):
    rows = indexed(spark, d_)
    return rows.select("user_id", "idx", "raw").join(rows.select("user_id", "idx", "ir"), ["user_id", "idx"])


@query(
    "j07_merged_streams",
    """$S SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_a, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_b,
    max(ts_us) FILTER (WHERE event_type = 'view') AS last_a, max(ts_us) FILTER (WHERE event_type = 'click') AS last_b FROM s WHERE event_type IN ('view', 'click') GROUP BY user_id
    HAVING count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'click') > 0""",
)
def _(spark, d_):
    rows = samples(spark, d_)
    both = rows.filter("event_type = 'view'").select("user_id", "ts_us", F.lit("a").alias("m")).unionByName(rows.filter("event_type = 'click'").select("user_id", "ts_us", F.lit("b").alias("m")))
    g = both.groupBy("user_id").agg(*[f(F.when(c("m") == m, c("ts_us"))).alias(f"{n}_{m}") for m in "ab" for n, f in (("n", F.count), ("last", F.max))])
    return g.filter("n_a > 0 AND n_b > 0")


@query("j10_compared_captures", "$S SELECT round(avg(red), 4) AS a_mean, round(avg(ir), 4) AS b_mean, round(avg(ir) - avg(red), 4) AS difference FROM s")
def _(spark, d_):
    g = samples(spark, d_).agg(F.avg("red").alias("a_mean"), F.avg("ir").alias("b_mean"))
    return rounded(g.withColumn("difference", c("b_mean") - c("a_mean")), 4)


@query("u01_union_all", "SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def _(spark, d_):
    both = table(spark, d_, "customer").select(c("c_nationkey").alias("k")).unionByName(table(spark, d_, "supplier").select(c("s_nationkey").alias("k")))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@query("u04_subset", "SELECT count(*) = 0 AS is_subset FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)")
def _(spark, d_):
    rest = table(spark, d_, "customer").select("c_nationkey").distinct().subtract(table(spark, d_, "nation").select("n_nationkey"))
    return rest.agg((F.count("*") == 0).alias("is_subset"))


@query("u05_distinct", "SELECT DISTINCT event_type FROM events")
def _(spark, d_):
    return samples(spark, d_).select("event_type").dropDuplicates()


@query("t03_sorted_indices", "$S SELECT user_id, idx, raw, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, idx) - 1 AS pos FROM s")
def _(spark, d_):
    """The indices of all samples, highest first."""
    return series.positions(indexed(spark, d_), KEYS, [F.desc("raw"), F.asc("idx")]).select("user_id", "idx", "raw", "pos")


@query("t05_multi_key_sort", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS pos FROM supplier ORDER BY pos")
def _(spark, d_):
    rows = table(spark, d_, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    order = [F.asc_nulls_last("s_nationkey"), F.desc_nulls_last("s_acctbal"), F.asc_nulls_last("s_suppkey")]
    return blocks.numbered(rows, [], order, "pos").select("s_suppkey", (c("pos") + 1).alias("pos")).orderBy("pos")


@query("t08_first_seconds", "$S, f AS (SELECT *, min(ts_us) OVER (PARTITION BY user_id) AS t0 FROM s) SELECT event_id FROM f WHERE ts_us - t0 < 259200000000")
def _(spark, d_):
    rows = samples(spark, d_).withColumn("t0", F.min("ts_us").over(Window.partitionBy("user_id")))
    return rows.filter(c("ts_us") - c("t0") < 259_200_000_000).select("event_id")


# --------------------------------------------------------------------- stream rules
@query(
    "r11_broken_chain",
    """$S, t AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS step FROM s),
    g AS (SELECT *, sum(CASE WHEN step > 43200000000 OR step <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM t),
    i AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id, segment ORDER BY ts_us, event_id) AS interval_us FROM g)
    SELECT user_id, count(interval_us) AS n_intervals, CAST(sum(interval_us) AS BIGINT) AS total_us FROM i WHERE interval_us IS NOT NULL GROUP BY user_id""",
)
def _(spark, d_):
    rows = series.continuity(samples(spark, d_), KEYS, ORDER, "ts_us", 43_200_000_000)
    rows = rows.withColumn("interval_us", c("ts_us") - F.lag("ts_us").over(series.ordered([*KEYS, "segment"], ORDER))).filter("interval_us IS NOT NULL")
    return rows.groupBy("user_id").agg(F.count("interval_us").alias("n_intervals"), F.sum("interval_us").alias("total_us"))


@query("r13_dropout_context", "$S SELECT event_id, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts_us, event_id), false) AS after_loss FROM s")
def _(spark, d_):
    return samples(spark, d_).select("event_id", F.coalesce(F.lag("bad").over(series.ordered(KEYS, ORDER)), F.lit(False)).alias("after_loss"))


@query(
    "r14_config_segments",
    """$R, t AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM s),
    g AS (SELECT *, sum(CASE WHEN before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS segment FROM t),
    r AS (SELECT user_id, idx, event_id, segment, value * 0.7310585786e0 AS y FROM g WHERE idx = 0
      UNION ALL SELECT g.user_id, g.idx, g.event_id, g.segment, CASE WHEN g.segment <> r.segment THEN g.value * 0.7310585786e0 ELSE r.y + 0.18 * (g.value * 0.7310585786e0 - r.y) END FROM r JOIN g ON g.user_id = r.user_id AND g.idx = r.idx + 1)
    SELECT event_id, CAST(segment AS BIGINT) AS segment, round(y, 6) AS y FROM r""",
)
def _(spark, d_):
    """The kind of event stands for the settings: each change begins a segment, and the filter begins anew there."""
    w = series.ordered(KEYS, ORDER)
    changed = F.coalesce(F.lag("event_type").over(w) != c("event_type"), F.lit(False)).cast("long")
    rows = samples(spark, d_).withColumn("changed", changed).withColumn("segment", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("x", c("value") * 0.7310585786)
    return rounded(blocks.recurrence(rows, [*KEYS, "segment"], ORDER, "x", {"y": blocks.ema(0.18)}, ["event_id"]).select("event_id", "segment", "y"))


# ------------------------------------------------------------------------- scoring
@query("v01_standard_scaler", "$S, m AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM s) SELECT event_id, round((value - m) / sd, 6) AS z FROM s, m")
def _(spark, d_):
    rows = samples(spark, d_)
    fitted = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).first()  # two numbers
    return rounded(rows.select("event_id", ((c("value") - fitted["m"]) / fitted["sd"]).alias("z")))


MODEL_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _trained(spark, d_):
    """Scaler and logistic regression fitted on one split, and the rows of the other."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = table(spark, d_, "lineitem").select("l_orderkey", "l_linenumber", *MODEL_FEATURES, (c("l_linestatus") == "F").cast("double").alias("label"))
    train, test = rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0")
    stages = [
        VectorAssembler(inputCols=MODEL_FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(regParam=0.01, elasticNetParam=0.0, standardization=False),
    ]
    return Pipeline(stages=stages).fit(train), test


@query("m04_trained_model")
def _(spark, d_):
    from pyspark.ml.functions import vector_to_array

    model, test = _trained(spark, d_)
    return model.transform(test).select("l_orderkey", "l_linenumber", vector_to_array("probability")[1].alias("p"), c("prediction"))


@query("k13_model_parameters")
def _(spark, d_):
    _, scaler, regression = _trained(spark, d_)[0].stages
    return sinks.model_parameters(spark, MODEL_FEATURES, scaler.mean, scaler.std, regression.coefficients, regression.intercept)
