"""Queries over boxes, tracks, calibrated scores, outliers and changes of rate."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import detections, dsp, fitting, resampling, spectral, tracking
from sensorloom.plans import blocks
from sensorloom.plans.catalog import KEYS, ORDER, rounded, samples
from sensorloom.plans.register import query

c = F.col


# ------------------------------------------------------------- boxes and tracks
def _boxes(spark, d_, *more) -> DataFrame:
    return samples(spark, d_).select(
        *more, "user_id", "event_id", (1 / (1 + c("value") * 0.0131)).alias("score"),
        c("value").alias("x1"), (c("event_id") % 7 * 10.0).alias("y1"), (c("value") + 30).alias("x2"), (c("event_id") % 7 * 10.0 + 25).alias("y2"),
    )


_SHARED = "greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1))"


@query(
    "v09_kept_boxes",
    f"""$R, b AS (SELECT user_id, event_id, 1 / (1 + value * 0.0131e0) AS score, value AS x1, event_id % 7 * 10.0e0 AS y1, value + 30 AS x2, event_id % 7 * 10.0e0 + 25 AS y2 FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM b WHERE score > 0.3),
    k AS (SELECT user_id, rn, event_id, score, true AS kept, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS boxes FROM r WHERE rn = 1
      UNION ALL SELECT user_id, rn, event_id, score, ok, CASE WHEN ok THEN list_append(boxes, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE boxes END
      FROM (SELECT r.*, k.boxes, len(list_filter(k.boxes, lambda b: {_SHARED} / (1500 - {_SHARED}) >= 0.3)) = 0 AS ok FROM k JOIN r ON r.user_id = k.user_id AND r.rn = k.rn + 1))
    SELECT user_id, event_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rn) AS INTEGER) AS rank FROM k WHERE kept""",
)
def _(spark, d_):
    return rounded(detections.kept_boxes(_boxes(spark, d_), KEYS, "event_id", "score", 0.3, 0.3, 1 << 20))


_LINES = [(100.0, 0.0, 100.0, 100.0), (0.0, 35.5, 400.0, 35.5)]


def _crossed_sql(i: int, line: tuple) -> str:
    a, b, p, q = f"{line[0]}, {line[1]}".split(", "), f"{line[2]}, {line[3]}".split(", "), ("u", "v"), ("x", "y")
    left = lambda a, b, p: f"(({p[1]} - {a[1]}) * ({b[0]} - {a[0]}) > ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"
    return f"count(*) FILTER (WHERE {left(a, p, q)} <> {left(b, p, q)} AND {left(a, b, p)} <> {left(a, b, q)}) AS crossings{i}"


@query(
    "v13_crossings",
    f"""$S, p AS (SELECT user_id, value AS x, raw % 70 AS y, lag(value) OVER o AS u, lag(raw % 70) OVER o AS v FROM s WINDOW o AS (PARTITION BY user_id ORDER BY idx))
    SELECT user_id, {", ".join(_crossed_sql(i, line) for i, line in enumerate(_LINES))} FROM p GROUP BY user_id""",
)
def _(spark, d_):
    return detections.crossings(samples(spark, d_).withColumn("y", c("raw") % 70), KEYS, ORDER, "value", "y", _LINES)


@query(
    "v16_aligned_tracks",
    """$V, t AS (SELECT user_id, w, i % 16 AS track, x + i % 16 * 0.37e0 AS x, i % 5 * 10.0e0 AS y FROM x WHERE i % 16 < 8), f AS (SELECT user_id, w, i % 16 - 8 AS found, x + i % 16 * 0.37e0 AS x, i % 5 * 10.0e0 AS y FROM x WHERE i % 16 >= 8),
    e AS (SELECT user_id, w, track, found, (t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y) AS cost FROM t JOIN f USING (user_id, w)),
    m(user_id, w, k, mask, pairs, cost) AS (SELECT DISTINCT user_id, w, 0, 0, CAST([] AS BIGINT[]), CAST(0 AS DOUBLE) FROM t
      UNION ALL SELECT user_id, w, k + 1, mask, arg_min(pairs, cost), min(cost) FROM (
        SELECT m.user_id, m.w, m.k, m.mask + (1 << e.found) AS mask, list_append(m.pairs, e.found) AS pairs, m.cost + e.cost AS cost FROM m JOIN e ON e.user_id = m.user_id AND e.w = m.w AND e.track = m.k AND m.mask & (1 << e.found) = 0)
      GROUP BY user_id, w, k, mask)
    SELECT user_id, w, track, found, round(e.cost, 6) AS cost FROM m JOIN e USING (user_id, w) WHERE k = 8 AND m.pairs[track + 1] = found""",
)
def _(spark, d_):
    """The first eight rows of a window are its tracks, the others the boxes found; the pairs of least squared distance."""
    at = c("i") % 16
    x, y = c("x") + at * 0.37, c("i") % 5 * 10.0
    box = blocks.windows(spark, d_).select("user_id", "w", at.alias("at"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 25).alias("y2"))
    tracks, found = box.filter("at < 8").withColumn("id", c("at")), box.filter("at >= 8").withColumn("id", c("at") - 8)
    return rounded(detections.aligned(tracks, found, ["user_id", "w"], detections.squared_distance))


@query("v15_tracks")
def _(spark, d_):
    """Tracks over time: a day is a frame, and a user's events of that day are its boxes."""
    box = _boxes(spark, d_, F.floor(c("ts_us") / 86_400_000_000).alias("frame")).drop("score").withColumnRenamed("event_id", "id")
    return rounded(tracking.tracked(box, KEYS, tracking.Settings(seen=8.0, push=4.0)))


@query(
    "v17_kalman",
    """$R, k AS (SELECT user_id, idx, event_id, 50.0e0 AS x, 10.0e0 AS p FROM s WHERE idx = 0
      UNION ALL SELECT user_id, idx, event_id, x, p FROM (SELECT user_id, idx, event_id, m + g * (value - (m + m * m / 1000)) AS x, q - g * h * q AS p
        FROM (SELECT *, q * h / (h * q * h + 25) AS g FROM (SELECT *, 1 + m / 500 AS h FROM (SELECT s.user_id, s.idx, s.event_id, s.value, k.x * 0.95e0 + 2 AS m, k.p * 0.9025e0 + 4 AS q FROM k JOIN s ON s.user_id = k.user_id AND s.idx = k.idx + 1)))))
    SELECT event_id, round(x, 6) AS y FROM k WHERE idx > 0""",
)
def _(spark, d_):
    """A level that falls back to 40, seen through a slight curve; the first sample only begins the session."""
    one = np.eye(1)

    def run(x: np.ndarray) -> np.ndarray:
        s = detections.kalman(
            x[1:, None], lambda v: 0.95 * v + 2, lambda v: 0.95 * one, lambda v: v + v * v / 1000, lambda v: (1 + v / 500)[None], 4 * one, 25 * one, np.array([50.0]), 10 * one
        )
        return np.concatenate([[np.nan], s[:, 0]]) if len(s) else np.array([np.nan])

    return rounded(dsp.filtered(samples(spark, d_), KEYS, ORDER, "value", run, "event_id").filter("y IS NOT NULL"))


# ------------------------------------------------------------ scores and outliers
@query(
    "v12_calibrated_events",
    """$R, l AS (SELECT user_id, event_id, ts_us, idx + 1 AS pos, avg(least(1.0e0, value * 0.0062310585786e0)) OVER w AS high, avg(1 / (1 + value * 0.0131e0)) OVER w AS low FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS 3 PRECEDING)),
    c AS (SELECT *, greatest(high, low) AS score FROM l WHERE greatest(high, low) >= 0.55),
    e AS (SELECT user_id, min(pos) AS pos FROM c GROUP BY user_id UNION ALL SELECT user_id, pos FROM (SELECT e.user_id, min(c.pos) AS pos FROM e JOIN c ON c.user_id = e.user_id AND c.pos > e.pos + 5 GROUP BY e.user_id))
    SELECT user_id, ts_us, event_id, CAST(pos AS INTEGER) AS pos, CASE WHEN high = score THEN 'high' ELSE 'low' END AS label, round(score, 6) AS score FROM c JOIN e USING (user_id, pos)""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumns({"high": F.least(F.lit(1.0), c("value") * 0.0062310585786), "low": 1 / (1 + c("value") * 0.0131)})
    return rounded(detections.calibrated_events(rows, KEYS, ORDER, ["high", "low"], 4, 0.55, 5))


_SCALED_SQL = "$S, m AS (SELECT avg(value) AS a, stddev_pop(value) AS sa FROM s), z AS (SELECT event_id, event_type, (value - a) / sa AS x, (event_id % 97) / 28.0e0 AS y FROM s, m)"


def _scaled(spark, d_) -> DataFrame:
    rows = samples(spark, d_)
    fitted = rows.agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("sa")).first()  # two numbers
    return rows.select("event_id", "event_type", ((c("value") - fitted["a"]) / fitted["sa"]).alias("x"), (c("event_id") % 97 / 28.0).alias("y"))


@query(
    "v10_cluster_anomaly",
    _SCALED_SQL
    + """, k AS (SELECT event_type, avg(x) AS cx, avg(y) AS cy FROM z WHERE event_type IS NOT NULL GROUP BY event_type),
    e AS (SELECT cx, cy, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS r FROM z JOIN k USING (event_type) GROUP BY event_type, cx, cy)
    SELECT event_id, round(least(1000, min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r)), 6) + 0.0 AS anomaly FROM z, e GROUP BY event_id""",
)
def _(spark, d_):
    """Clusters are fitted on the kinds of event, of which there are five."""
    rows = _scaled(spark, d_)
    clusters = detections.fit_clusters(rows, ["x", "y"], "event_type")
    return rounded(rows.select("event_id", detections.cluster_anomaly([c("x"), c("y")], clusters).alias("anomaly")))


@query(
    "v11_mixture_anomaly",
    _SCALED_SQL
    + """, k AS (SELECT count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS v FROM z WHERE event_type IS NOT NULL GROUP BY event_type),
    q AS (SELECT *, n / sum(n) OVER () AS share, vx * vy - v * v AS det FROM k),
    t AS (SELECT event_id, share / (2 * pi() * sqrt(det)) * exp(-0.5 * (vy * (x - cx) * (x - cx) - 2 * v * (x - cx) * (y - cy) + vx * (y - cy) * (y - cy)) / det) AS d FROM z, q)
    SELECT event_id, round(-ln(sum(d)), 6) AS anomaly FROM t GROUP BY event_id""",
)
def _(spark, d_):
    rows = _scaled(spark, d_)
    parts = detections.fit_mixture(rows, ["x", "y"], "event_type")
    return rounded(rows.select("event_id", detections.mixture_anomaly([c("x"), c("y")], parts).alias("anomaly")))


@query("v10_fitted_clusters")
def _(spark, d_):
    """The same score from eight clusters that are fitted to the values."""
    rows = _scaled(spark, d_)
    found = fitting.clusters(fitting.matrix_rows(rows, [c("x"), c("y")]), 8, rounds=10)
    return rounded(rows.select("event_id", detections.cluster_anomaly([c("x"), c("y")], found).alias("anomaly")))


@query("v11_fitted_mixture")
def _(spark, d_):
    """The same score from a mixture of four components that is fitted to the values."""
    rows = _scaled(spark, d_)
    found = fitting.mixture(fitting.matrix_rows(rows, [c("x"), c("y")]), 4, rounds=15)
    return rounded(rows.select("event_id", detections.mixture_anomaly([c("x"), c("y")], found.parts).alias("anomaly")))


# ------------------------------------------------------- spectra, filters, wavelets
@query(
    "v24_spectral_peaks",
    blocks.POWER_SQL
    + """, n AS (SELECT *, lag(power) OVER o AS a, lead(power) OVER o AS b FROM p WINDOW o AS (PARTITION BY user_id, w ORDER BY bin)),
    k AS (SELECT user_id, w, bin, power, row_number() OVER (PARTITION BY user_id, w ORDER BY power DESC, bin) AS place FROM n WHERE power > a AND power > b AND power >= 300),
    g AS (SELECT DISTINCT user_id, w, CAST(q AS INTEGER) AS place FROM p, range(1, 4) r(q))
    SELECT user_id, w, place, round(coalesce(bin / 7.0e0, 0), 6) AS frequency, round(coalesce(power, 0), 6) AS power FROM g LEFT JOIN k USING (user_id, w, place)""",
)
def _(spark, d_):
    bins = spectral.periodogram(blocks.windows(spark, d_), KEYS, "x", blocks.SIZE, 2.0)
    return rounded(spectral.top_peaks(bins, KEYS, 3, 300.0, 2.0, blocks.SIZE))


_TAPS = resampling.sinc_taps(100.0, 9, low_pass=12.0)


def _fir_sql(taps: np.ndarray, value: str) -> str:
    return " + ".join(f"{t!r} * coalesce(lag({value}, {k}) OVER w, 0)" for k, t in enumerate(taps.tolist()))


@query("v30_finite_filter", f"$S SELECT event_id, round({_fir_sql(_TAPS, 'value')}, 6) + 0.0 AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx)")
def _(spark, d_):
    return rounded(resampling.fir(samples(spark, d_), KEYS, ORDER, "value", _TAPS).select("event_id", "y"))


_HIGH = resampling.sinc_taps(100.0, 9, high_pass=8.0)


@query(
    "v30_fixed_point_filter",
    f"""$S, f AS (SELECT event_id, {_fir_sql(resampling.fixed_point(_HIGH), "raw")} + 16384 AS t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx))
    SELECT event_id, CAST(greatest(-32768, least(32767, CAST(t AS BIGINT) >> 15)) AS INTEGER) AS y FROM f""",
)
def _(spark, d_):
    return resampling.fir_fixed(samples(spark, d_), KEYS, ORDER, "raw", _HIGH).select("event_id", "y")


_UP, _DOWN = 3, 2
_RESAMPLE = resampling.sinc_taps(3.0, 13, low_pass=0.5)


@query(
    "v29_resampled",
    f"""$S, h AS (SELECT unnest({_RESAMPLE.tolist()}) * {_UP} AS tap, unnest(range({len(_RESAMPLE)})) AS j), n AS (SELECT user_id, CAST(ceil(count(*) * {_UP} / {_DOWN}) AS BIGINT) AS n FROM s GROUP BY user_id),
    p AS (SELECT user_id, idx * {_UP} - {len(_RESAMPLE) // 2} + j AS k, value * tap AS x FROM s, h)
    SELECT user_id, k // {_DOWN} AS m, round(sum(x), 6) + 0.0 AS y FROM p JOIN n USING (user_id) WHERE k >= 0 AND k % {_DOWN} = 0 AND k // {_DOWN} < n GROUP BY ALL""",
)
def _(spark, d_):
    return rounded(resampling.resampled(samples(spark, d_), KEYS, ORDER, "value", _UP, _DOWN, _RESAMPLE.tolist()))


def _wavelet_levels() -> str:
    """Two levels of the Daubechies wavelet with two moments over z (user_id, w, i, x): each sums four neighbours in the mirrored row."""
    low = resampling.daubechies(2).tolist()
    high = [x * (1 if k % 2 else -1) for k, x in enumerate(low[::-1])]
    taps = ", ".join(f"({j}, {low[::-1][j]!r}, {high[::-1][j]!r})" for j in range(4))

    def level(source: str, name: str) -> str:
        return f"""{name}n AS (SELECT user_id, w, max(i) + 1 AS n FROM {source} GROUP BY user_id, w),
        {name} AS (SELECT k.user_id, k.w, k.o AS i, sum(x.x * a) AS lo, sum(x.x * b) AS hi FROM (SELECT user_id, w, n, o, ((2 * o + j - 2) % (2 * n) + 2 * n) % (2 * n) AS place, a, b FROM {name}n, LATERAL (SELECT unnest(range(0, (n + 3) // 2)) AS o), (VALUES {taps}) h(j, a, b)) k
          JOIN {source} x ON x.user_id = k.user_id AND x.w = k.w AND x.i = CASE WHEN place < n THEN place ELSE 2 * n - 1 - place END GROUP BY ALL)"""

    return f"""{level("z", "one")}, z2 AS (SELECT user_id, w, i, lo AS x FROM one), {level("z2", "two")}"""


def _wavelet_sql() -> str:
    return f"""$W, z AS (SELECT user_id, w, i - min(i) OVER (PARTITION BY user_id, w) AS i, x FROM x), {_wavelet_levels()},
    d AS (SELECT user_id, w, component, i, round(x, 10) + 0.0 AS x FROM (SELECT user_id, w, 0 AS component, i, lo AS x FROM two UNION ALL SELECT user_id, w, 1, i, hi FROM two UNION ALL SELECT user_id, w, 2, i, hi FROM one)),
    m AS (SELECT user_id, w, component, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS low, max(x) AS high, sqrt(avg(x * x)) AS rms, quantile_cont(x, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM d GROUP BY ALL),
    l AS (SELECT *, lag(x) OVER (PARTITION BY user_id, w, component ORDER BY i) AS b FROM d JOIN m USING (user_id, w, component)),
    k AS (SELECT user_id, w, component, avg(power((x - m) / sd, 3)) AS skew, avg(power((x - m) / sd, 4)) - 3 AS kurtosis, count(*) FILTER (WHERE x * b < 0) / count(*) AS z, count(*) FILTER (WHERE (x - m) * (b - m) < 0) / count(*) AS mc FROM l GROUP BY ALL),
    e AS (SELECT user_id, w, component, any_value(ln(n)) - sum(inside * ln(inside)) / any_value(n) AS entropy FROM (SELECT user_id, w, component, any_value(n) AS n, count(*) AS inside
      FROM l GROUP BY user_id, w, component, CASE WHEN high > low THEN least(floor((x - low) / ((high - low) / 100)), 99) ELSE 0 END) GROUP BY ALL)
    SELECT user_id, w, component, round(entropy, 6) + 0.0 AS entropy, round(m, 6) + 0.0 AS mean, round(sd, 6) AS std, round(sd * sd, 6) AS variance, round(rms, 6) AS rms, round(skew, 6) + 0.0 AS skew, round(kurtosis, 6) + 0.0 AS kurtosis, round(z, 6) AS zero_crossings,
      round(mc, 6) AS mean_crossings, round(q[1], 6) + 0.0 AS p05, round(q[2], 6) + 0.0 AS p25, round(q[3], 6) + 0.0 AS p50, round(q[4], 6) + 0.0 AS p75, round(q[5], 6) + 0.0 AS p95 FROM m JOIN k USING (user_id, w, component) JOIN e USING (user_id, w, component)"""


@query("v31_wavelet_features", _wavelet_sql())
def _(spark, d_):
    """Two levels, two moments; components to ten digits, so that their histogram doesn't hang on the order of a sum."""
    parts = rounded(resampling.wavelet_components(blocks.windows(spark, d_), KEYS, "x", 2, 2), 10)
    return rounded(spectral.component_features(parts, [*KEYS, "w", "component"]))


@query(
    "v31_session_wavelet",
    f"""$S, z AS (SELECT user_id, 0 AS w, idx AS i, value * 0.7310585786e0 AS x FROM s), {_wavelet_levels()}
    SELECT user_id, component, i, round(x, 6) + 0.0 AS x FROM (SELECT user_id, 0 AS component, i, lo AS x FROM two UNION ALL SELECT user_id, 1, i, hi FROM two UNION ALL SELECT user_id, 2, i, hi FROM one)""",
)
def _(spark, d_):
    """The transform of whole sessions, in blocks with their neighbours' rows."""
    rows = samples(spark, d_).withColumn("x", c("value") * 0.7310585786)
    return rounded(resampling.session_wavelet(rows, KEYS, ORDER, "x", 2, resampling.daubechies(2)))


_FACTOR, _LOW = 3, resampling.sinc_taps(1.0, 61, low_pass=0.4 / 3)


@query(
    "v29_decimated",
    f"""$S, h AS (SELECT unnest({_LOW.tolist()}) AS tap, unnest(range({len(_LOW)})) AS j), n AS (SELECT user_id, CAST(ceil(count(*) / {_FACTOR}) AS BIGINT) AS n FROM s GROUP BY user_id),
    p AS (SELECT user_id, idx - {len(_LOW) // 2} + j AS k, value * 0.7310585786e0 * tap AS x FROM s, h)
    SELECT user_id, k // {_FACTOR} AS m, round(sum(x), 6) + 0.0 AS y FROM p JOIN n USING (user_id) WHERE k >= 0 AND k % {_FACTOR} = 0 AND k // {_FACTOR} < n GROUP BY ALL""",
)
def _(spark, d_):
    rows = samples(spark, d_).withColumn("x", c("value") * 0.7310585786)
    return rounded(resampling.decimated(rows, KEYS, ORDER, "x", _FACTOR))
