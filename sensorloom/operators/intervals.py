"""Beat intervals: cleaning, variability statistics, feature vectors.

Each variant keeps its own rules, as they are not interchangeable.  "Bridging"
filters first, so a difference spans a removed interval; the other kind needs
both neighbours valid.  Input is one row per interval with grouping keys, an
order and a value; one shuffle by key serves the windows and the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import quantiles


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def median_rate(df: DataFrame, keys: Sequence[str], value: str, low: float = 250.0, high: float = 2000.0, at_least: int = 1) -> DataFrame:
    """60000 over the median of the intervals in range; null below ``at_least``."""
    kept = F.col(value).between(low, high)
    n, middle = {"n_valid": F.count(F.when(kept, 1))}, {"_median": (F.when(kept, F.col(value)), 0.5)}
    found = quantiles.aggregated(df, keys, n, middle, quantiles.large_groups(df, keys))
    return found.select(*keys, "n_valid", F.when(F.col("n_valid") >= at_least, 60000.0 / F.col("_median")).alias("bpm"))


def with_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, valid: Column, bridging: bool) -> DataFrame:
    """Valid rows with ``diff`` to the interval before: the last valid one if
    ``bridging``, else the neighbour, if that is valid."""
    w = _by(keys, order)
    if bridging:
        return df.filter(valid).withColumn("diff", F.col(value) - F.lag(value).over(w))
    both = df.withColumn("_valid", valid)
    before = F.lag(F.when(F.col("_valid"), F.col(value))).over(w)
    return both.withColumn("diff", F.col(value) - before).filter("_valid").drop("_valid")


def variability(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, low: float = 250.0, high: float = 2000.0, bridging: bool = True, at_least: int = 2
) -> DataFrame:
    """Count, mean, SDNN (n - 1), RMSSD and pNN50 (strictly over
    50) of the intervals in range; groups with fewer than ``at_least`` go."""
    rows = with_difference(df, keys, order, value, F.col(value).between(low, high), bridging)
    return (
        rows.groupBy(*keys)
        .agg(
            F.count("*").alias("n_intervals"),
            F.avg(value).alias("mean_ms"),
            F.stddev_samp(value).alias("sdnn_ms"),
            F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd_ms"),
            (100.0 * F.avg((F.abs("diff") > 50.0).cast("int"))).alias("pnn50_pct"),
        )
        .filter(F.col("n_intervals") >= at_least)
    )


def variability_aggregates(value: str, keys: Sequence[str], order: Sequence[str], low: float = 250.0, high: float = 2000.0) -> tuple[Column, dict[str, Column]]:
    """``variability`` beside other aggregates of the same groups: the column ``diff``
    to add to the rows, and the aggregates, null with fewer than two intervals in range."""
    x = F.when(F.col(value).between(low, high), F.col(value))
    before = F.last(x, ignorenulls=True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    enough, diff = F.count(x) >= 2, F.col("diff")
    found = {"mean": F.avg(x), "sdnn": F.stddev_samp(x), "rmssd": F.sqrt(F.avg(diff * diff)), "pnn50": 100.0 * F.avg((F.abs(diff) > 50.0).cast("int"))}
    return x - before, {k: F.when(enough, v) for k, v in found.items()}


def median_cleaned(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, tolerance: float, large: DataFrame | None = None) -> DataFrame:
    """All rows with ``clean``: in range and within ``tolerance`` of
    the median of the group's intervals in range; ``large``: see ``quantiles``."""
    in_range = F.col(value).between(low, high)
    rows = quantiles.with_percentile(df, keys, F.when(in_range, F.col(value)), 0.5, "_median", large)
    return rows.withColumn("clean", in_range & F.col(value).between(F.col("_median") * (1 - tolerance), F.col("_median") * (1 + tolerance))).drop("_median")


def stress_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, min_beats: int = 40, min_ratio: float = 0.65, low: float = 333.33, high: float = 1500.0
) -> DataFrame:
    """The 14 features of each group's intervals (ms), and a status:
    quality_rejected with fewer beats, clean intervals or a smaller share of
    clean ones than needed; then the features are null."""
    large = quantiles.large_groups(df, keys)
    cleaned = median_cleaned(df, keys, value, low, high, 0.30, large)
    w = _by([*keys, "clean"], order)
    rows = cleaned.withColumn("clean", F.coalesce("clean", F.lit(False))).withColumn("diff", F.when(F.col("clean"), F.col(value) - F.lag(value).over(w)))
    x = F.when(F.col("clean"), F.col(value))
    rate, diff = 60000.0 / x, F.col("diff")
    n_raw, n_clean, n_diff = F.count("*"), F.count(x), F.count("diff")
    counts = {"beat_count": n_raw + 1, "n_clean": n_clean, "n_diff": n_diff, "valid_rr_ratio": n_clean / n_raw}
    rates = {"mean_hr_bpm": F.avg(rate), "std_hr_bpm": F.stddev_samp(rate), "min_hr_bpm": F.min(rate), "max_hr_bpm": F.max(rate), "mean_pp_ms": F.avg(x)}
    spreads = {
        "sdnn_ms": F.stddev_samp(x),
        "rmssd_ms": F.sqrt(F.avg(diff * diff)),
        "sdsd_ms": F.stddev_samp(diff),
        "pnn20_pct": 100.0 * F.avg((F.abs(diff) > 20.0).cast("int")),
        "pnn50_pct": 100.0 * F.avg((F.abs(diff) > 50.0).cast("int")),
        "cvnn": F.stddev_samp(x) / F.avg(x),
    }
    grouped = quantiles.aggregated(rows, keys, counts | rates | spreads, {"median_pp_ms": (x, 0.5)}, large)
    grouped = grouped.select(*keys, *counts, *rates, "median_pp_ms", *spreads)
    ready = (F.col("beat_count") >= min_beats) & (F.col("n_clean") >= 3) & (F.col("n_diff") >= 2) & (F.col("valid_rr_ratio") >= min_ratio)
    names = [c for c in grouped.columns if c not in (*keys, "beat_count", "n_clean", "n_diff", "valid_rr_ratio")]
    return grouped.select(
        *keys,
        F.when(ready, "ready").otherwise("quality_rejected").alias("status"),
        "beat_count",
        "valid_rr_ratio",
        *[F.when(ready, F.col(c)).alias(c) for c in names],
    )


def af_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, low: float = 200.0, high: float = 2000.0, at_least: int = 3) -> DataFrame:
    """The nine rhythm features in seconds and percent; groups with fewer than ``at_least`` go."""
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v) & v.between(low, high)
    seconds = df.withColumn("rr_s", v / 1000.0)
    rows = with_difference(seconds, keys, order, "rr_s", valid, bridging=True)
    x, diff = F.col("rr_s"), F.col("diff")
    columns = {
        "interval_count": F.count("*"),
        "mean_rr": F.avg(x),
        "sdnn": F.stddev_samp(x),
        "rmssd": F.sqrt(F.avg(diff * diff)),
        "pnn50": 100.0 * F.avg((F.abs(diff) > 0.050).cast("int")),
        "cv_rr": F.stddev_samp(x) / F.avg(x),
        "min_rr": F.min(x),
        "max_rr": F.max(x),
    }
    shares = {"median_rr": (x, 0.5), "_low": (x, 0.25), "_high": (x, 0.75)}
    found = quantiles.aggregated(rows, keys, columns, shares, quantiles.large_groups(df, keys)).withColumn("iqr_rr", F.col("_high") - F.col("_low"))
    names = "interval_count mean_rr median_rr sdnn rmssd pnn50 cv_rr iqr_rr min_rr max_rr".split()
    return found.filter(F.col("interval_count") >= at_least).select(*keys, *names)


def interval_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Of intervals in seconds, those in 0.30..2.0: count, median rate,
    SDNN (0 for one) and RMSSD (null for two or fewer)."""
    total = df.groupBy(*keys).agg(F.count("*").alias("n_raw"))
    rows = with_difference(df, keys, order, value, F.col(value).between(0.30, 2.0), bridging=True)
    columns = {
        "n_valid": F.count("*"),
        "sdnn_s": F.coalesce(F.stddev_samp(value), F.lit(0.0)),
        "rmssd_s": F.when(F.count("*") > 2, F.sqrt(F.avg(F.col("diff") * F.col("diff")))),
    }
    found = quantiles.aggregated(rows, keys, columns, {"_median": (F.col(value), 0.5)}, quantiles.large_groups(df, keys))
    found = found.select(*keys, "n_valid", (60.0 / F.col("_median")).alias("median_bpm"), "sdnn_s", "rmssd_s")
    return total.join(found, list(keys), "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
