"""Statistics, spectra and crossings of bounded windows of samples.

A window is a fixed number of rows of a session, so an array of one is of known
size; one shuffle by session serves the windows, and all that follows is dealt
by the same keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sensorloom.operators import series


def row_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Each row with ``i``, its place, and ``w``, the number of its window; rows after the last whole window go."""
    rows = series.positions(df, keys, order).withColumnRenamed("pos", "i").withColumn("w", F.floor(F.col("i") / size))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "w"))).filter(F.col("_n") == size).drop("_n")


def flattened(windows: DataFrame, keys: Sequence[str], value: str, last: int) -> DataFrame:
    """Mean, least, greatest, RMS, deviation, skewness and excess kurtosis (all
    of the population; 0 in a flat window) and the mean of the last means."""
    x = F.col(value)
    g = windows.groupBy(*keys, "w").agg(
        F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.sqrt(F.avg(x * x)).alias("rms"), F.stddev_pop(x).alias("std"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"),
    )
    flat = F.col("high") == F.col("low")
    g = g.withColumns({c: F.when(flat, 0.0).otherwise(F.col(c)) for c in ("std", "skew", "kurtosis")})
    return g.withColumn("moving_mean", F.avg("mean").over(Window.partitionBy(*keys).orderBy("w").rowsBetween(1 - last, 0)))


def threshold_peaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Rows over both neighbours, by more than ``threshold`` in sum."""
    w, x = series.ordered(keys, order), F.col(value)
    sides = df.withColumn("_a", F.lag(x).over(w)).withColumn("_b", F.lead(x).over(w))
    return sides.filter((x > F.col("_a")) & (x > F.col("_b")) & (2 * x - F.col("_a") - F.col("_b") > threshold)).drop("_a", "_b")


def periodogram(windows: DataFrame, keys: Sequence[str], value: str, size: int, rate: float) -> DataFrame:
    """Keys, w, bin, frequency and power; one-sided, doubled in all bins but the last."""

    @pandas_udf("array<double>")
    def power(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, size))
            p = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)) ** 2 / (rate * size)
            p[:, : (size + 1) // 2] *= 2
            yield pd.Series(list(p))

    ordered = F.sort_array(F.collect_list(F.struct("i", F.col(value).cast("double").alias("x"))))
    arrays = windows.groupBy(*keys, "w").agg(F.transform(ordered, lambda s: s["x"]).alias("x"))
    bins = arrays.select(*keys, "w", F.posexplode(power("x")).alias("bin", "power"))
    return bins.withColumn("frequency", F.col("bin") * F.lit(rate / size))


def band_power(bins: DataFrame, keys: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Mean power of each half-open band, 0 where a band has no bin."""
    bands = list(zip(edges, edges[1:], strict=False))
    inside = lambda a, b: (F.col("frequency") >= a) & (F.col("frequency") < b)
    return bins.groupBy(*keys, "w").agg(*[F.coalesce(F.avg(F.when(inside(a, b), F.col("power"))), F.lit(0.0)).alias(f"band{i}") for i, (a, b) in enumerate(bands)])


def top_peaks(bins: DataFrame, keys: Sequence[str], most: int, threshold: float, rate: float, size: int) -> DataFrame:
    """Keys, w, place (from 1), frequency and power of each spectrum's ``most``
    highest peaks (ties to the lower bin); those under ``threshold`` and places
    without a peak are 0.  Frequencies divide 0 to half the rate by the bins less two."""
    key = [*keys, "w"]
    over = Window.partitionBy(*key).orderBy("bin")
    sides = bins.withColumns({"_a": F.lag("power").over(over), "_b": F.lead("power").over(over)})
    peak = (F.col("power") > F.col("_a")) & (F.col("power") > F.col("_b")) & (F.col("power") >= threshold)
    at = F.col("bin") * F.lit(rate / 2 / (size // 2 - 1))
    found = sides.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(peak, F.struct((-F.col("power")).alias("p"), at.alias("f"))))).alias("_p"))
    places = found.select(*key, "_p", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("place"))
    one = F.get("_p", F.col("place") - 1)
    return places.select(*key, "place", F.coalesce(one["f"], F.lit(0.0)).alias("frequency"), F.coalesce(-one["p"], F.lit(0.0)).alias("power"))


def component_features(rows: DataFrame, keys: Sequence[str], value: str = "x", bins: int = 100) -> DataFrame:
    """The fourteen features of each component of ``i`` and ``value``: entropy of
    a histogram, crossings, percentiles and moments (0 for those of a flat one)."""
    x, whole = F.col(value), Window.partitionBy(*keys)
    rows = rows.withColumns({"_low": F.min(x).over(whole), "_high": F.max(x).over(whole), "_mean": F.avg(x).over(whole), "_before": F.lag(x).over(whole.orderBy("i"))})
    step = (F.col("_high") - F.col("_low")) / bins
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((x - F.col("_low")) / step), F.lit(bins - 1))).otherwise(F.lit(0))
    inside = F.count("*").over(Window.partitionBy(*keys, "_bin"))
    rows = rows.withColumn("_bin", at).withColumn("_inside", inside)
    n, across = F.count("*"), lambda level: F.count(F.when((x - level) * (F.col("_before") - level) < 0, 1))
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return rows.groupBy(*keys).agg(
        (F.log(n) - F.avg(F.log("_inside"))).alias("entropy"), (across(F.lit(0.0)) / n).alias("zero_crossings"), (across(F.col("_mean")) / n).alias("mean_crossings"),
        *[F.percentile(x, F.lit(p)).alias(name) for name, p in shares.items()], F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("variance"),
        F.sqrt(F.avg(x * x)).alias("rms"), F.coalesce(F.nanvl(F.skewness(x), F.lit(0.0)), F.lit(0.0)).alias("skew"), F.coalesce(F.nanvl(F.kurtosis(x), F.lit(0.0)), F.lit(0.0)).alias("kurtosis"),
    )


def crossings_and_entropy(windows: DataFrame, keys: Sequence[str], value: str, bins: int = 100) -> DataFrame:
    """Entropy of a histogram between the window's ends (0 in a flat one), and
    the shares of steps across zero and across the window's mean."""
    key, x = [*keys, "w"], F.col(value)
    whole = Window.partitionBy(*key)
    before = F.lag(x).over(whole.orderBy("i"))
    rows = windows.withColumns({"_low": F.min(x).over(whole), "_high": F.max(x).over(whole), "_mean": F.avg(x).over(whole), "_before": before})
    step = (F.col("_high") - F.col("_low")) / bins
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((x - F.col("_low")) / step), F.lit(bins - 1))).otherwise(F.lit(0))
    across = lambda level: F.sum((((x - level) * (F.col("_before") - level)) < 0).cast("int"))
    counts = rows.withColumn("_bin", at).groupBy(*key, "_bin").agg(F.count("*").alias("n"), across(F.lit(0.0)).alias("zero"), across(F.col("_mean")).alias("middle"))
    n = F.sum("n")
    return counts.groupBy(*key).agg(
        (F.log(n) - F.sum(F.col("n") * F.log("n")) / n).alias("entropy"),
        (F.coalesce(F.sum("zero"), F.lit(0)) / n).alias("zero_crossings"), (F.coalesce(F.sum("middle"), F.lit(0)) / n).alias("mean_crossings"),
    )


def nearest_rank(windows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """The samples at the nearest rank of each share; a window is an array of bounded size."""
    g = windows.groupBy(*keys, "w").agg(F.sort_array(F.collect_list(value)).alias("x"))
    at = lambda p: F.get("x", F.floor(p * (F.size("x") - 1) + 0.5).cast("int"))
    return g.select(*keys, "w", *[at(p).alias(f"p{round(100 * p):02d}") for p in shares])


def mel(frequency: Column) -> Column:
    """Frequency in mel."""
    return 1127.0 * F.log1p(frequency / 700.0)


def hertz(m: Column) -> Column:
    """The frequency of a mel value."""
    return 700.0 * F.expm1(m / 1127.0)


def triangle(x: Column, left: float, middle: float, right: float) -> Column:
    """0 outside ``left`` to ``right``, 1 at ``middle``, straight between."""
    return F.when((x > left) & (x < middle), (x - left) / (middle - left)).when((x >= middle) & (x < right), (right - x) / (right - middle)).otherwise(0.0)
