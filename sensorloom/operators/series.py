"""Ordered series: gaps, segments, windows, runs, interval joins, sampling.

Windows are anchored to a session's start or to counts, as the sources have no
wall clock.  Joins between points and windows go by the windows' numbers, so
they are equi-joins and never compare all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import quantiles
from sensorloom.storage import written


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def continuity(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, max_step_us: int) -> DataFrame:
    """``step_us`` since the row before, ``gap`` (a longer
    step, or none forward), and ``segment``, which grows with each gap."""
    w = ordered(keys, order)
    step = F.col(ts) - F.lag(ts).over(w)
    rows = df.withColumn("step_us", step).withColumn("gap", F.coalesce((F.col("step_us") > max_step_us) | (F.col("step_us") <= 0), F.lit(False)))
    return rows.withColumn("segment", F.sum(F.col("gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stream_validation(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Rows, missing numbers, steps back, duration, median step and rate."""
    rows = df.withColumn("step", F.col(ts) - F.lag(ts).over(ordered(keys, order)))
    columns = {
        "n_rows": F.count("*"),
        "n_missing": F.max(seq) - F.min(seq) + 1 - F.countDistinct(seq),
        "n_regressions": F.count(F.when(F.col("step") <= 0, 1)),
        "duration_s": (F.max(ts) - F.min(ts)) / 1e6,
    }
    found = quantiles.aggregated(rows, keys, columns, {"median_step_us": (F.col("step"), 0.5)}, quantiles.large_groups(df, keys))
    return found.withColumn("rate_hz", F.when(F.col("median_step_us") > 0, 1e6 / F.col("median_step_us")))


def replay_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, seq: str, clipped: Column) -> DataFrame:
    """Lost sequence numbers, steps that don't go forward, mean period and clipped rows of each stream."""
    w = ordered(keys, order)
    rows = df.select("*", (F.col(seq) - F.lag(seq).over(w)).alias("_d"), (F.col(ts) - F.lag(ts).over(w)).alias("_t"), clipped.alias("_clipped"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("_d") - 1)), F.lit(0)).alias("n_lost"),
        F.count(F.when(F.col("_t") <= 0, 1)).alias("n_not_forward"),
        F.avg("_t").alias("mean_period_us"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("span_us"),
        F.count(F.when(F.col("_clipped"), 1)).alias("n_clipped"),
    )


def session_windows(df: DataFrame, keys: Sequence[str], ts: str, start: Column, width_us: int, step_us: int, candidates: int | None = None) -> DataFrame:
    """Each point with the number ``k`` of each half-open
    window [start + k step, + width) that holds it; numbers below ``candidates``."""
    at = F.col(ts) - start
    last = F.floor(at / step_us)
    first = F.greatest(F.lit(0), F.floor((at - width_us) / step_us) + 1)
    if candidates is not None:
        last = F.least(last, F.lit(candidates - 1))
    numbers = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.filter(at >= 0).withColumn("k", F.explode(numbers))


def count_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, step: int) -> DataFrame:
    """Each row with each window of ``width`` rows, every ``step`` rows,
    that holds it; only full windows.  ``idx`` is the row's number from 0."""
    rows = df.withColumn("idx", F.row_number().over(ordered(keys, order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - width) / step) + 1)
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - width) / step))
    numbers = F.when((F.col("_n") >= width) & (last >= first), F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("k", F.explode(numbers)).drop("_n")


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, every: int) -> DataFrame:
    """Mean, deviation and RMS of the last ``width`` rows, on each
    ``every``-th row once there are that many."""
    w = ordered(keys, order)
    frame = w.rowsBetween(1 - width, 0)
    x = F.col(value)
    rows = df.select(
        *keys, *order, F.row_number().over(w).alias("rn"), F.avg(x).over(frame).alias("mean"), F.stddev_pop(x).over(frame).alias("std"), F.sqrt(F.avg(x * x).over(frame)).alias("rms")
    )
    return rows.filter((F.col("rn") >= width) & ((F.col("rn") - width) % every == 0))


def centred_mean(value: str, keys: Sequence[str], order: Sequence[str], width: int) -> Column:
    """The sum of a centred frame over its width, so edges count as zeros."""
    half = width // 2
    return F.sum(value).over(ordered(keys, order).rowsBetween(half - width + 1, half)) / width


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """One row for each maximal run of equal labels: first and last number, rows."""
    w = ordered(keys, order)
    rows = df.withColumn("idx", F.row_number().over(w) - 1)
    changed = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run", label).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_rows"))


def windows_in_runs(run_rows: DataFrame, width: int, step: int) -> DataFrame:
    """The windows of ``width`` rows, every ``step``, that a run holds whole."""
    last = F.col("last_idx") - width + 1
    starts = F.when(last >= F.col("first_idx"), F.sequence(F.col("first_idx").cast("long"), last.cast("long"), F.lit(step).cast("long")))
    return run_rows.withColumn("start_idx", F.explode(starts)).withColumn("end_idx", F.col("start_idx") + width)


def local_maxima(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, radius: int = 1) -> DataFrame:
    """Rows over all ``radius`` rows before and at least as high as those after."""
    w = ordered(keys, order)
    before, after = F.max(value).over(w.rowsBetween(-radius, -1)), F.max(value).over(w.rowsBetween(1, radius))
    rows = df.withColumn("_before", before).withColumn("_after", after)
    return rows.filter((F.col(value) > F.col("_before")) & (F.col(value) >= F.col("_after"))).drop("_before", "_after")


def decimated(df: DataFrame, keys: Sequence[str], order: Sequence[str], every: int) -> DataFrame:
    """Each ``every``-th row."""
    return df.withColumn("rn", F.row_number().over(ordered(keys, order))).filter(F.col("rn") % every == 0).drop("rn")


def pair_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """means of two neighbours, halves up, within each group; a last odd row is left."""
    rows = df.withColumn("pair", F.floor((F.row_number().over(ordered(keys, order)) - 1) / 2))
    means = rows.groupBy(*keys, "pair").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    return means.filter("_n = 2").select(*keys, "pair", F.floor((F.col("_sum") + 1) / 2).cast("long").alias("mean"))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    backwards = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn_desc", F.row_number().over(backwards)).filter(F.col("rn_desc") <= n)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Every row with ``pos``, its place from 0 in the group's order."""
    return df.withColumn("pos", (F.row_number().over(ordered(keys, order)) - 1).cast("long"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, low_us: int, high_us: int) -> DataFrame:
    """Each row of ``left`` with the last time in ``right`` before it, if
    that is ``low_us`` to ``high_us`` back.  One sort of the union by time; no
    pairs are formed."""
    both = left.select(*keys, ts, F.lit(1).alias("side")).unionByName(right.select(*keys, ts, F.lit(0).alias("side")))
    w = Window.partitionBy(*keys).orderBy(ts, F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.col(ts)), ignorenulls=True).over(w)
    rows = both.withColumn("matched_us", seen).filter("side = 1").drop("side")
    delay = F.col(ts) - F.col("matched_us")
    return rows.withColumn("delay_us", F.when(delay.between(low_us, high_us), delay)).withColumn("matched_us", F.when(delay.between(low_us, high_us), F.col("matched_us")))


def refine_peaks(samples: DataFrame, peaks: DataFrame, keys: Sequence[str], idx: str, value: str, radius: int) -> DataFrame:
    """For each peak, the row of largest magnitude within ``radius`` rows;
    the first of equal ones."""
    near = peaks.select(*keys, F.col(idx).alias("peak_idx"), F.explode(F.sequence(F.col(idx) - radius, F.col(idx) + radius)).alias(idx))
    joined = near.join(samples.select(*keys, idx, value), [*keys, idx])
    best = F.max_by(F.struct(idx, value), F.struct(F.abs(value), -F.col(idx)))
    return joined.groupBy(*keys, "peak_idx").agg(best.alias("b")).select(*keys, "peak_idx", F.col(f"b.{idx}").alias("refined_idx"), F.col(f"b.{value}").alias("amplitude"))


def best_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each group, the first by ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def balanced_sample(df: DataFrame, group: Sequence[str], label: str, id_column: str, most: int, seed: int = 42) -> DataFrame:
    """From each group as many rows of each label as its rarest label has,
    ``most`` at most, picked by a seeded hash.  The rows differ from those
    of a sequential shuffle; the numbers are the same."""
    sizes = df.groupBy(*group, label).agg(F.count("*").alias("_n"))
    quota = sizes.groupBy(*group).agg(F.least(F.min("_n"), F.lit(most)).alias("_quota"))
    rank = F.row_number().over(Window.partitionBy(*group, label).orderBy(F.xxhash64(F.lit(seed), F.col(id_column)), id_column))
    return df.withColumn("_rank", rank).join(quota, list(group)).filter(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def leakage(df: DataFrame, subject: str, split: str) -> DataFrame:
    """Subjects that are in more than one split."""
    return df.groupBy(subject).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def split_check(df: DataFrame, subject: str, split: str, expected: dict[str, int]) -> DataFrame:
    """For each expected split its subjects, those that are in another split
    too, and whether both are as they should be; ``verified`` raises if not."""
    pairs = df.select(F.col(subject).alias("subject"), F.col(split).alias("split")).distinct()
    shared = pairs.groupBy("subject").agg(F.count("*").alias("n_splits"))
    found = pairs.join(shared, "subject").groupBy("split").agg(F.count("*").alias("n_subjects"), F.count(F.when(F.col("n_splits") > 1, 1)).alias("n_shared"))
    wanted = df.sparkSession.createDataFrame(list(expected.items()), "split string, expected int")
    rows = wanted.join(found, "split", "left").na.fill(0, ["n_subjects", "n_shared"])
    return rows.withColumn("ok", (F.col("n_subjects") == F.col("expected")) & (F.col("n_shared") == 0))


def verified(checked: DataFrame) -> DataFrame:
    """The rows of ``split_check``; a row that isn't ok is an error when it is read."""
    message = F.concat(F.lit("split "), "split", F.lit(": subjects "), "n_subjects", F.lit(", expected "), "expected", F.lit(", in another split too "), "n_shared")
    return checked.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(message).cast("boolean")))


def classification_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, precision, recall, F1
    and AUC.  Ranks of tied scores are their mean, taken from counts by score, so
    no row is ranked one by one."""
    y, s = F.col(label), F.col(score)
    by_score = df.groupBy(*keys, s.alias("_s")).agg(F.sum((y == 1).cast("long")).alias("_p"), F.sum((y == 0).cast("long")).alias("_n"))
    n = df.count()
    if n > quantiles.RANGE_ROWS:
        by_score = written(by_score, "scores")
    area = quantiles.prefix_sums(by_score, keys, ["_s"], "_n", "_below", rows=n)
    hit = F.col("_s") >= threshold
    total = area.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("_n")).otherwise(0)).alias("tn"),
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_wins"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    recall, precision = share(tp, tp + fn), share(tp, tp + fp)
    return total.select(
        *keys, "tp", "fp", "fn", "tn",
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        ((recall + share(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(F.col("_wins"), (tp + fn) * (fp + tn)).alias("auc"),
    )
