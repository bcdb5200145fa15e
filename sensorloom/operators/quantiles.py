"""Exact order statistics and prefix sums, without a task that holds a large group.

Groups of up to RANGE_ROWS rows are one aggregation.  For the others the ranks
that a share needs are searched for: a histogram of BINS ranges between a least
and a highest value, merged over all tasks, tells the range that holds a rank,
and the next pass looks at the rows of that range alone, between its own least
and highest value.  Passes end when the range is one value or has few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.storage import written

#: Rows of a group that one task may hold, ranges of a histogram, and passes before the rows left are sorted anyway.
RANGE_ROWS, BINS, MAX_PASSES = 1 << 20, 4096, 12


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def large_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """The keys (as _k0, _k1 ...) of groups with more than ``limit`` rows; None if there are none."""
    limit = limit or RANGE_ROWS
    if df.count() <= limit:
        return None
    found = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    found = written(found, "large-groups")
    return found if found.head(1) else None


def percentiles(df: DataFrame, keys: Sequence[str], shares: dict[str, tuple[Column, float]], large: DataFrame) -> DataFrame:
    """The keys of ``large`` with each named (value, share)'s interpolated percentile, null where all values are null or NaN is the answer's neighbour."""
    names = [f"_k{i}" for i in range(len(keys))]
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), x.cast("double").alias("x")) for n, (x, _) in shares.items()])
    rows = df.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.explode(wanted).alias("_v")).filter("_v.x IS NOT NULL")
    rows = rows.join(large, _same([f"_r{i}" for i in range(len(keys))], names), "left_semi")
    rows = written(rows.select(*[F.col(f"_r{i}").alias(f"_k{i}") for i in range(len(keys))], F.col("_v.name").alias("name"), F.col("_v.x").alias("x")), "percentile-rows")
    spans = rows.groupBy(*names, "name").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    share = reduce(lambda rest, n: F.when(F.col("name") == n, F.lit(shares[n][1])).otherwise(rest), shares, F.lit(None).cast("double"))
    at = F.col("_p") * (F.col("n") - 1)
    spans = spans.withColumn("_p", share).withColumn("at", at)
    # Two ranks a share: the one below its place and the one above.
    targets = spans.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).select(*names, "name", "at", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("rows"))
    targets = written(targets, "ranks")
    for _ in range(MAX_PASSES):
        if not targets.filter((F.col("rows") > RANGE_ROWS) & (F.col("lo") < F.col("hi"))).head(1):
            break
        targets = written(_narrowed(rows, targets, names), "ranks")
    found = _picked(rows, targets, names).groupBy(*names, "name").agg(F.first("at").alias("at"), F.min(F.struct("rank", "x")).alias("a"), F.max(F.struct("rank", "x")).alias("b"))
    value = F.when(F.col("a.rank") == F.col("b.rank"), F.col("a.x")).otherwise((F.col("b.rank") - F.col("at")) * F.col("a.x") + (F.col("at") - F.col("a.rank")) * F.col("b.x"))
    wide = found.withColumn("_value", value).groupBy(*names).agg(*[F.max(F.when(F.col("name") == n, F.col("_value"))).alias(n) for n in shares])
    return large.join(wide.select(*[F.col(k).alias(f"_o{k}") for k in names], *shares), _same(names, [f"_o{k}" for k in names]), "left").select(*names, *shares)


def _of_targets(rows: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in their targets' ranges; a row of two ranks of one share is there twice."""
    few = targets.select(*[F.col(k).alias(f"_t{k}") for k in names], F.col("name").alias("_name"), "at", "rank", "lo", "hi", "below")
    return rows.join(few, _same([*names, "name"], [*[f"_t{k}" for k in names], "_name"])).filter(F.col("x").between(F.col("lo"), F.col("hi"))).select(*names, "name", "at", "rank", "lo", "hi", "below", "x")


def _narrowed(rows: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each rank's range, within the one that it had."""
    open_ = (F.col("rows") > RANGE_ROWS) & (F.col("lo") < F.col("hi"))
    key = [*names, "name", "rank"]
    # Halves first, so that the width of a range beyond a double's is none.
    part = F.floor(BINS * ((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)))
    binned = _of_targets(rows, targets.filter(open_), names).withColumn("bin", F.least(part, F.lit(BINS - 1)))
    bins = binned.groupBy(*key, "bin").agg(F.first("at").alias("at"), F.first("below").alias("before"), F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    bins = bins.withColumn("below", F.col("before") + F.coalesce(F.sum("rows").over(w), F.lit(0)))
    hit = bins.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("rows")))
    return hit.select(targets.columns).unionByName(targets.filter(~open_))


def _picked(rows: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each rank's value x, from the counts of the values in its range."""
    known = targets.filter(F.col("lo") == F.col("hi")).select(*names, "name", "at", "rank", F.col("lo").alias("x"))
    key = [*names, "name", "at", "rank", "below"]
    counts = _of_targets(rows, targets.filter(F.col("lo") < F.col("hi")), names).groupBy(*key, "x").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_from", F.col("below") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    hit = counts.filter((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_from") + F.col("_n")))
    return known.unionByName(hit.select(*names, "name", "at", "rank", "x"))


def aggregated(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], shares: dict[str, tuple[Column, float]], large: DataFrame | None) -> DataFrame:
    """``columns`` (aggregates) and the percentiles ``shares`` of each group; ``large``: the groups that are too large for one task."""
    plain = [c.alias(n) for n, c in columns.items()]
    whole = [F.percentile(x, F.lit(p)).cast("double").alias(n) for n, (x, p) in shares.items()]
    if large is None:
        return df.groupBy(*keys).agg(*plain, *whole)
    names = [f"_k{i}" for i in range(len(keys))]
    small = df.join(large, _same(keys, names), "left_anti").groupBy(*keys).agg(*plain, *whole)
    rest = df.join(large, _same(keys, names), "left_semi").groupBy(*keys).agg(*plain)
    return small.unionByName(rest.join(percentiles(df, keys, shares, large), _same(keys, names)).select(*keys, *columns, *shares))


def with_percentile(df: DataFrame, keys: Sequence[str], value: Column, share: float, name: str, large: DataFrame | None) -> DataFrame:
    """Every row with its group's percentile of ``value``."""
    if large is None:
        return df.withColumn(name, F.percentile(value, F.lit(share)).over(Window.partitionBy(*keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    small = df.join(large, _same(keys, names), "left_anti").withColumn(name, F.percentile(value, F.lit(share)).over(Window.partitionBy(*keys)))
    rest = df.join(large, _same(keys, names), "left_semi").join(percentiles(df, keys, {name: (value, share)}, large), _same(keys, names))
    return small.unionByName(rest.select(*df.columns, name))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, limit: int | None = None, rows: int | None = None) -> DataFrame:
    """Every row with ``name``, the sum of ``value`` over the rows before it in its group, by a unique order.

    With more rows than ``limit`` they are sorted by ranges: sums within a range,
    and the sums of the ranges before it, a row for each range and group.  ``rows``
    is a number that ``df`` has at most, if that is known."""
    limit = limit or RANGE_ROWS
    total = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = df.count() if rows is None or rows > limit else rows
    if n <= limit:
        return df.withColumn(name, total(Window.partitionBy(*keys).orderBy(*order)))
    by = [F.asc_nulls_first(c) for c in (*keys, *order)]
    rows = written(df.repartitionByRange(-(-n // limit), *by).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_s{k}" for k in keys]
    sums = sums.select(*[F.col(k).alias(f"_s{k}") for k in keys], F.col("_part").alias("_of"), before.alias("_before"))
    within = rows.withColumn("_within", total(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return within.join(sums, _same([*keys, "_part"], [*names, "_of"])).select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))
