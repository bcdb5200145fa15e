"""Writers: window tables, partitioned splits, summaries, and a stream sink that can repeat a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table gives no rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, rows_per_file: int = 1 << 20) -> None:
    """Parquet, a folder for each value of ``by``, with a file for about
    each ``rows_per_file`` of its rows: a value with most rows is many tasks' work, one with few is one file."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    salted = df.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    dealt = salted.repartition(F.col(by), F.col("_salt"))
    dealt.select(*df.columns).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """JSON lines; NaN becomes null, as JSON has none."""
    doubles = {c for c, kind in df.dtypes if kind in ("double", "float")}
    df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.mode("overwrite").json(path)


def model_parameters(spark: SparkSession, names: Sequence[str], mean: Sequence[float], scale: Sequence[float], coef: Sequence[float], intercept: float) -> DataFrame:
    """A scaled linear model as rows: pos, name, mean, scale, coef; the intercept is the last."""
    rows = [(i, n, float(m), float(s), float(w)) for i, (n, m, s, w) in enumerate(zip(names, mean, scale, coef, strict=True))]
    return spark.createDataFrame([*rows, (len(rows), "(intercept)", None, None, float(intercept))], "pos int, name string, mean double, scale double, coef double")


def write_model(parameters: DataFrame, path: str) -> None:
    """The rows as CSV and as JSON lines."""
    one = parameters.coalesce(1)
    write_csv(one, f"{path}/csv")
    write_summary(one, f"{path}/json")


def upload_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; a batch that is sent again replaces its own
    folder, so delivery is at least once and the result as if once."""

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return send
