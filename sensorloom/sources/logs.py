"""Readers and writers of logs: binary frames, serial text, batches, telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A frame's sync word and layout, 28 bytes little-endian.
SYNC = 0xA55A
FRAME = np.dtype(
    [("sync", "<u2"), ("schema", "u1"), ("record_type", "u1"), ("timestamp_us", "<u8"), ("sequence", "<u4"), ("value_a", "<i4"), ("value_b", "<i4"), ("flags", "<u2"), ("checksum", "<u2")]
)
RECORDS = "schema int, record_type int, timestamp_us long, sequence long, value_a int, value_b int, flags int"
_COLUMNS = ["schema", "record_type", "timestamp_us", "sequence", "value_a", "value_b", "flags"]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x1021, table << 1) & 0xFFFF
    return table.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16/CCITT of each row of bytes (polynomial 0x1021, from 0xFFFF), all rows at once."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def encoded(records: pd.DataFrame) -> bytes:
    """Frames of some records."""
    frames = np.zeros(len(records), FRAME)
    frames["sync"] = SYNC
    for c in _COLUMNS:
        frames[c] = records[c].to_numpy()
    raw = frames.view(np.uint8).reshape(len(frames), FRAME.itemsize)
    frames["checksum"] = crc16(raw[:, : FRAME.itemsize - 2])
    return frames.tobytes()


def session_header(df: DataFrame, keys: list[str], session: str, device: str, rates: tuple[int, int], versions: dict[str, int], hardware: dict[str, int], commit: str) -> DataFrame:
    """Keys and the four records (types 16 to 19) that begin a session's log:
    session and device with the two rates, versions, hardware, and the commit's
    twenty bytes.  Two 16-bit numbers share one 32-bit value."""

    def pair(high: int, low: int) -> int:
        return high << 16 | low

    parts = np.frombuffer(bytes.fromhex(commit), np.dtype([("a", "<i8"), ("b", "<i4"), ("c", "<i4"), ("d", "<i4")]))[0].item()
    s, d, v, h = F.col(session).cast("long"), F.col(device).cast("long"), versions, hardware
    low, high = d.bitwiseAND((1 << 32) - 1), F.shiftright(d, 32).cast("int")
    rows = [
        (16, s, low, high, pair(*rates), v["features"]),
        (17, s, v["firmware"], pair(v["ppg"], v["ecg"]), pair(v["quality"], v["oxygen"]), v["calibration"]),
        (18, s, h["red"] | h["ir"] << 8, h["range"], h["window_ms"], h["width_us"]),
        (19, *parts, 0),
    ]
    types = ["int", "long", "long", "int", "int", "int"]
    record = F.explode(F.array(*[F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(t).alias(n) for n, x, t in zip(_COLUMNS[1:], r, types, strict=True)]) for r in rows]))
    return df.select(*keys, record.alias("r")).select(*keys, "r.*")


def decoded(content: bytes) -> pd.DataFrame:
    """The records of some frames; a rest, a wrong sync word or checksum is an error."""
    if len(content) % FRAME.itemsize:
        raise ValueError("trailing bytes after the last frame")
    frames = np.frombuffer(content, FRAME)
    raw = frames.view(np.uint8).reshape(len(frames), FRAME.itemsize)
    if (frames["sync"] != SYNC).any() or (crc16(raw[:, : FRAME.itemsize - 2]) != frames["checksum"]).any():
        raise ValueError("frame without sync or with a wrong checksum")
    return pd.DataFrame({c: frames[c].astype(np.int64 if c in ("timestamp_us", "sequence") else np.int32) for c in _COLUMNS})


def encode_frames(records: DataFrame) -> DataFrame:
    """One binary row of frames for each batch of records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": [encoded(batch)]})

    return records.select(*_COLUMNS).mapInPandas(run, "content binary")


def decode_frames(files: DataFrame) -> DataFrame:
    """Records of rows with ``content``, such as ``spark.read.format("binaryFile")`` gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield decoded(bytes(content))

    return files.select("content").mapInPandas(run, RECORDS)


def read_binary_logs(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file, folder or glob, read in byte ranges; damaged
    bytes are an error.  ``sensor_log`` gives those as rows."""
    from sensorloom.sources.log_source import LogSource

    spark.dataSource.register(LogSource)
    found = spark.read.format("sensor_log").load(path)
    bad = F.raise_error(F.format_string("%s: %s at byte %d of %s", F.lit("damaged log"), F.col("reason"), F.col("offset"), F.col("path")))
    return found.select(F.when(F.col("reason").isNotNull(), bad.cast("int")).otherwise(F.col("schema")).alias("schema"), *_COLUMNS[1:])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a malformed row is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def parse_serial(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``S,t,ecg,red,ir`` or ``SAMPLE,t,index,ecg,red,ir`` as columns; others are left."""
    parts = F.split(F.trim(F.col(column)), ",")
    short = (F.size("p") == 5) & (F.get("p", F.lit(0)) == "S")
    long = (F.size("p") == 6) & (F.get("p", F.lit(0)) == "SAMPLE")
    at = lambda a, b: F.when(short, F.get("p", F.lit(a))).otherwise(F.get("p", F.lit(b))).try_cast("long")
    rows = lines.select(parts.alias("p")).filter(short | long)
    return rows.select(at(1, 1).alias("timestamp_us"), at(2, 3).alias("ecg_raw"), at(3, 4).alias("red_raw"), at(4, 5).alias("ir_raw"))


def batch_timestamps(batches: DataFrame, keys: list[str], order: list[str], poll: str, n: str, period_us: int) -> DataFrame:
    """A row for each sample of polled batches.  The first batch ends
    at its poll, not before 0; each later one goes on a period after the last
    sample, so a sample's time follows from how many came before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.greatest(F.lit(0), F.first(F.col(poll) - (F.col(n) - 1) * period_us).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = batches.filter(F.col(n) > 0).withColumn("_first", first).withColumn("_before", before)
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
    return rows.withColumn("timestamp_us", F.col("_first") + (F.col("_before") + F.col("sample")) * period_us).drop("_first", "_before")


def fanned_out(results: DataFrame, keys: list[str], values: dict[int, Column]) -> DataFrame:
    """One row for each record type and result."""
    pairs = F.array(*[F.struct(F.lit(t).alias("record_type"), v.cast("double").alias("value")) for t, v in values.items()])
    return results.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.record_type", "r.value")


def telemetry(df: DataFrame, columns: list[str], limit: int = 1536) -> DataFrame:
    """A flat JSON object for each row, nulls kept; objects of ``limit`` bytes or more go."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.withColumn("body", body).filter(F.octet_length("body") < limit)


def preferred_file(files: DataFrame, key: str) -> DataFrame:
    """Of each key's files, that in a folder of its name, then the shallowest, then the first by path."""
    matches = F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2) == F.col(key)
    depth = F.size(F.split("path", "/"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(matches.desc(), depth, "path"))
    return files.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
