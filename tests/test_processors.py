"""The stateful processors on streams that grow and stall."""

import time

import pandas as pd
import pytest

from sensorloom.streaming import processors, sessions

SAMPLES = "session long, stream long, timestamp_us long, value double"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*processors.PROVIDER)
    yield spark
    spark.conf.unset(processors.PROVIDER[0])


def add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def started(frame, name, tmp_path):
    return frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()


def until(spark, query, name, rows, seconds=90):
    end = time.time() + seconds
    while spark.table(name).count() < rows and time.time() < end:
        query.awaitTermination(0.3)
        assert query.exception() is None
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def test_windows_close_when_drained_stalled_or_idle(rocksdb, tmp_path):
    """Session 1's streams both pass window 0; session 2's second stream stalls; session 3 passes no window's end.
    Then all are silent: what is left closes, and a session that comes back begins anew."""
    spark = rocksdb
    rows = [(s, k, t * 100, 1.0 + k) for s in (1, 2, 3) for k in (0, 1) for t in range(15) if not (s == 2 and k == 1 and t > 3) and not (s == 3 and t > 8)]
    add(spark, rows, SAMPLES, tmp_path / "in")
    stream = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    query = started(sessions.closed_windows_stream(stream, 2, 1000, grace_ms=160, idle_ms=12_000), "closed", tmp_path)
    try:
        every = until(spark, query, "closed", 5)
        assert every == [(1, 0, 20, 30.0, "drained"), (1, 1, 10, 15.0, "idle"), (2, 0, 14, 18.0, "stalled"), (2, 1, 5, 5.0, "idle"), (3, 0, 18, 27.0, "idle")]
        add(spark, [(2, 0, 100, 7.0), (2, 1, 200, 7.0), (2, 0, 1100, 7.0), (2, 1, 1200, 7.0)], SAMPLES, tmp_path / "in")
        assert (2, 0, 2, 14.0, "drained") in until(spark, query, "closed", 6)
    finally:
        query.stop()


def test_late_rows_count_no_more(rocksdb, tmp_path):
    spark = rocksdb
    for part in ([(1, 0, 50, 1.0), (1, 1, 130, 2.0), (1, 0, 110, 4.0)], [(1, 0, 60, 5.0), (1, 0, 210, 7.0), (1, 1, 205, 1.0)]):
        add(spark, part, SAMPLES, tmp_path / "in")
        time.sleep(1.1)
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = processors.replayed(sessions.closed_windows_stream(stream, 2, 100, idle_ms=None), "late-windows").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, 1.0, "drained"), (1, 1, 2, 6.0, "drained")]


def test_a_value_expires(rocksdb, tmp_path):
    """A session that was silent for ``idle_ms`` is not late by what it sent before."""
    spark, schema = rocksdb, "session long, arrival long, timestamp_us long, value double"
    add(spark, [(1, 0, 100, 1.0), (2, 0, 100, 1.0)], schema, tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = started(sessions.late_marked_stream(stream, 10, 4000), "marks", tmp_path)
    try:
        until(spark, query, "marks", 2)
        time.sleep(6)
        add(spark, [(1, 1, 50, 2.0)], schema, tmp_path / "in")
        assert (1, 1, 50, 2.0, False, False) in until(spark, query, "marks", 3)
        add(spark, [(1, 2, 40, 3.0)], schema, tmp_path / "in")
        assert (1, 2, 40, 3.0, True, True) in until(spark, query, "marks", 4)
    finally:
        query.stop()


def test_the_slower_input_holds_the_watermark(spark, tmp_path):
    schema, hour = "timestamp_us long, value double", 3_600_000_000
    add(spark, [(h * hour, 1.0) for h in range(10)], schema, tmp_path / "a")
    add(spark, [(h * hour + 1, 3.0) for h in range(4)], schema, tmp_path / "b")
    a, b = (spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in "ab")
    got = processors.replayed(processors.two_stream_windows(a, b, "timestamp_us", "value", "1 hour", "30 minutes").select("w.start", "n", "mean"), "slower").toPandas()
    assert got["n"].tolist() == [2, 2] and got["mean"].tolist() == [2.0, 2.0] and sorted(pd.to_datetime(got["start"]).dt.hour) == [0, 1]


def test_a_replay_that_does_not_end_says_so(rocksdb, tmp_path):
    add(rocksdb, [(1, 0, 50, 1.0)], SAMPLES, tmp_path / "in")
    stream = rocksdb.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError, match="forever"):
        processors.replayed(sessions.closed_windows_stream(stream, 2, 100), "forever", timeout_s=8)


class Counted:
    """A value state that counts its messages."""

    def __init__(self):
        self.value, self.messages = None, 0

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        raise AssertionError("a map is a message for each window")


def test_a_sessions_rows_are_two_messages_for_any_number_of_windows():
    handle, windows = Counted(), processors.Windows(2, 100, 160, None)
    windows.init(handle)
    rows = pd.DataFrame([(1, k, t * 10, 1.0 if t % 7 else None) for t in range(1000) for k in (0, 1)], columns=["session", "stream", "timestamp_us", "value"])
    found = pd.concat(windows.handleInputRows((1,), iter([rows[:700], rows[700:]]), None))
    assert handle.messages == 2 and found["window"].tolist() == list(range(99)) and set(found["n"]) == {20}
    assert found["total"].tolist() == [2.0 * sum(t % 7 > 0 for t in range(10 * w, 10 * w + 10)) for w in range(99)]
    late = pd.DataFrame([(1, 0, 50, 1.0), (1, 0, 995, 1.0), (1, 1, 10_000, 1.0), (1, 0, 10_001, 5.0)], columns=["session", "stream", "timestamp_us", "value"])
    assert pd.concat(windows.handleInputRows((1,), iter([late]), None)).values.tolist() == [[1, 99, 20, 2.0 * sum(t % 7 > 0 for t in range(990, 1000)), "drained"]]
