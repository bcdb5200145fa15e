import json
import os
import shutil

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.sources import log_source as L
from sensorloom.sources import logs

NAMES = [f.split()[0] for f in logs.RECORDS.split(", ")]


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(L.LogSource)
    return spark


def records(n, first=0):
    i = np.arange(first, first + n)
    return pd.DataFrame({"schema": 2, "record_type": i % 5, "timestamp_us": i * 5000, "sequence": i, "value_a": -i, "value_b": i * 7, "flags": i % 3})


def plain(data):
    """One pass over the bytes: good frames, and what lies between them cut at sync words and at multiples of CUT."""
    good, p = [], 0
    sync = logs.SYNC.to_bytes(2, "little")
    while p + 28 <= len(data):
        if data[p : p + 2] == sync and logs.crc16(np.frombuffer(data[p : p + 26], np.uint8)[None])[0] == int.from_bytes(data[p + 26 : p + 28], "little"):
            good.append(p)
            p += 28
        else:
            p += 1
    rows, at = [(g, 28, None) for g in good], 0
    for a, b in zip([0, *[g + 28 for g in good]], [*good, len(data)], strict=True):
        p = a
        while p < b:
            begins = data[p : p + 2] == sync
            q = p + 1
            while q < b and data[q : q + 2] != sync:
                q += 1
            cuts = [c for c in range(0, q, L.CUT) if c >= p + (28 if begins else 1)]
            bounds = [p, *cuts, q]
            rows += [(x, y - x, ("checksum" if q - p >= 28 else "torn") if begins and x == p else "no_sync") for x, y in zip(bounds, bounds[1:], strict=False)]
            p = q
    return sorted(rows)


def stepped(data, cuts, tmp):
    """The rows of some ranges of a file."""
    tmp.write_bytes(data)
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for batch in L.read_range(L.Range(str(tmp), a, b, len(data), a == 0)):
            found += list(zip(*[batch.column(c).to_pylist() for c in ("offset", "n_bytes", "reason")], strict=True))
    return found


def damaged(seed, n=3000):
    """Frames with torn ones, wrong checksums, runs of junk with sync words in it, and a torn end."""
    rng = np.random.default_rng(seed)
    parts = []
    while sum(map(len, parts)) < n * 28:
        kind = rng.integers(0, 12)
        frame = logs.encoded(records(1, int(rng.integers(0, 10**6))))
        if kind == 0:
            parts.append(frame[: rng.integers(1, 28)])
        elif kind == 1:
            parts.append(frame[:10] + bytes([frame[10] ^ 255]) + frame[11:])
        elif kind == 2:
            parts.append(rng.bytes(int(rng.integers(1, 9000))))
        elif kind == 3:
            parts.append(b"\x5a\xa5" * int(rng.integers(1, 40)))
        else:
            parts.append(logs.encoded(records(int(rng.integers(1, 200)), int(rng.integers(0, 10**6)))))
    return b"".join(parts) + frame[:11]


@pytest.mark.parametrize("seed", range(4))
def test_any_split_gives_the_same_rows(tmp_path, seed, monkeypatch):
    data = damaged(seed)
    expected = plain(data)
    rng = np.random.default_rng(seed + 50)
    for step in (4 << 20, 4096):
        monkeypatch.setattr(L, "STEP_BYTES", step)
        for _ in range(3):
            cuts = sorted({0, len(data), *(rng.integers(0, len(data) // L.CUT, 9) * L.CUT).tolist()})
            assert stepped(data, cuts, tmp_path / "x") == expected
    assert sum(n for _, n, _ in expected) == len(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=60), st.just(b"\x5a\xa5"), st.integers(0, 99).map(lambda i: logs.encoded(records(1, i))), st.integers(1, 27).map(lambda k: logs.encoded(records(1, k))[:k])), max_size=30))
def test_every_byte_is_in_one_row(tmp_path_factory, parts):
    data = b"".join(parts)
    got = stepped(data, [0, len(data)], tmp_path_factory.mktemp("bytes") / "x")
    assert got == plain(data)


def test_frames_that_overlap_all_the_way_back(tmp_path, monkeypatch):
    """Only where frames are apart is it sure which are good: the reader looks back as far as it takes."""
    monkeypatch.setattr(L, "AROUND", 64)
    marked = lambda data: np.flatnonzero(data[: max(0, len(data) - 27)] == 1)
    monkeypatch.setattr(L, "_good", lambda data: (marked(data), marked(data)))
    monkeypatch.setattr(L, "CUT", 1 << 40)
    data = (b"\1" + bytes(19)) * 40
    one = [r for r in stepped(data, [0, 800], tmp_path / "x") if r[2] is None]
    assert [r[0] for r in one] == list(range(0, 773, 40))
    assert [r for r in stepped(data, [0, 400, 800], tmp_path / "x") if r[2] is None] == one


def test_many_tasks_read_one_file(source, tmp_path):
    n = 200_000
    content = bytearray(logs.encoded(records(n)))
    content[28 * 777 + 9] ^= 1
    (tmp_path / "x.bin").write_bytes(bytes(content) + b"tail")
    (tmp_path / "_hidden.bin").write_bytes(b"not read")
    df = source.read.format("sensor_log").option("partitionBytes", 1 << 19).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == -(-len(content) // (1 << 19))
    rows = df.toPandas()
    bad = rows[rows["reason"].notna()]
    assert bad[["offset", "n_bytes", "reason"]].values.tolist() == [[28 * 777, 28, "checksum"], [28 * n, 4, "no_sync"]]
    good = rows[rows["reason"].isna()]
    expected = records(n).drop(777)
    assert (good[NAMES].to_numpy(np.int64) == expected.to_numpy()).all()
    with pytest.raises(Exception, match="damaged log"):
        logs.read_binary_logs(source, str(tmp_path)).collect()


def test_files_folders_and_globs(source, tmp_path):
    for name in ("a/x.bin", "a/y.log", "b/c/z.bin"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(logs.encoded(records(3)))
    (tmp_path / "b/empty.bin").write_bytes(b"")
    count = lambda p: source.read.format("sensor_log").load(p).count()
    assert [count(f"{tmp_path}{x}") for x in ("", "/a", "/a/x.bin", "/*/*.bin", "/b/empty.bin")] == [9, 6, 3, 6, 0]
    assert count(f"file://{tmp_path}/a") == 6


def test_a_save_is_whole_or_nothing(source, tmp_path):
    rows = source.createDataFrame(records(5000)).repartition(4)
    rows.write.format("sensor_log").mode("append").save(str(tmp_path))
    assert not os.path.exists(tmp_path / "_staging/x") and len(list(tmp_path.glob("*.bin"))) == 4
    failing = rows.selectExpr("schema", "record_type", "timestamp_us", "if(sequence = 4321, raise_error('no'), sequence) AS sequence", "value_a", "value_b", "flags")
    with pytest.raises(Exception, match="no"):
        failing.write.format("sensor_log").mode("append").save(str(tmp_path))
    assert source.read.format("sensor_log").load(str(tmp_path)).count() == 5000
    assert list(tmp_path.glob("_staging/*")) == []
    source.createDataFrame(records(10)).write.format("sensor_log").mode("overwrite").save(str(tmp_path))
    assert sorted(r["sequence"] for r in source.read.format("sensor_log").load(str(tmp_path)).collect()) == list(range(10))


def test_a_growing_log_as_a_stream(source, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    os.makedirs(log)
    stream = source.readStream.format("sensor_log").option("partitionBytes", 1 << 16).load(str(log))

    def poll():
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out)).awaitTermination(60)
        return source.read.schema(L.SCHEMA).parquet(str(out)).toPandas() if out.exists() else pd.DataFrame()

    content = logs.encoded(records(6000))
    (log / "x.bin").write_bytes(content[: 28 * 2500 + 13])  # the last frame is being written
    assert sorted(poll()["sequence"]) == list(range(2500))
    (log / "x.bin").write_bytes(content[: 28 * 4000])
    (log / "y.bin").write_bytes(b"junk" + logs.encoded(records(5, 9000)))
    got = poll()
    assert sorted(got["sequence"].dropna()) == [*range(4000), *range(9000, 9005)] and got["reason"].dropna().tolist() == ["no_sync"]
    (log / "x.bin").write_bytes(content)
    assert sorted(poll()["sequence"].dropna()) == [*range(6000), *range(9000, 9005)]
    assert len(poll()) == 6006


def test_offsets_go_on_from_a_checkpoint(tmp_path):
    (tmp_path / "x.bin").write_bytes(logs.encoded(records(100)))
    first = L.LogStreamReader({"path": str(tmp_path)})
    at = first.latestOffset()
    again = L.LogStreamReader({"path": str(tmp_path)})
    assert again.partitions(first.initialOffset(), at)[0].end == 2800 and json.loads(again.latestOffset()["files"]) == json.loads(at["files"])
    shutil.rmtree(tmp_path / "gone", ignore_errors=True)
    assert L.LogStreamReader({"path": str(tmp_path / "gone")}).latestOffset() == {"files": "{}"}
