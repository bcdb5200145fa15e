"""Queries that return every row, where a cut would go unseen on short sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import blocks, oxygen
from sensorloom.plans import catalog

QUERIES = catalog.queries()


def long_sessions(spark, folder, n=60):
    """Two sessions of ``n`` samples with tied values."""
    rows = [(u * 1000 + i, u, float((i * 7) % 11), i) for u in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, s int")
    df = df.selectExpr("event_id", "user_id", "'view' AS event_type", "value", "timestamp_seconds(1704067200 + s) AS ts")
    df.write.parquet(f"{folder}/events.parquet")
    return [(e, u, int(v * 8), i) for e, u, v, i in rows]


def test_all_samples_are_sorted(spark, tmp_path):
    rows = long_sessions(spark, tmp_path)
    up = {(r["user_id"], r["pos"]): (r["event_id"], r["raw"]) for r in QUERIES["t02_ascending"](spark, str(tmp_path)).collect()}
    down = {(r["user_id"], r["pos"]): (r["idx"], r["raw"]) for r in QUERIES["t03_sorted_indices"](spark, str(tmp_path)).collect()}
    assert len(up) == len(down) == len(rows)
    for u in (1, 2):
        own = [r for r in rows if r[1] == u]
        assert [up[u, k] for k in range(60)] == [(e, v) for e, _, v, i in sorted(own, key=lambda r: (r[2], r[3]))]
        assert [down[u, k] for k in range(60)] == [(i, v) for _, _, v, i in sorted(own, key=lambda r: (-r[2], r[3]))]


def test_all_positions_are_joined(spark, tmp_path):
    rows = long_sessions(spark, tmp_path)
    got = {(r["user_id"], r["idx"]): r["raw"] for r in QUERIES["j04_positional_join"](spark, str(tmp_path)).collect()}
    assert got == {(u, i): v for _, u, v, i in rows}


def test_lines_of_any_quantity_are_judged(spark, tmp_path):
    rows = [(1, 1, 5.0, "F", 0.1, 0.08), (1, 2, 5.0, "F", 0.0, 0.0), (2, 1, 50.0, "O", 0.1, 0.08), (3, 1, 7.0, "O", 0.1, 0.08), (3, 2, 50.0, "O", 0.0, 0.0), (4, 1, 1.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string, l_discount double, l_tax double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted(map(tuple, QUERIES["a32_wrong_predictions"](spark, str(tmp_path)).collect()))
    assert found == [(1, 2, "false_negative"), (2, 1, "false_positive"), (3, 1, "false_positive")]
    assert QUERIES["a32_prediction_counts"](spark, str(tmp_path)).first().asDict() == {"total": 5, "correct": 2, "false_positive": 2, "false_negative": 1}


def suppliers(spark):
    rows = [(i, (0 if i % 3 else i % 5), float(i * 37 % 50)) for i in range(400)] + [(400, 0, None), (401, None, 3.0), (402, None, None), (403, 2, None)]
    by = lambda r: (r[1] is None, r[1] or 0, r[2] is None, -(r[2] or 0), r[0])
    return spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double"), [r[0] for r in sorted(rows, key=by)]


@pytest.mark.parametrize("rows_per_range", [1 << 20, 20])
def test_positions_over_ranges(spark, rows_per_range):
    df, expected = suppliers(spark)
    order = [F.asc_nulls_last("s_nationkey"), F.desc_nulls_last("s_acctbal"), F.asc_nulls_last("s_suppkey")]
    got = blocks.numbered(df, [], order, "pos", rows_per_range).collect()
    assert [r["s_suppkey"] for r in sorted(got, key=lambda r: r["pos"])] == expected and sorted(r["pos"] for r in got) == list(range(404))


def test_whole_table_is_sorted(spark, tmp_path):
    df, expected = suppliers(spark)
    df.write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["t05_multi_key_sort"](spark, str(tmp_path)).collect()] == [(k, i + 1) for i, k in enumerate(expected)]


def test_each_user_is_an_oxygen_session(spark, small):
    users = spark.read.parquet(f"{small}/events.parquet").filter("user_id IS NOT NULL").select("user_id").distinct().collect()
    got = QUERIES["o05_oxygen"](spark, small).collect()
    assert sorted(r["user_id"] for r in got) == sorted(r["user_id"] for r in users)


def test_oxygen_of_long_sessions(spark):
    expected, rows = {}, []
    for user, n in ((1, 399), (2, 400), (3, 401), (4, 802), (5, 1203), (6, 2000), (None, 430)):
        t = np.arange(n)
        red, ir = (40000 + 500 * np.sin(2 * np.pi * t / 80)).astype(np.int64), (60000 + 1200 * np.sin(2 * np.pi * t / 80) + 37 * (t % 4)).astype(np.int64)
        ir[0] = 300_000 if n > 401 else ir[0]  # a fault before the last 400
        rows += [(user, int(i), int(ir[i]), int(red[i])) for i in t]
        if n >= 400:  # the samples with numbers that 4 divides, of the whole session
            expected[user] = ("ok", *oxygen.estimate(ir[::4][-100:], red[::4][-100:]))
        else:
            expected[user] = ("not_ready", None, None)
    df = spark.createDataFrame(rows, "user_id long, ts_us long, ir long, red long").repartition(5)
    cut = oxygen.session_oxygen(df, ["user_id"], ["ts_us"], "ir", "red").collect()
    assert {r["user_id"]: (r["status"], r["percent"], r["bpm"]) for r in cut} == expected
    assert all(p is not None for status, p, _ in expected.values() if status == "ok")
