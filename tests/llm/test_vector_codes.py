import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import vector_codes as V

from .conftest import CLASHING, as_rows

SCHEMA = "vec_id long, embedding array<double>, label int"
END = 2**63 - 1


def brute(rows, entries=64, rounds=2):
    """In Python's whole numbers, vector by vector."""
    kept = [(i, list(v), c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // 16) * 16
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    whole = [[256 * int(x) if abs(x) >= 2**53 else int(np.floor(x * 256)) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    w = dim // 16
    parts = [[v[p * w : p * w + w] for v in whole] for p in range(16)]
    books = [[list(x) for x in parts[p][:entries]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            mine = {}
            for x in parts[p]:
                mine.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    final = [[nearest(parts[p][i], books[p]) for p in range(16)] for i in range(len(kept))]
    errors = [min(END, sum(s for s, _ in f)) for f in final]
    total = {}
    for (_, _, c), e in zip(kept, errors, strict=True):
        total[c] = total.get(c, 0) + e
    digest = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, min(END, total[c]), digest) for (i, _, c), f, e in zip(kept, final, errors, strict=True)), key=repr)


def table(n, dim, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [(i * 3, [float(np.float32(x)) for x in centres[i % 7] + spread * rng.normal(size=dim)], [None, 0, 1, 5][i % 4]) for i in range(n)]


ODD = [(1, None, 0), (2, [float("nan")] * 32, 0), (4, [1.0, None], 1), (5, [float("inf")] * 32, 1), (None, [0.5] * 32, 2), (None, [0.25] * 32, None), (7, [], 0), (8, [0.1] * 5, 0)]
CASES = {
    "plain": table(400, 32),
    "copies": table(100, 32) + [(10_000 + i, table(1, 32)[0][1], 9) for i in range(300)] + [(0, [0.0] * 32, 1), (0, [0.0] * 32, 1)],
    "odd": table(90, 32) + ODD,
    "few": table(5, 16),
    "one": table(1, 64),
    "not a multiple": table(80, 21),
    "only empty arrays": [(1, [], 0), (2, [], None)],
    "none usable": ODD[:4],
    "very large": [(i, [float(10.0 ** (i % 40)) * (-1) ** k for k in range(16)], i % 3) for i in range(90)] + [(99, [1.7e308] * 16, 1)],
    "long sums": [(i, [2.0**20 * (i % 5) - 3.5] * 16, 0) for i in range(80)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_loops(spark, case):
    rows = random.Random(2).sample(CASES[case], len(CASES[case]))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *[F.lit("own").alias(c) for c in {*CLASHING, "code", "n", "columns", "vector"} - {"label"}])
    assert as_rows(V.vector_codes(df)) == brute(CASES[case])


def test_other_sizes_of_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(V, "STEP", 7)
    df = spark.createDataFrame(CASES["plain"], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert as_rows(V.vector_codes(df.repartition(6), entries=5, rounds=3)) == brute(CASES["plain"], 5, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("case", ["plain", "few", "one"])
def test_sql_says_the_same(spark, case, tmp_path):
    spark.createDataFrame(CASES[case], SCHEMA).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(V.ORACLE_SQL).fetchall(), key=repr) == brute(CASES[case])


def test_what_a_reducer_gets_does_not_grow(spark):
    columns = np.random.default_rng(1).integers(-300, 300, (16, 4, 1000))
    books = columns[:, :, :64].transpose(0, 2, 1).copy()
    one = V._added(None, columns, books)
    two = V._merged(one, V._added(None, np.concatenate([columns] * 3, 2), books))
    assert [x.nbytes for x in one] == [x.nbytes for x in two] == [16 * 64 * 4 * 8, 16 * 64 * 8]
    assert (two[0] == 4 * one[0]).all() and (two[1] == 4 * one[1]).all()
