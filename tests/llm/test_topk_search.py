import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import topk_search as K


def brute(rows, k):
    ok = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = {}
    for q, a in ok:
        if q % 100 == 0:
            found.setdefault(q, []).extend((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in ok if i != q)
    return sorted((q, r + 1, i, -s) for q, scored in found.items() for r, (s, i) in enumerate(sorted(scored)[:k]))


@pytest.mark.parametrize(("n", "copies"), [(700, 0), (500, 400), (5, 0), (0, 0)])
def test_against_all_pairs(spark, n, copies):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * 2 + rng.normal(size=8) * 0.1]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(copies)]
    rows += [(5000, None), (5100, [float("nan")] * 8), (5200, [1.0, None] + [0.0] * 6), (5300, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", "embedding", F.lit(1).alias("pivot"), F.lit("x").alias("score"))
    got = K.top_k(df, F.col("vec_id") % 100 == 0, pivots=16, block_rows=64)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for spread, shift in ((0.05, 0.0), (1.0, 0.0), (0.3, 3.0)):
        x = np.round(1000 * (rng.normal(size=(5, 6))[rng.integers(0, 5, 400)] + spread * rng.normal(size=(400, 6)) + shift))
        centres = x[:20]
        directions = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        groups = []
        for p in np.unique(near):
            mine = x[near == p]
            along = mine @ directions[p]
            off = np.sqrt(np.maximum((mine**2).sum(1) - along**2, 0)).max()
            groups.append({"pivot": p, "low": along.min(), "high": along.max(), "off": off, "norm": np.linalg.norm(mine, axis=1).max(), "radius": np.linalg.norm(mine - centres[p], axis=1).max()})
        upper = K._Bounds(centres, directions, groups).upper(np.concatenate([x, -x]))
        scores = np.concatenate([x, -x]) @ x.T
        assert (scores <= upper[:, near]).all()


def pairs_share(spark, rows):
    compared = spark.sparkContext.accumulator(0)
    K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, compared=compared).collect()
    return compared.value / (len(rows) * sum(i % 100 == 0 for i, _ in rows))


def test_most_pairs_of_clusters_are_skipped(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    unit = lambda v: [float(x) for x in v / np.linalg.norm(v)]
    rows = [(i, unit(centres[i % 40] + 0.1 * rng.normal(size=32))) for i in range(4000)]
    assert pairs_share(spark, rows) < 0.3


def test_different_vectors_of_one_id(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300) for _ in range(3)]
    rows += [(0, [1.0] + [0.0] * 7), (1, [5.0] + [0.0] * 7), (1, [1.0] + [0.0] * 7)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(5)
        got = K.top_k(df, F.col("vec_id") % 100 == 0, pivots=16, block_rows=64)
        assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_large_components(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 18)]) for i in range(230)]
    rows += [(300, [1e300, 0.0, -1e300, 1.7e308]), (301, [3.0, 1e308, 0.0, 0.0]), (400, [123456.7] * 4), (401, [1e6] * 4)]
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, pivots=16, block_rows=64)
    big = [(i, [min(max(x, -1.75e305), 1.75e305) for x in v]) for i, v in rows]  # past a double's range all scores are a long's end anyway
    assert sorted(map(tuple, got.collect())) == brute(big, 10)


@pytest.mark.parametrize("rows", [[(0, []), (100, []), (3, [])], [(0, []), (1, [2.0, -1.0]), (100, [0.5, 0.5]), (7, [])]])
def test_empty_vectors_are_zeros(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    padded = [(i, v or [0.0, 0.0]) for i, v in rows]
    assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 100 == 0).collect())) == brute(padded, 10)
