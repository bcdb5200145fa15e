import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import detections, fitting


def planted(seed=3, n=3000):
    rng = np.random.default_rng(seed)
    shares, means = [0.5, 0.3, 0.2], np.array([[0.0, 0.0], [6.0, 1.0], [-3.0, 7.0]])
    roots = [np.array([[1.0, 0.0], [0.4, 0.6]]), np.array([[0.5, 0.0], [-0.3, 0.9]]), np.array([[0.8, 0.0], [0.0, 0.3]])]
    of = rng.choice(3, n, p=shares)
    x = np.array([means[k] + roots[k] @ rng.normal(size=2) for k in of])
    return x, of, shares, means, [r @ r.T for r in roots]


def table(spark, x):
    rows = [(float(a), float(b)) for a, b in x] + [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    return fitting.matrix_rows(spark.createDataFrame(rows, "a double, b double").repartition(4), [F.col("a"), F.col("b")])


def test_clusters_are_where_they_were_planted(spark):
    x, of, _, means, _ = planted()
    rows = table(spark, x)
    found = fitting.clusters(rows, 3)
    order = np.lexsort(means.T[::-1])
    for (centre, radius), k in zip(found, order, strict=True):
        own = x[np.argmin(((x[:, None] - np.array([c for c, _ in found])[None]) ** 2).sum(2), 1) == [c for c, _ in found].index(centre)]
        assert np.allclose(centre, own.mean(0)) and np.allclose(centre, means[k], atol=0.2)
        assert radius == pytest.approx(np.linalg.norm(own - centre, axis=1).max())
    assert len(fitting.clusters(rows, 12, rounds=3)) == 12


def test_seeds_are_spread(spark):
    x = np.concatenate([np.zeros((5000, 2)), [[50.0, 0.0], [0.0, 50.0]]])  # one point holds nearly all rows
    found = fitting.seeds(table(spark, x), 3)
    assert sorted(map(tuple, found)) == [(0.0, 0.0), (0.0, 50.0), (50.0, 0.0)]
    assert fitting.seeds(table(spark, np.zeros((20, 2))), 3).tolist() == [[0.0, 0.0]]
    assert fitting.clusters(table(spark, np.zeros((0, 2))), 3) == [] and fitting.mixture(table(spark, np.zeros((0, 2))), 3).parts == []


def test_a_mixture_is_recovered_and_its_objective_never_falls(spark):
    x, _, shares, means, covariances = planted()
    found = fitting.mixture(table(spark, x), 3, rounds=30)
    assert (np.diff(found.objective) >= -1e-6).all() and len(found.objective) <= 30
    for (share, mean, covariance), k in zip(found.parts, np.lexsort(means.T[::-1]), strict=True):
        assert share == pytest.approx(shares[k], abs=0.03) and np.allclose(mean, means[k], atol=0.15) and np.allclose(covariance, covariances[k], atol=0.15)
    assert sum(p[0] for p in found.parts) == pytest.approx(1)


def test_one_round_is_that_of_plain_loops(spark):
    x = planted(n=400)[0]
    rows = table(spark, x)
    two = fitting.mixture(rows, 2, rounds=2)
    centres = np.array([c for c, _ in fitting.clusters(rows, 2)])
    spread = np.cov(x.T, bias=True)
    prior = fitting.PRIOR * len(x) * np.diag(np.diag(spread))
    start = spread / 2 + prior / len(x)
    parts = [(0.5, m, start) for m in centres]
    for _ in range(2):
        density = np.array([[p * np.exp(-0.5 * (v - m) @ np.linalg.inv(s) @ (v - m)) / (2 * np.pi * np.sqrt(np.linalg.det(s))) for p, m, s in parts] for v in x])
        assert two.objective.pop(0) == pytest.approx(np.log(density.sum(1)).sum() - 0.5 * sum(np.trace(np.linalg.inv(s) @ prior) for *_, s in parts))
        weight = density / density.sum(1, keepdims=True)
        parts = []
        for w in weight.T:
            m = w @ x / w.sum()
            parts.append((w.sum() / len(x), m, ((x - m).T * w @ (x - m) + prior) / w.sum()))
    for (share, mean, covariance), (p, m, s) in zip(two.parts, sorted(parts, key=lambda p: list(p[1])), strict=True):
        assert share == pytest.approx(p) and np.allclose(mean, m) and np.allclose(covariance, s)


def test_equal_rows_and_more_components_than_values(spark):
    x = np.concatenate([np.zeros((30, 2)), np.ones((30, 2))])
    found = fitting.mixture(table(spark, x), 5, rounds=5)
    assert len(found.parts) == 2 and all(np.isfinite(p[2]).all() for p in found.parts)
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0)], "a double, b double")
    near, far = (r[0] for r in rows.select(detections.mixture_anomaly([F.col("a"), F.col("b")], found.parts)).collect())
    assert near < far
