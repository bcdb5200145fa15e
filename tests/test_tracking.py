import numpy as np
import pytest

from sensorloom.operators import detections
from sensorloom.operators import tracking as T
from sensorloom.plans import catalog
from sensorloom.streaming import processors

SCHEMA = "session long, frame long, id long, x1 double, y1 double, x2 double, y2 double"


def scene(seed, frames=40, n=5, lost=0.0):
    """Things that move at constant speed, crossing; (frame, id, box) and whose each box is."""
    rng = np.random.default_rng(seed)
    place, speed = rng.uniform(0, 400, (n, 2)), rng.uniform(-6, 6, (n, 2))
    rows, truth, k = [], {}, 0
    for f in range(frames):
        for i in rng.permutation(n):
            if rng.random() >= lost:
                x, y = place[i] + speed[i] * f + rng.normal(size=2) * 0.5
                rows.append((f, k, x - 10, y - 5, x + 10, y + 5))
                truth[k] = i
            k += 1
    return rows, truth


def frame(spark, rows, session=1):
    return spark.createDataFrame([(session, f, i, *map(float, b)) for f, i, *b in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "lost"), [(1, 0.0), (2, 0.0), (3, 0.1)])
def test_each_thing_is_one_track(spark, seed, lost):
    rows, truth = scene(seed, lost=lost)
    got = T.tracked(frame(spark, rows).repartition(3), ["session"]).toPandas()
    assert sorted(got["box"]) == sorted(truth)
    of = {}
    for t, b in zip(got["track"], got["box"], strict=True):
        of.setdefault(t, []).append(truth[b])
    assert sum(len(set(v)) == 1 for v in of.values()) == len(of) and len(of) == 5
    assert got["opened"].sum() == 5


def test_tracks_do_not_hang_on_the_order_of_boxes(spark):
    rows, _ = scene(5, lost=0.2)
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    one, two = (sorted(map(tuple, T.tracked(frame(spark, r), ["session"]).collect())) for r in (rows, shuffled))
    assert one == two


def test_gates_and_misses(spark):
    box = lambda f, i, x: (f, i, x - 1.0, 0.0, x + 1.0, 2.0)
    rows = [box(0, 0, 0), box(1, 1, 1), box(2, 2, 500), box(4, 3, 4), box(9, 4, 9), box(10, 5, 10)]
    got = {r["box"]: (r["track"], r["opened"]) for r in T.tracked(frame(spark, rows), ["session"]).collect()}
    # The far box is a new track; track 0 misses two frames and goes on; after more than that it is closed.
    assert got == {0: (0, True), 1: (0, False), 2: (1, True), 3: (0, False), 4: (2, True), 5: (2, False)}


def test_the_filter_is_that_of_matrices():
    rng = np.random.default_rng(7)
    s = T.Settings(gate=1e6)
    tracker, x, p = T.Tracker(s), None, None
    f, g = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[0.5], [1.0]])
    for k in range(30):
        z = np.array([3.0 * k, -k]) + rng.normal(size=2)
        row = tracker.step(k, np.array([k]), np.array([[z[0] - 2, z[1] - 1, z[0] + 2, z[1] + 1]]))[0]
        if x is None:
            x, p = np.array([z, [0.0, 0.0]]), np.diag([s.seen**2, s.speed**2])
        else:
            x, p = f @ x, f @ p @ f.T + s.push**2 * g @ g.T
            gain = p[:, :1] / (p[0, 0] + s.seen**2)
            x, p = x + gain @ (z - x[0])[None], p - gain @ p[:1]
        assert np.allclose(row[3:5], x[0])


def test_a_stream_gives_the_same_tracks(spark, tmp_path):
    rows, _ = scene(9, frames=30, lost=0.15)
    df = frame(spark, rows).unionByName(frame(spark, scene(10, frames=30)[0], session=2))
    for part in range(3):
        df.filter(f"frame div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = processors.replayed(T.tracked_stream(stream, idle_ms=None), "tracks").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, T.tracked(df, ["session"]).collect()))


def test_nothing_to_track(spark):
    assert T.tracked(frame(spark, [(0, 0, 1, 1, 2, 2)]).limit(0), ["session"]).collect() == []
    odd = spark.createDataFrame([(1, None, 1, 0.0, 0.0, 1.0, 1.0), (1, 0, 2, None, 0.0, 1.0, 1.0), (None, 0, 3, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    assert [tuple(r) for r in T.tracked(odd, ["session"]).collect()] == [(None, 0, 0, 3, 0.5, 0.5, True)]


def test_pairs_without_a_choice_need_no_assignment(monkeypatch):
    """Pairs by the short way are those of the assignment; where no two allowed pairs share a side, it isn't asked."""
    rng, asked = np.random.default_rng(11), []
    monkeypatch.setattr(T, "assignment", lambda cost: asked.append(1) or detections.assignment(cost))
    shared = 0
    for _ in range(300):
        far = rng.uniform(0, 40, rng.integers(0, 5, 2))
        allowed = far <= 9
        got = [x.tolist() for x in T._paired(far, allowed, 9.0)]
        of = detections.assignment(np.where(allowed, far, 10.0 * (min(far.shape) + 1))) if far.size else np.full(len(far), -1)
        at = [i for i, j in enumerate(of.tolist()) if j >= 0 and allowed[i, j]]
        assert got == [at, of[at].tolist()]
        shared += bool((allowed.sum(0) > 1).any() or (allowed.sum(1) > 1).any())
    assert len(asked) == shared < 300


def test_boxes_of_a_repeated_event_id_are_boxes_once(spark, tmp_path):
    """An event id that two users have makes a box for each, not one for each pair of rows."""
    rows = [(7, u, float(40 * u), 1704067200 + 86400 * d) for u in (1, 2) for d in (0, 1)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, s long").selectExpr("event_id", "user_id", "'view' AS event_type", "value", "timestamp_seconds(s) AS ts")
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.queries()["v15_tracks"](spark, str(tmp_path)).count() == 4
