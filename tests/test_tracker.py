"""Scenes whose identities are worked out by hand, and brute-force versions of the parts."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kerbside.operators import tracker as module
from kerbside.operators.tracker import Motion, Settings, Tracker, Trackers, assign, assign_groups, costs, track
from pyspark.sql import functions as F


def run(frames, settings=None):
    """frames: for each processed frame a list of (cx, cy[, confidence[, class]]) of 40 x 20 boxes; the ids of each."""
    t, out = Tracker(settings or Settings()), []
    for n, frame in enumerate(frames, 1):
        full = [(*f, *(0.9, 0)[len(f) - 2 :]) for f in frame]
        boxes = np.array([[x, y, 40, 20, 0] for x, y, _, _ in full], np.float32).reshape(-1, 5)
        out.append(t.update(n, boxes, np.array([c for *_, c, _ in full]), np.array([k for *_, k in full], int)).tolist())
    return out


def test_birth():
    assert run([[(10 + 2 * i, 5)] for i in range(5)]) == [[-1], [-1], [1], [1], [1]]


def test_below_birth_threshold():
    assert run([[(10, 5, 0.55)]] * 5) == [[-1]] * 5


def test_one_hit_is_enough():
    assert run([[(10, 5)]] * 2, Settings(min_hits=1)) == [[1], [1]]


def test_two_objects_keep_their_ids():
    a, b = (10, 5), (500, 5)
    assert run([[a, b]] * 4 + [[b, a]]) == [[-1, -1], [-1, -1], [1, 2], [1, 2], [2, 1]]


def test_class_gate():
    assert run([[(10, 5)]] * 3 + [[(10, 5, 0.9, 1)]] * 3) == [[-1], [-1], [1], [-1], [-1], [2]]


def test_short_loss():
    assert run([[(10, 5)]] * 3 + [[]] * 29 + [[(10, 5)]])[-1] == [1]


def test_expiry_boundary():
    assert run([[(10, 5)]] * 3 + [[]] * 30 + [[(10, 5)]])[-1] == [1]
    assert run([[(10, 5)]] * 3 + [[]] * 31 + [[(10, 5)]] * 3)[-3:] == [[-1], [-1], [2]]


def test_low_score_rescue():
    assert run([[(10, 5)]] * 3 + [[(12, 5, 0.4)]])[-1] == [1]
    assert run([[(10, 5)]] * 3 + [[(30, 5, 0.4)]])[-1] == [-1]  # overlap of a third: not enough for a low score


def test_gap_is_one_step():
    t = Tracker()
    for n in (1, 2, 3, 10):
        ids = t.update(n, np.array([[10.0 + 2 * min(n, 4), 5, 40, 20, 0]]), np.array([0.9]), np.array([0]))
    assert ids.tolist() == [1] and t.tracked.unseen.tolist() == [0]


def test_several_lost_at_once():
    many = [(200 * i, 5) for i in range(5)]
    out = run([many] * 3 + [[many[0], many[3]]] + [many])
    assert out[3] == [1, 4] and out[4] == [1, 2, 3, 4, 5]


def test_not_a_gated_assignment():
    assert assign(np.array([[0.81, 0.79], [1.0, 0.81]], np.float32), 0.8) == []


def test_same_frame_revival(monkeypatch):
    """Stage 1 matches nothing; a low detection takes C; A is lost and found again with y in the same frame."""
    from kerbside.operators import tracker as module

    one = {"box": [0, 0, 9, 9, 0], "class_id": 0, "frame_id": 3, "motion": [0.0] * 8 + [1.0] * 4 + [0.0] * 4 + [1e4] * 4, "hits": 3, "unseen": 0}
    t = Tracker.load(Tracker().dump() | {"tracked": [one | {"track_id": 1}, one | {"track_id": 2}], "next_id": 3})
    tables = iter([[[0.81, 0.79], [1.0, 0.81]], [[1.0], [0.3]], [[0.81, 0.79]]])
    monkeypatch.setattr(module, "costs", lambda *a: np.array(next(tables), np.float32))
    ids = t.update(4, np.array([[0, 0, 9, 9, 0], [1, 0, 9, 9, 0], [2, 0, 9, 9, 0]]), np.array([0.55, 0.55, 0.4]), np.zeros(3, int))
    assert ids.tolist() == [-1, 1, 2] and sorted(t.tracked.track_id) == [1, 2] and not len(t.lost)


def test_non_finite_boxes():
    out = run([[(10, 5)], [(float("nan"), 5)], [(10, 5)]])
    assert out == [[-1], [-1], [-1]]


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_assignment_against_all_permutations(n, m, seed):
    c = np.random.default_rng(seed).random((n, m)).astype(np.float32)
    size = max(n, m)
    full = np.full((size, size), np.float32(0.8))
    full[:n, :m] = c
    best = min(itertools.permutations(range(size)), key=lambda p: sum(float(full[i, j]) for i, j in enumerate(p)))
    total = sum(float(full[i, j]) for i, j in enumerate(best))
    got = assign(c, 0.8)
    assert all(c[i, j] < np.float32(0.8) for i, j in got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    second = sorted(sum(float(full[i, j]) for i, j in enumerate(p)) for p in itertools.permutations(range(size)))
    if len(second) < 2 or second[1] - total > 1e-4:
        assert sorted(got) == sorted((i, j) for i, j in enumerate(best) if i < n and j < m and c[i, j] < np.float32(0.8))


def test_motion_against_matrices():
    rng = np.random.default_rng(0)
    f = np.eye(8) + np.eye(8, k=4)
    h, q = np.eye(4, 8), np.diag([0.01] * 4 + [0.1, 0.1, 0.01, 0.01])
    z = rng.random(4) * 100
    m, x, p = Motion(z), np.concatenate([z, np.zeros(4)]), np.diag([1.0] * 4 + [1e4] * 4)
    for _ in range(20):
        m.predict()
        x, p = f @ x, f @ p @ f.T + q
        z = rng.random(4) * 100
        m.correct(z)
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 0.1 * np.eye(4))
        x, p = x + k @ (z - h @ x), (np.eye(8) - k @ h) @ p
        assert np.allclose(np.concatenate([m.x, m.v]), x) and np.allclose(m.pvv, np.diag(p)[4:])


def test_state_survives_a_dump():
    a = Tracker()
    for n in range(1, 4):
        a.update(n, np.array([[10.0 * n, 5, 40, 20, 30]]), np.array([0.9]), np.array([0]))
    b = Tracker.load(a.dump())
    box = np.array([[40.0, 5, 40, 20, 30]])
    assert a.update(4, box, np.array([0.9]), np.array([0])).tolist() == b.update(4, box, np.array([0.9]), np.array([0])).tolist() == [1]
    assert a.dump() == b.dump()


def test_costs_need_the_same_class():
    c = costs(np.array([[10, 5, 40, 20, 0]], np.float32), np.array([0]), np.array([[10, 5, 40, 20, 0], [10, 5, 40, 20, 0]], np.float32), np.array([0, 1]))
    assert c[0, 0] == pytest.approx(0) and c[0, 1] == 1


def test_batch_reads_frames_in_order(spark):
    rng = random.Random(1)
    rows = [(s, f, i, 10.0 + 2 * f, 100.0 * i, 40.0, 20.0, 0.0, 0.9, 0) for s in ("a", "b") for f in range(1, 12) for i in range(3)]
    rows += [("a", 30, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double, class_id int")
    got = {(r.session_id, r.frame_id, r.det_idx): r.track_id for r in track(df).collect()}
    assert len(got) == 66
    for s in "ab":
        for f in range(1, 12):
            assert [got[s, f, i] for i in range(3)] == ([-1] * 3 if f < 3 else [1, 2, 3])
    ids = pd.Series(got)
    assert (ids[ids > 0].groupby(level=[0, 1]).nunique() == 3).all()


def scene(rng, n):
    """A frame of so many boxes, few of them apart, some turned, of one place, or of no finite place."""
    boxes = np.column_stack([rng.choice([10, 25, 40, 70], n) + rng.normal(0, 4, n), rng.normal(0, 6, n), rng.choice([20, 40], n), rng.choice([20, 0.5], n, p=[0.9, 0.1]), rng.choice([0, 30], n)]).astype(np.float32)
    boxes[rng.random(n) < 0.2] = [40, 5, 40, 20, 0]
    boxes[rng.random(n) < 0.05, 0] = rng.choice([np.nan, np.inf])
    return boxes, rng.choice([0.3, 0.55, 0.9, np.nan], n, p=[0.3, 0.1, 0.55, 0.05]).astype(np.float32), rng.integers(0, 2, n)


@pytest.mark.parametrize("options", [{}, {"min_hits": 1}, {"max_time_lost": 2, "match_thresh": 0.95}, {"match_thresh": 1.5}])
def test_many_sessions_together_are_as_one_by_one(options):
    rng = np.random.default_rng(7)
    single, many = [Tracker(Settings(**options)) for _ in range(12)], Trackers(Settings(**options), 12)
    for n in range(60):
        frames = [scene(rng, rng.integers(0, 5 if k else 9)) for k in range(12)]
        want = np.concatenate([t.update(n + k, *f) for k, (t, f) in enumerate(zip(single, frames, strict=True))])
        owner = np.repeat(np.arange(12), [len(f[0]) for f in frames])
        assert many.update(n + np.arange(12), owner, *(np.concatenate(x) for x in zip(*frames, strict=True))).tolist() == want.tolist()
    for k, t in enumerate(single):
        one = many.taken(k)
        again = Tracker(Settings(**options), one.tracks, int(one.active.sum()), int(one.next_id[0]))
        assert repr(again.dump()) == repr(t.dump())
    assert max(t.next_id for t in single) > 5


def test_assignment_of_groups():
    rng = np.random.default_rng(3)
    shapes = [(int(a), int(b)) for a, b in rng.integers(1, 5, (200, 2))]
    tables = [np.minimum(1, rng.integers(1, 12, s) / 8).astype(np.float32) for s in shapes]
    rows, columns = (np.cumsum([0, *(s[k] for s in shapes)]) for k in (0, 1))
    cells = [(c, rows[g] + a, columns[g] + b, g) for g, t in enumerate(tables) for (a, b), c in np.ndenumerate(t)]
    cost, i, j, group = (np.array(x) for x in zip(*cells, strict=True))
    for limit in (0.5, 0.8, 2):
        got = assign_groups(cost.astype(np.float32), i, j, group, limit)
        want = {(rows[g] + a, columns[g] + b) for g, t in enumerate(tables) for a, b in assign(t, limit)}
        assert set(zip(i[got], j[got], strict=True)) == want


@pytest.mark.parametrize("held", [1, 7, 50, 1 << 16])
def test_batches_of_sessions_in_few_steps(spark, monkeypatch, held):
    """However rows are gathered, sessions come out as one by one; the steps are those of the longest, not the sum of all."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in (*"abcde", None):
        t = Tracker()
        for f in (None, *range(0, 5 + 6 * (s == "c"))):
            boxes, scores, classes = scene(rng, rng.integers(0, 4))
            ids = t.update(f or 0, boxes, scores, classes)
            rows += [(s, f, i, *map(float, b), float(c), int(k)) for i, (b, c, k) in enumerate(zip(boxes, scores, classes, strict=True))] or [(s, f, *[None] * 8)]
            want |= {(s, f, i): int(v) for i, v in enumerate(ids)}
    df = spark.createDataFrame(rows, "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double, class_id int").coalesce(1)
    steps, columns = [], [c for c in df.columns if c]
    monkeypatch.setattr(module, "HELD_ROWS", held)
    monkeypatch.setattr(Trackers, "update", lambda self, *a, f=Trackers.update: steps.append(1) or f(self, *a))
    taken = {}

    class Caught:
        """Runs the task's function here, over batches of three rows."""

        columns, schema, sparkSession = df.columns, df.schema, spark

        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            table = df.select(*columns).orderBy("session_id", "frame_id", F.col("det_idx").asc_nulls_last()).toArrow()
            for batch in run(table.to_batches(max_chunksize=3)):
                for r in batch.to_pylist():
                    taken[r["session_id"], r["frame_id"], r["det_idx"]] = r["track_id"]

    track(Caught())
    assert taken == want
    if held > len(rows):
        assert len(steps) == 12
