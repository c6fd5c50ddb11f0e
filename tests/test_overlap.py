"""Many pairs of boxes at once, and suppression by rounds, against one pair and one box after the other."""

import numpy as np
import pytest
from kerbside import queries as Q
from kerbside.functions import geometry as G
from kerbside.operators import nms

BOXES = "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double"


def some(rng, n, wide=60.0):
    return np.column_stack([rng.uniform(0, wide, (n, 2)), rng.uniform(0.2, 30, (n, 2)), rng.choice([0, 90, 180, -90, 30, 45.5, 17.3, -80, 361], n)])


def test_many_pairs_as_one_after_the_other():
    rng = np.random.default_rng(0)
    a, b = some(rng, 100_000), some(rng, 100_000)
    b[:2000] = a[:2000]  # the same box, a box within another, and a shared side
    b[2000:4000] = a[2000:4000]
    b[2000:4000, 2:4] /= 3
    b[4000:6000] = a[4000:6000]
    b[4000:6000, 0] += a[4000:6000, 2]
    a[6000:6005, 0], b[6005:6010, 3] = np.nan, np.inf
    got = G.rotated_ious(a, b, 1.0)
    step = 5  # the pairwise version is slow: a fifth of the random pairs, and all of the odd ones
    for i in [*range(0, 6010), *range(6010, len(a), step)]:
        assert abs(got[i] - G.rotated_iou(a[i], b[i], 1.0)) < 1e-9
    assert np.allclose(got[:2000][a[:2000, 2:4].min(1) >= 1], 1)


def test_polygons_with_more_corners():
    rng = np.random.default_rng(1)

    def polygon(n):
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        return np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(2, 9) + rng.uniform(-4, 4, 2)

    p, q = np.array([polygon(7) for _ in range(300)]), np.array([polygon(5) for _ in range(300)])
    assert np.allclose(G.convex_ious(p, q), [G.convex_iou(x, y) for x, y in zip(p, q, strict=True)])
    assert G.convex_ious(p[:0], q[:0]).shape == (0,)


def greedy(boxes, scores, threshold, rotated):
    stay, spans = [], G.aabb(boxes)
    for i in np.argsort(-scores, kind="stable"):
        def over(j, i=i):
            if not G.aabb_overlap(spans[[i]], spans[[j]])[0, 0]:
                return False
            if rotated:
                return G.rotated_iou(boxes[j], boxes[i]) > threshold
            lo, hi = np.maximum(spans[i, :2], spans[j, :2]), np.minimum(spans[i, :2] + spans[i, 2:], spans[j, :2] + spans[j, 2:])
            both = (hi - lo).prod()
            return both / (spans[i, 2:].prod() + spans[j, 2:].prod() - both) > threshold

        if not any(over(j) for j in stay):
            stay.append(i)
    return stay


@pytest.mark.parametrize("rotated", [True, False])
@pytest.mark.parametrize("at_once", [1 << 20, 500])
def test_survivors(monkeypatch, rotated, at_once):
    monkeypatch.setattr(nms, "PAIRS", at_once)
    rng = np.random.default_rng(3)
    boxes, scores = some(rng, 250, 120.0), rng.integers(0, 20, 250) / 20
    assert nms.survivors(boxes, scores, 0.2, rotated).tolist() == greedy(boxes, scores, 0.2, rotated)
    assert nms.survivors(boxes[:0], scores[:0], 0.2, rotated).tolist() == []


@pytest.mark.parametrize("rotated", [True, False])
def test_rounds_keep_what_greedy_keeps(spark, rotated):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for frame, (n, wide) in enumerate([(1, 9.0), (60, 60.0), (2000, 900.0)], 1):
        boxes, scores = some(rng, n, wide), rng.integers(0, 50, n) / 50
        if n == 60:
            boxes[5, 2:4] = 900  # one that spans many cells
        want |= {(frame, int(i)) for i in nms.survivors(boxes, scores, 0.2, rotated)}
        rows += [("s", frame, i, *map(float, boxes[i]), float(scores[i])) for i in range(n)]
    rows.append(("s", 2, 60, float("nan"), 1.0, 1.0, 1.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, BOXES)
    got = nms.suppress_by_rounds(df, 0.2, rotated)
    assert got.columns == df.columns and {(r.frame_id, r.det_idx) for r in got.collect()} == want | {(2, 60)}
    assert nms.suppress_by_rounds(df.limit(0), 0.2, rotated).count() == 0


@pytest.mark.parametrize(("name", "rotated"), [("nms_rotated", True), ("nms_axis_aligned", False)])
def test_registered_suppression(spark, name, rotated):
    frames = {}
    for r in Q._image(spark, "/root/testdata/sf0.001").collect():
        frames.setdefault(r.frame_id, []).append(r)
    want = set()
    for frame, found in frames.items():
        found.sort(key=lambda r: r.det_idx)
        stay = greedy(np.array([[r.cx, r.cy, r.w, r.h, r.angle] for r in found]), np.array([r.confidence for r in found]), 0.1, rotated)
        want |= {(frame, found[i].det_idx) for i in stay}
    assert {(r.frame_id, r.det_idx) for r in Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()} == want
