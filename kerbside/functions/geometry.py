"""Boxes, corners and polygons, as columns; convex overlap, as numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def _field(name: str):
    return lambda p: p[name]


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def obb_corners(cx, cy, w, h, angle_deg) -> Column:
    """The four corners of a rotated box, as array<struct<x,y>>; the third and fourth mirror the first two."""
    cx, cy, w, h = map(_c, (cx, cy, w, h))
    theta = F.radians(_c(angle_deg))
    along, across = F.cos(theta) / 2, F.sin(theta) / 2
    x0, y0 = cx - across * h - along * w, cy + along * h - across * w
    x1, y1 = cx + across * h - along * w, cy - along * h - across * w
    return F.array(point(x0, y0), point(x1, y1), point(cx * 2 - x0, cy * 2 - y0), point(cx * 2 - x1, cy * 2 - y1))


def bounding_box(corners) -> Column:
    """struct<x,y,w,h: int> of the pixels that the corners span."""
    c = _c(corners)
    low = {k: F.floor(F.array_min(F.transform(c, _field(k)))).cast("int") for k in "xy"}
    high = {k: F.ceil(F.array_max(F.transform(c, _field(k)))).cast("int") for k in "xy"}
    return F.struct(low["x"].alias("x"), low["y"].alias("y"), (high["x"] - low["x"] + 1).alias("w"), (high["y"] - low["y"] + 1).alias("h"))


def rect_corners(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def four_corners(points) -> Column:
    """The first four of four or more points; of fewer, the corners of their bounding box; null of none."""
    p = _c(points)
    ends = [f(F.transform(p, _field(k))) for k in "xy" for f in (F.array_min, F.array_max)]
    return F.when(F.size(p) >= 4, F.slice(p, 1, 4)).when(F.size(p) > 0, rect_corners(ends[0], ends[2], ends[1], ends[3]))


def centre(corners) -> Column:
    """The mean of some points, as struct<x,y>."""
    c = _c(corners)
    total = F.aggregate(c, point(0.0, 0.0), lambda a, p: point(a["x"] + p["x"], a["y"] + p["y"]))
    return F.when(F.size(c) > 0, point(total["x"] / F.size(c), total["y"] / F.size(c)))


def edges(polygon) -> Column:
    """The sides of a polygon, array<struct<a,b>>; each begins at the corner before."""
    p = _c(polygon)
    return F.zip_with(p, F.concat(F.slice(p, -1, 1), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(x, y, polygon, inclusive: bool = False) -> Column:
    """Even-odd rule with half-open edges; inclusive: points on an edge or corner are inside too. False with fewer than three corners."""
    x, y, p = _c(x), _c(y), _c(polygon)
    sides = edges(p)

    def crosses(e):
        a, b = e["a"], e["b"]
        return F.when((a["y"] > y) != (b["y"] > y), x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    def touches(e):
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    inside = F.aggregate(sides, F.lit(False), lambda odd, e: odd != crosses(e))
    if inclusive:
        inside = inside | F.exists(sides, touches)
    return (F.size(p) >= 3) & inside


def polygon_literal(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*(point(float(x), float(y)) for x, y in points))


def box_iou(a: str, b: str) -> Column:
    """Overlap over union of the two structs' x, y, w, h."""
    p, q = F.col(a), F.col(b)
    wide = F.greatest(F.lit(0), F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"]))
    high = F.greatest(F.lit(0), F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]))
    both = (wide * high).cast("double")
    union = p["w"] * p["h"] + q["w"] * q["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


# Numpy, for the parts that pair boxes within a frame.


def corners_of(boxes: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) of boxes (n, 5: cx, cy, w, h, degrees), in one direction round."""
    b = np.asarray(boxes, float).reshape(-1, 5)
    t = np.radians(b[:, 4])
    u = np.column_stack([np.cos(t), np.sin(t)]) * b[:, 2:3] / 2
    v = np.column_stack([-np.sin(t), np.cos(t)]) * b[:, 3:4] / 2
    c = b[:, :2]
    return np.stack([c - u - v, c + u - v, c + u + v, c - u + v], axis=1)


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def convex_intersection(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The part of convex polygon p within convex polygon q: p is cut by each side of q in turn."""
    centre_ = q.mean(0)
    for a, b in zip(q, np.roll(q, -1, axis=0), strict=True):
        if not len(p):
            break
        normal = np.array([a[1] - b[1], b[0] - a[0]])
        if normal @ (centre_ - a) < 0:
            normal = -normal
        d = (p - a) @ normal
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if d[i] >= 0:
                out.append(p[i])
            if (d[i] > 0 > d[j]) or (d[i] < 0 < d[j]):
                out.append(p[i] + (p[j] - p[i]) * (d[i] / (d[i] - d[j])))
        p = np.array(out).reshape(-1, 2)
    return p


def convex_iou(p: np.ndarray, q: np.ndarray) -> float:
    both = polygon_area(convex_intersection(p, q))
    union = polygon_area(p) + polygon_area(q) - both
    return both / union if union > 0 else 0.0


def rotated_iou(a: np.ndarray, b: np.ndarray, least_side: float = 0.0) -> float:
    """Overlap over union of two boxes (cx, cy, w, h, degrees); 0 if one isn't finite or has a side under least_side."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()) or min(a[2], a[3], b[2], b[3]) < least_side:
        return 0.0
    if a[4] % 180 == 0 and b[4] % 180 == 0:
        wide = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
        high = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
        both = max(0.0, wide) * max(0.0, high)
        union = a[2] * a[3] + b[2] * b[3] - both
        return both / union if union > 0 else 0.0
    p, q = corners_of(np.stack([a, b]))
    return convex_iou(p, q)


def convex_intersections(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common parts of many pairs of convex polygons, (n, a, 2) and (n, b, 2): corners (n, k, 2) and how many each has.

    All of p are cut by the first side of q at a time, then by the second, and so on. Unused places repeat a polygon's
    first corner, which adds nothing to its area.
    """
    rows = np.arange(len(p))[:, None]
    count = np.full(len(p), p.shape[1])
    middle = q.mean(1)
    for k in range(q.shape[1]):
        a, b = q[:, k], q[:, (k + 1) % q.shape[1]]
        normal = np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]], 1)
        normal[((middle - a) * normal).sum(1) < 0] *= -1
        places = np.arange(p.shape[1])
        used = places < count[:, None]
        after = np.where(places + 1 < count[:, None], places + 1, 0)
        d = ((p - a[:, None]) * normal[:, None]).sum(2)
        d_after, p_after = d[rows, after], p[rows, after]
        stays, crosses = used & (d >= 0), used & (np.sign(d) * np.sign(d_after) < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = p + (p_after - p) * np.where(crosses, d / (d - d_after), 0)[:, :, None]
        # after each corner that stays, the point where its side leaves or comes in
        points = np.stack([p, cut], 2).reshape(len(p), 2 * p.shape[1], 2)
        keep = np.stack([stays, crosses], 2).reshape(len(p), points.shape[1])
        count = keep.sum(1)
        order = np.argsort(~keep, 1, kind="stable")[:, : max(1, count.max(initial=1))]
        p = points[rows, order]
        p = np.where((np.arange(p.shape[1]) < count[:, None])[:, :, None], p, p[:, :1])
    return p, count


def polygon_areas(p: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """Of polygons (n, k, 2); those with a count under 3 have none."""
    x, y = p[:, :, 0] - p[:, :1, 0], p[:, :, 1] - p[:, :1, 1]
    area = np.abs((x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)) / 2
    return area if count is None else np.where(count >= 3, area, 0.0)


def convex_ious(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Overlap over union of many pairs of convex polygons, (n, a, 2) and (n, b, 2)."""
    both = polygon_areas(*convex_intersections(p, q))
    union = polygon_areas(p) + polygon_areas(q) - both
    return np.divide(both, union, out=np.zeros(len(p)), where=union > 0)


#: Pairs that are cut at a time.
PAIRS = 1 << 14


def rotated_ious(a: np.ndarray, b: np.ndarray, least_side: float = 0.0) -> np.ndarray:
    """rotated_iou() of many pairs of boxes, (n, 5) each, without a call per pair."""
    a, b = np.asarray(a, float).reshape(-1, 5), np.asarray(b, float).reshape(-1, 5)
    out = np.zeros(len(a))
    fine = np.isfinite(a).all(1) & np.isfinite(b).all(1)
    fine[fine] = np.minimum(a[fine, 2:4], b[fine, 2:4]).min(1) >= least_side
    straight = fine.copy()
    straight[fine] = (a[fine, 4] % 180 == 0) & (b[fine, 4] % 180 == 0)
    if straight.any():
        p, q = a[straight], b[straight]
        sides = np.minimum(p[:, :2] + p[:, 2:4] / 2, q[:, :2] + q[:, 2:4] / 2) - np.maximum(p[:, :2] - p[:, 2:4] / 2, q[:, :2] - q[:, 2:4] / 2)
        both = np.maximum(sides, 0).prod(1)
        union = p[:, 2:4].prod(1) + q[:, 2:4].prod(1) - both
        out[straight] = np.divide(both, union, out=np.zeros(len(p)), where=union > 0)
    turned = np.flatnonzero(fine & ~straight)
    for i in range(0, len(turned), PAIRS):
        at = turned[i : i + PAIRS]
        out[at] = convex_ious(corners_of(a[at]), corners_of(b[at]))
    return out


def aabb(boxes: np.ndarray) -> np.ndarray:
    """Integer x, y, w, h of the pixels that each box spans."""
    c = corners_of(boxes)
    low, high = np.floor(c.min(1)), np.ceil(c.max(1))
    return np.column_stack([low, high - low + 1])


def aabb_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the spans a overlap which of b."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    return (hi > lo).all(2)
