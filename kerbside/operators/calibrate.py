"""Homographies from pairs of image and ground points, and how good they are."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import Camera, from_ground, perspective, to_ground, undistorted

#: A control-point table beyond this isn't one.
MOST_POINTS = 100_000


class Fit(NamedTuple):
    homography: np.ndarray  # 9 numbers, the last 1
    inliers: np.ndarray
    rmse: float


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = points.mean(0)
    spread = np.sqrt(((points - middle) ** 2).sum(1)).mean() or 1.0
    k = math.sqrt(2) / spread
    t = np.array([[k, 0, -k * middle[0]], [0, k, -k * middle[1]], [0, 0, 1]])
    return (points - middle) * k, t


def solve(image: np.ndarray, ground: np.ndarray) -> np.ndarray | None:
    """The homography of four or more pairs, by the smallest singular vector of the scaled equations; None if they don't settle one."""
    image, ground = np.asarray(image, float), np.asarray(ground, float)
    if len(image) < 4:
        raise ValueError("a homography needs four pairs of points")
    (p, tp), (q, tq) = _scaled(image), _scaled(ground)
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    u = np.column_stack([p, one])
    rows = np.concatenate([np.column_stack([u, zero, -q[:, :1] * u]), np.column_stack([zero, u, -q[:, 1:] * u])])
    _, s, vt = np.linalg.svd(rows)
    if s[min(7, len(s) - 1)] < 1e-10:
        return None
    h = np.linalg.inv(tq) @ vt[-1].reshape(3, 3) @ tp
    return (h / h[2, 2]).ravel() if abs(h[2, 2]) > 1e-12 else None


def errors(h: np.ndarray, image: np.ndarray, ground: np.ndarray) -> np.ndarray:
    """Distances between ground points and where h puts their image points; 1e10 where it puts them nowhere."""
    p = np.column_stack([image, np.ones(len(image))]) @ h.reshape(3, 3).T
    fine = np.abs(p[:, 2]) >= 1e-12
    w = np.where(fine, p[:, 2], 1)
    return np.where(fine, np.hypot(p[:, 0] / w - ground[:, 0], p[:, 1] / w - ground[:, 1]), 1e10)


def ransac(image, ground, threshold: float = 3.0, rounds: int = 1000, seed: int = 0) -> Fit | None:
    """The homography, of those of random fours, with the most points within threshold (metres); of equal ones the first.

    It isn't fitted again to its inliers. rmse is that of the inliers.
    """
    image, ground = np.asarray(image, float), np.asarray(ground, float)
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds if len(image) > 4 else 1):
        four = rng.choice(len(image), 4, replace=False) if len(image) > 4 else np.arange(4)
        h = solve(image[four], ground[four])
        if h is None:
            continue
        e = errors(h, image, ground)
        if best is None or (e < threshold).sum() > best.inliers.sum():
            near = e < threshold
            best = Fit(h, near, float(np.sqrt((e[near] ** 2).mean())) if near.any() else math.inf)
    return best


def from_control_points(points: DataFrame, origin: tuple[float, float] | None = None, camera: Camera | None = None, threshold: float = 3.0, rounds: int = 1000, seed: int = 0) -> Fit | None:
    """A fit to a table image_x, image_y, lon, lat; the origin is the first point unless given. Image points are undistorted first with a camera."""
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"over {MOST_POINTS} control points")
    rows = points.select("image_x", "image_y", "lon", "lat")
    first = rows.orderBy("image_x", "image_y", "lon", "lat").first() if origin is None else None
    if origin is None and first is None:
        return None
    lon, lat = origin or (first["lon"], first["lat"])
    p = undistorted("image_x", "image_y", camera) if camera else F.struct(F.col("image_x").alias("x"), F.col("image_y").alias("y"))
    got = rows.select(p.alias("p"), to_ground("lon", "lat", F.lit(lon), F.lit(lat)).alias("g")).select("p.x", "p.y", F.col("g.x").alias("gx"), F.col("g.y").alias("gy")).collect()
    data = np.array([tuple(r) for r in got], float)
    return ransac(data[:, :2], data[:, 2:], threshold, rounds, seed) if len(data) >= 4 else None


def validate(points: DataFrame, homography: Sequence[float], origin: tuple[float, float]) -> DataFrame:
    """frame, img_x, img_y, pred_gx, pred_gy, pred_lon, pred_lat, true_gx, true_gy, true_lon, true_lat, error_m of a table frame, image_x, image_y, lon, lat."""
    lon, lat = map(F.lit, origin)
    out = points.withColumns({"_p": perspective("image_x", "image_y", homography), "_t": to_ground("lon", "lat", lon, lat)})
    out = out.withColumn("_l", from_ground("_p.x", "_p.y", lon, lat))
    return out.select(
        "frame", F.col("image_x").alias("img_x"), F.col("image_y").alias("img_y"),
        F.col("_p.x").alias("pred_gx"), F.col("_p.y").alias("pred_gy"), F.col("_l.lon").alias("pred_lon"), F.col("_l.lat").alias("pred_lat"),
        F.col("_t.x").alias("true_gx"), F.col("_t.y").alias("true_gy"), F.col("lon").alias("true_lon"), F.col("lat").alias("true_lat"),
        F.hypot(F.col("_p.x") - F.col("_t.x"), F.col("_p.y") - F.col("_t.y")).alias("error_m"),
    )


def rmse(validated: DataFrame, column: str = "error_m") -> DataFrame:
    return validated.agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rmse_m"), F.count(column).alias("points"))


def pair_distances(validated: DataFrame, pairs: DataFrame) -> DataFrame:
    """first, second, pred_m, true_m, error_m of given pairs of frames of validated points."""
    side = lambda name, key: validated.select(F.col("frame").alias(key), *(F.col(c).alias(f"{name}_{c}") for c in ("pred_gx", "pred_gy", "true_gx", "true_gy")))
    both = pairs.select("first", "second").join(side("a", "first"), "first").join(side("b", "second"), "second")
    gap = lambda k: F.hypot(F.col(f"a_{k}_gx") - F.col(f"b_{k}_gx"), F.col(f"a_{k}_gy") - F.col(f"b_{k}_gy"))
    return both.select("first", "second", gap("pred").alias("pred_m"), gap("true").alias("true_m"), F.abs(gap("pred") - gap("true")).alias("error_m"))
