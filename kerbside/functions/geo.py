"""From pixels to ground metres and to longitude and latitude, as columns.

Longitude always comes before latitude. Where no origin is set it is null, not (0, 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import _c

# Fixed values of WGS84 and of the transverse Mercator series in the third flattening n (third order).
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
THIRD = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64)
TO_GRID = (THIRD / 2 - THIRD**2 * 2 / 3 + THIRD**3 * 5 / 16, THIRD**2 * 13 / 48 - THIRD**3 * 3 / 5, THIRD**3 * 61 / 240)
FROM_GRID = (THIRD / 2 - THIRD**2 * 2 / 3 + THIRD**3 * 37 / 96, THIRD**2 / 48 + THIRD**3 / 15, THIRD**3 * 17 / 480)
TO_GEODETIC = (THIRD * 2 - THIRD**2 * 2 / 3 - THIRD**3 * 2, THIRD**2 * 7 / 3 - THIRD**3 * 8 / 5, THIRD**3 * 56 / 15)
ECCENTRICITY = 2 * math.sqrt(THIRD) / (1 + THIRD)
EARTH_RADIUS = 6371000.0


@dataclass(frozen=True)
class Camera:
    """fx, fy, cx, cy and the radial and tangential coefficients k1, k2, p1, p2, k3."""

    matrix: tuple[float, ...]
    distortion: tuple[float, ...] = ()

    def __post_init__(self):
        if len(self.matrix) != 9:
            raise ValueError("a camera matrix has 9 numbers")

    def coefficient(self, i: int) -> float:
        return float(self.distortion[i]) if i < len(self.distortion) else 0.0


def perspective(x, y, h: Sequence[float]) -> Column:
    """struct<x,y> of H applied to a point; null where the third coordinate vanishes."""
    x, y = _c(x), _c(y)
    a, b, w = (x * float(h[i]) + y * float(h[i + 1]) + float(h[i + 2]) for i in (0, 3, 6))
    return F.when(F.abs(w) >= 1e-12, F.struct((a / w).alias("x"), (b / w).alias("y")))


def undistorted(x, y, camera: Camera, rounds: int = 10) -> Column:
    """struct<x,y> of a point without lens distortion, by fixed-point rounds that stay inside the JVM."""
    fx, fy, cx, cy = (float(camera.matrix[i]) for i in (0, 4, 2, 5))
    k1, k2, p1, p2, k3 = map(camera.coefficient, range(5))
    u, v = (_c(x) - cx) / fx, (_c(y) - cy) / fy

    def closer(p, _):
        q = p["x"] * p["x"] + p["y"] * p["y"]
        radial = F.lit(1.0) + q * k1 + q * q * k2 + q * q * q * k3
        cross = p["x"] * p["y"] * 2
        dx = cross * p1 + (q + p["x"] * p["x"] * 2) * p2
        dy = (q + p["y"] * p["y"] * 2) * p1 + cross * p2
        return F.struct(p["u"].alias("u"), p["v"].alias("v"), ((p["u"] - dx) / radial).alias("x"), ((p["v"] - dy) / radial).alias("y"))

    start = F.struct(u.alias("u"), v.alias("v"), u.alias("x"), v.alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, closer, lambda p: F.struct((p["x"] * fx + cx).alias("x"), (p["y"] * fy + cy).alias("y")))


def utm_zone(lon) -> Column:
    """1 to 60; the antimeridian counts to the last."""
    return F.least(F.greatest(F.floor((_c(lon) + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))


def utm_epsg(lon, lat) -> Column:
    return F.when(_c(lat) >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _series(along: Column, across: Column, weights: Sequence[float], sign: int) -> tuple[Column, Column]:
    a, b = along, across
    for j, w in enumerate(weights, 1):
        a = a + F.sin(along * 2 * j) * F.cosh(across * 2 * j) * (sign * w)
        b = b + F.cos(along * 2 * j) * F.sinh(across * 2 * j) * (sign * w)
    return a, b


def to_utm(lon, lat, zone=None) -> Column:
    """struct<easting,northing,zone,north> of a place, in its own zone or a given one."""
    lon, lat = _c(lon), _c(lat)
    z = utm_zone(lon) if zone is None else _c(zone)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * ECCENTRICITY) * ECCENTRICITY)
    away = F.radians(lon - (z * 6 - 183))
    along, across = _series(F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(t * t + 1)), TO_GRID, 1)
    north = lat >= 0
    return F.struct(
        (across * (SCALE * RADIUS) + FALSE_EAST).alias("easting"),
        (along * (SCALE * RADIUS) + F.when(north, 0.0).otherwise(FALSE_NORTH)).alias("northing"),
        z.alias("zone"),
        north.alias("north"),
    )


def from_utm(easting, northing, zone, north) -> Column:
    """struct<lon,lat> of a place on the grid."""
    along = (_c(northing) - F.when(_c(north), 0.0).otherwise(FALSE_NORTH)) / (SCALE * RADIUS)
    across = (_c(easting) - FALSE_EAST) / (SCALE * RADIUS)
    along, across = _series(along, across, FROM_GRID, -1)
    chi = F.asin(F.sin(along) / F.cosh(across))
    lat = chi
    for j, w in enumerate(TO_GEODETIC, 1):
        lat = lat + F.sin(chi * 2 * j) * w
    return F.struct((F.degrees(F.atan2(F.sinh(across), F.cos(along))) + (_c(zone) * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))


def from_ground(gx, gy, origin_lon, origin_lat) -> Column:
    """struct<lon,lat> of metres east and north of an origin; null without an origin."""
    lon, lat = _c(origin_lon), _c(origin_lat)
    o = to_utm(lon, lat)
    return F.when(lon.isNotNull() & lat.isNotNull(), from_utm(o["easting"] + _c(gx), o["northing"] + _c(gy), o["zone"], o["north"]))


def to_ground(lon, lat, origin_lon, origin_lat) -> Column:
    """struct<x,y>: metres east and north of an origin, in the origin's zone."""
    o = to_utm(origin_lon, origin_lat)
    p = to_utm(lon, lat, o["zone"])
    return F.struct((p["easting"] - o["easting"]).alias("x"), (p["northing"] - o["northing"]).alias("y"))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres over a sphere."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS)


def with_undistorted(df: DataFrame, x: str, y: str, camera: Camera, rounds: int = 10) -> DataFrame:
    """Moves the columns x, y to where they are without lens distortion; null if one of them is.

    undistorted() as steps over flat columns, which Spark compiles; a fold over structs it doesn't, and computes anew wherever
    its fields are named within a lambda. No step can be null (what isn't there goes as NaN), as tests for null would make
    the compiled method too long for the JVM.
    """
    fx, fy, cx, cy = (float(camera.matrix[i]) for i in (0, 4, 2, 5))
    k1, k2, p1, p2, k3 = map(camera.coefficient, range(5))
    number = lambda c: F.coalesce(c, F.lit(float("nan")))
    out = df.withColumns({"_known": F.col(x).isNotNull() & F.col(y).isNotNull(), "_u0": number((F.col(x) - cx) / fx), "_v0": number((F.col(y) - cy) / fy)})
    u, v = F.col("_u0"), F.col("_v0")
    for _ in range(rounds):
        out = out.withColumns({"_uu": u * u, "_vv": v * v, "_cross": u * v * 2})
        out = out.withColumn("_q", F.col("_uu") + F.col("_vv"))
        out = out.withColumn("_qq", F.col("_q") * F.col("_q"))
        q, qq, cross = F.col("_q"), F.col("_qq"), F.col("_cross")
        out = out.withColumns({"_radial": F.lit(1.0) + q * k1 + qq * k2 + qq * q * k3, "_dx": cross * p1 + (q + F.col("_uu") * 2) * p2, "_dy": (q + F.col("_vv") * 2) * p1 + cross * p2})
        out = out.withColumns({"_u": number((F.col("_u0") - F.col("_dx")) / F.col("_radial")), "_v": number((F.col("_v0") - F.col("_dy")) / F.col("_radial"))})
        u, v = F.col("_u"), F.col("_v")
    out = out.withColumns({x: F.when(F.col("_known"), u * fx + cx), y: F.when(F.col("_known"), v * fy + cy)})
    return out.drop("_known", "_u0", "_v0", "_uu", "_vv", "_cross", "_q", "_qq", "_radial", "_dx", "_dy", "_u", "_v")


def undistort_stage(detections: DataFrame, camera: Camera) -> DataFrame:
    """Moves the centres cx, cy and sets undistorted; corners and bounding boxes stay those of the image."""
    p = undistorted("cx", "cy", camera)
    return detections.withColumn("_p", p).withColumns({"cx": F.col("_p.x"), "cy": F.col("_p.y"), "undistorted": F.lit(True)}).drop("_p")


def utm_of(lon: float, lat: float) -> tuple[float, float, int, bool]:
    """easting, northing, zone and whether north, of one place, as to_utm() has them."""
    zone = min(max(math.floor((lon + 180) / 6) + 1, 1), 60)
    s = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - math.atanh(s * ECCENTRICITY) * ECCENTRICITY)
    away = math.radians(lon - (zone * 6 - 183))
    along, across = math.atan2(t, math.cos(away)), math.atanh(math.sin(away) / math.sqrt(t * t + 1))
    north = along + sum(w * math.sin(2 * j * along) * math.cosh(2 * j * across) for j, w in enumerate(TO_GRID, 1))
    east = across + sum(w * math.cos(2 * j * along) * math.sinh(2 * j * across) for j, w in enumerate(TO_GRID, 1))
    return east * (SCALE * RADIUS) + FALSE_EAST, north * (SCALE * RADIUS) + (0.0 if lat >= 0 else FALSE_NORTH), zone, lat >= 0


def with_places(df: DataFrame, origin: tuple[float, float], x: str = "ground_x", y: str = "ground_y") -> DataFrame:
    """Adds lon, lat of metres east and north of an origin.

    from_ground() as steps: each names the columns of the one before, of which Spark computes each once. As one
    expression, the terms of the series would hold each other and multiply, at no cost in running, but in planning.
    """
    east, north, zone, upper = utm_of(*map(float, origin))
    out = df.withColumns({"_along": (F.col(y) + (north - (0.0 if upper else FALSE_NORTH))) / (SCALE * RADIUS), "_across": (F.col(x) + (east - FALSE_EAST)) / (SCALE * RADIUS)})
    a, b = _series(F.col("_along"), F.col("_across"), FROM_GRID, -1)
    out = out.withColumns({"_a": a, "_b": b})
    out = out.withColumn("_chi", F.asin(F.sin("_a") / F.cosh("_b")))
    lat = F.col("_chi")
    for j, w in enumerate(TO_GEODETIC, 1):
        lat = lat + F.sin(F.col("_chi") * 2 * j) * w
    return out.withColumns({"lon": F.degrees(F.atan2(F.sinh("_b"), F.cos("_a"))) + (zone * 6 - 183), "lat": F.degrees(lat)}).drop("_along", "_across", "_a", "_b", "_chi")


def geo_stage(detections: DataFrame, homography: Sequence[float], origin: tuple[float, float] | None = None, camera: Camera | None = None, pixel_scale: float = 1.0) -> DataFrame:
    """Adds ground_x, ground_y, lon, lat of the centres cx, cy; these are undistorted first unless they have been.

    pixel_scale turns the detections' pixels into those that the homography was found with.
    """
    # flat columns at each step, which Spark computes once however often the next step names them
    out = detections.withColumns({"_x": F.col("cx") * float(pixel_scale), "_y": F.col("cy") * float(pixel_scale)})
    if camera is not None:
        done = F.coalesce(F.col("undistorted"), F.lit(False)) if "undistorted" in detections.columns else F.lit(False)
        out = out.withColumn("_u", undistorted("_x", "_y", camera))
        out = out.withColumns({k: F.when(done, F.col(k)).otherwise(F.col(f"_u.{k[1]}")) for k in ("_x", "_y")}).drop("_u")
    out = out.withColumn("_g", perspective("_x", "_y", homography)).withColumns({"ground_x": F.col("_g.x"), "ground_y": F.col("_g.y")}).drop("_x", "_y", "_g")
    if origin is None:
        return out.withColumns({k: F.lit(None).cast("double") for k in ("lon", "lat")})
    return with_places(out, origin)


def ground_corners(corners, homography: Sequence[float], camera: Camera | None = None) -> Column:
    """Image corners, array<struct<x,y>>, on the ground."""
    flat = _c(corners)
    if camera is not None:  # on its own, so that a corner is undistorted once
        flat = F.transform(flat, lambda p: undistorted(p["x"], p["y"], camera))
    return F.transform(flat, lambda p: perspective(p["x"], p["y"], homography))


def each_corner_on_ground(df: DataFrame, corners, homography: Sequence[float], camera: Camera | None = None) -> DataFrame:
    """A row for each corner, of which corner is the number from 1 on: adds corner, x, y as ground_corners() has them, null without a place."""
    out = df.select("*", F.posexplode(_c(corners)).alias("_i", "_c")).withColumns({"corner": F.col("_i") + 1, "x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_i", "_c")
    if camera is not None:
        out = with_undistorted(out, "x", "y", camera)
    a, b, w = (F.col("x") * float(homography[i]) + F.col("y") * float(homography[i + 1]) + float(homography[i + 2]) for i in (0, 3, 6))
    out = out.withColumns({"_a": a, "_b": b, "_w": w})
    return out.withColumns({k: F.when(F.abs("_w") >= 1e-12, F.col(f"_{n}") / F.col("_w")) for k, n in (("x", "a"), ("y", "b"))}).drop("_a", "_b", "_w")
