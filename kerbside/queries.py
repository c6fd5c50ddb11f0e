"""Queries over the driver's tables, with DuckDB SQL that gives the same rows.

Thresholds differ from the defaults where these would keep nothing of data that holds no traffic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.adapter import OBSERVATIONS_SQL, TRACKS_SQL, boxes, observations, tracks
from kerbside.functions import geo, geometry
from kerbside.operators import calibrate, decode, kinematics, lanes, nms, tracker
from kerbside.plans import config, registry
from kerbside.sources import readers, sinks
from kerbside.streaming import connections, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def with_tracks(rest: str) -> str:
    return f"WITH {TRACKS_SQL} {rest}"


# Trajectories.

_STEP = "SELECT *, {s}(px - {f}(px) OVER w) dx, {s}(py - {f}(py) OVER w) dy, {s}(frame_time - {f}(frame_time) OVER w) dt FROM tracks WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id)"
_SPEED = """SELECT session_id, track_id, frame_id, round(CASE WHEN dt > 0 THEN sqrt(dx*dx + dy*dy) / dt END, 6) speed_px_s,
    round(CASE WHEN dt > 0 THEN CASE WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END END, 6) heading_deg FROM ({step})"""


@query(with_tracks(_SPEED.format(step=_STEP.format(s="", f="lag"))))
def speed_heading(spark, d):
    return kinematics.kinematics(tracks(spark, d)).select("session_id", "track_id", "frame_id", r("speed_px_s").alias("speed_px_s"), r("heading_deg").alias("heading_deg"))


@query(with_tracks(_SPEED.format(step=_STEP.format(s="-", f="lead"))))
def speed_export_compat(spark, d):
    return kinematics.kinematics(tracks(spark, d), compat=True).select("session_id", "track_id", "frame_id", r("speed_px_s").alias("speed_px_s"), r("heading_deg").alias("heading_deg"))


@query(
    with_tracks("""SELECT session_id, track_id, frame_id, round(path, 5) path_px, coalesce(path < 10000, false) stationary FROM (
        SELECT *, CASE WHEN row_number() OVER w >= 30 THEN sum(step) OVER (PARTITION BY session_id, track_id ORDER BY frame_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) END path
        FROM (SELECT *, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) step FROM tracks WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id))
        WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id))""")
)
def stationary(spark, d):
    return kinematics.stationary(tracks(spark, d), max_path=10000).select("session_id", "track_id", "frame_id", r("path_px", 5).alias("path_px"), "stationary")


@query(with_tracks("SELECT session_id, track_id, frame_id, px, py FROM tracks WHERE frame_id <= 500 QUALIFY row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_id DESC) <= 20"))
def trail_last_n(spark, d):
    return kinematics.trail(tracks(spark, d), 20, upto=500).select("session_id", "track_id", "frame_id", "px", "py")


@query(with_tracks("SELECT session_id, track_id, array_to_string(list_slice(list(frame_id ORDER BY frame_id), -5, -1), ' ') frames FROM tracks GROUP BY ALL"))
def trails(spark, d):
    out = kinematics.trails(tracks(spark, d), 5)
    return out.select("session_id", "track_id", F.array_join(F.transform("points", lambda p: p["frame_id"].cast("string")), " ").alias("frames"))


@query(
    with_tracks("""SELECT session_id, track_id, frame_id, CAST(sum(b) OVER (PARTITION BY session_id, track_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) segment FROM (
        SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY session_id, track_id ORDER BY frame_id) > 3 THEN 1 ELSE 0 END b FROM tracks)""")
)
def gap_segments(spark, d):
    return kinematics.segments(tracks(spark, d)).select("session_id", "track_id", "frame_id", "segment")


@query(with_tracks("SELECT session_id, track_id, max(frame_id) last_frame FROM tracks WHERE frame_id <= 600 GROUP BY ALL HAVING 600 - max(frame_id) <= 10"))
def visible_tracks(spark, d):
    return kinematics.visible(tracks(spark, d), 600)


@query(with_tracks("SELECT session_id, track_id, max(frame_id) last_frame FROM tracks GROUP BY ALL HAVING 720 - max(frame_id) <= 300"))
def unexpired_tracks(spark, d):
    return kinematics.visible(tracks(spark, d), 720, within=300)


@query(with_tracks("SELECT session_id, track_id, frame_id + 1 AS frame_id FROM tracks a WHERE frame_id < (SELECT max(frame_id) FROM tracks) AND NOT EXISTS (FROM tracks b WHERE b.track_id = a.track_id AND b.frame_id = a.frame_id + 1)"))
def missing_tracks(spark, d):
    return kinematics.missing(tracks(spark, d)).select("session_id", "track_id", "frame_id")


@query(with_tracks("SELECT session_id, track_id, frame_id, px, py FROM tracks QUALIFY row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_id DESC) = 1"))
def track_latest(spark, d):
    return kinematics.latest(tracks(spark, d)).select("session_id", "track_id", "frame_id", "px", "py")


@query(with_tracks("SELECT session_id, track_id, count(*) points, count(*) FILTER (frame_id <= 360) points_so_far FROM tracks GROUP BY ALL"))
def track_statistics(spark, d):
    return kinematics.track_counts(tracks(spark, d), 360)


@query(f"WITH {OBSERVATIONS_SQL} SELECT session_id, frame_id, count(*) objects FROM obs GROUP BY ALL")
def objects_per_frame(spark, d):
    return kinematics.objects_per_frame(observations(spark, d))


@query(f"WITH {OBSERVATIONS_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 7 WHEN event_id % 3 = 1 AND event_id % 5 = 0 THEN event_id ELSE NULL END track_id FROM obs WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 5 = 0)")
def trackless_filter(spark, d):
    o = observations(spark, d).withColumns({"track_id": F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).when(F.col("event_id") % 3 == 1, F.lit(-1)), "track_uuid": F.when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 5 == 0), F.col("event_id"))})
    return kinematics.tracked(o, "track_uuid").select("event_id", "track_id")


@query(f"WITH {OBSERVATIONS_SQL} SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN px WHEN event_id % 3 = 0 THEN py ELSE frame_id / 25.0::DOUBLE END, 6) t FROM obs")
def frame_time(spark, d):
    o = observations(spark, d).drop("frame_time").withColumns({"frame_time": F.when(F.col("event_id") % 2 == 0, F.col("px").cast("string")).otherwise("soon"), "timestamp": F.when(F.col("event_id") % 3 == 0, F.col("py").cast("string"))})
    return o.select("event_id", r(kinematics.frame_time(["frame_time", "timestamp"], 25)).alias("t"))


@query(with_tracks("SELECT session_id, track_id, frame_id FROM tracks WHERE frame_id % 5 = 0 AND frame_id > 100"))
def skipped_and_resumed(spark, d):
    return kinematics.resumed(kinematics.every(tracks(spark, d), 5), 100).select("session_id", "track_id", "frame_id")


@query("SELECT n_nationkey video, i / 10.0::DOUBLE t FROM (SELECT n_nationkey, unnest(range(CAST(greatest(0, ceil((n_nationkey / 4.0::DOUBLE - 0.05::DOUBLE) * 10)) AS BIGINT))) i FROM nation)")
def video_sample_times(spark, d):
    videos = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("video"), (F.col("n_nationkey") / 4).alias("duration"))
    return kinematics.sample_times(videos, 10).select("video", "t")


# Lanes.

LANES = [
    (1, "north", [(0, 0), (200, 0), (200, 500), (0, 500)]),
    (2, "south", [(100, 300), (400, 300), (400, 900), (250, 600), (100, 900)]),
    (3, "empty", [(480, 980), (489, 980), (489, 985)]),
    (4, "hidden", [(0, 0), (490, 0), (490, 990), (0, 990)], False),
    (6, "line", [(0, 0), (490, 0)]),
]


def _inside_sql(points) -> str:
    tests = []
    for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True):
        if yi != yj:
            tests.append(f"CAST(({yi} > py) <> ({yj} > py) AND px < ({xj - xi}) * (py - {yi}) / CAST({yj - yi} AS DOUBLE) + {xi} AS INT)")
    return f"(({' + '.join(tests)}) % 2 = 1)"


_OBSERVED = TRACKS_SQL + ", observed AS (" + " UNION ALL ".join(f"SELECT {i} lane_id, '{n}' lane_name, *, {_inside_sql(p)} inside FROM tracks" for i, n, p, *v in LANES if len(p) > 2 and v != [False]) + ")"


def with_lanes(rest: str) -> str:
    return f"WITH {_OBSERVED} {rest}"


def _observed(spark, d):
    return lanes.lane_observations(tracks(spark, d), lanes.lane_table(spark, LANES))


@query(with_lanes("SELECT lane_id, track_id, frame_id, inside FROM observed"))
def point_in_lane(spark, d):
    return _observed(spark, d).select("lane_id", "track_id", "frame_id", "inside")


def _on_edge_sql(points) -> str:
    tests = [f"(({xj - xi}) * (py - {yi}) = ({yj - yi}) * (px - {xi}) AND px BETWEEN {min(xi, xj)} AND {max(xi, xj)} AND py BETWEEN {min(yi, yj)} AND {max(yi, yj)})" for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True)]
    return f"({' OR '.join(tests)})"


_TENS = "(SELECT * REPLACE (floor(px / 50) * 50 AS px, floor(py / 50) * 50 AS py) FROM tracks)"


@query(with_tracks(" UNION ALL ".join(f"SELECT {i} lane_id, track_id, frame_id, {_inside_sql(p)} OR {_on_edge_sql(p)} inside FROM {_TENS}" for i, n, p, *v in LANES if len(p) > 2 and v != [False])))
def point_on_border(spark, d):
    """Points on a grid of 50 pixels, many of which lie on the lanes' edges and corners and count as inside."""
    t = tracks(spark, d).withColumns({k: F.floor(F.col(k) / 50) * 50.0 for k in ("px", "py")})
    return lanes.lane_observations(t, lanes.lane_table(spark, LANES), inclusive=True).select("lane_id", "track_id", "frame_id", "inside")


@query(with_lanes("SELECT lane_id, track_id, frame_id FROM observed WHERE inside"))
def point_in_lane_cells(spark, d):
    return lanes.inside_only(tracks(spark, d), lanes.lane_table(spark, LANES)).select("lane_id", "track_id", "frame_id")


_ENTRIES = "entries AS (SELECT * FROM (SELECT *, coalesce(lag(inside) OVER (PARTITION BY lane_id, session_id, track_id ORDER BY frame_id), false) was FROM observed) WHERE inside AND NOT was)"


@query(with_lanes(f", {_ENTRIES} SELECT lane_id, track_id, frame_id FROM entries"))
def lane_entries(spark, d):
    return lanes.entries(_observed(spark, d)).select("lane_id", "track_id", "frame_id")


@query(
    with_lanes(f""", {_ENTRIES}, steps AS (SELECT *, lag(lane_name) OVER (PARTITION BY session_id, track_id ORDER BY frame_id, lane_id) last FROM entries)
        SELECT session_id, track_id, string_agg(lane_name, ' → ' ORDER BY frame_id, lane_id) lane_path FROM steps WHERE last IS NULL OR last <> lane_name GROUP BY ALL""")
)
def lane_path(spark, d):
    return lanes.lane_paths(_observed(spark, d))


@query(with_lanes("SELECT lane_id, count(DISTINCT track_id) FILTER (inside) pass_count FROM observed GROUP BY ALL"))
def pass_count(spark, d):
    return lanes.pass_counts(_observed(spark, d))


_PASSES = "passes AS (SELECT lane_id, session_id, track_id, min(frame_time) first_time FROM observed WHERE inside GROUP BY ALL)"


@query(with_lanes(f", {_PASSES} SELECT lane_id, track_id, round(first_time, 6) first_time FROM passes"))
def first_entry(spark, d):
    return lanes.first_passes(_observed(spark, d)).select("lane_id", "track_id", r("first_time").alias("first_time"))


_WALKED = """walked AS (SELECT *, coalesce(CASE WHEN row_number() OVER w >= 30 THEN sum(step) OVER (PARTITION BY lane_id, session_id, track_id ORDER BY frame_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) END < 10000, false) stationary
    FROM (SELECT *, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) step FROM observed WINDOW w AS (PARTITION BY lane_id, session_id, track_id ORDER BY frame_id))
    WINDOW w AS (PARTITION BY lane_id, session_id, track_id ORDER BY frame_id)),
    last AS (SELECT * FROM walked QUALIFY row_number() OVER (PARTITION BY lane_id, session_id, track_id ORDER BY frame_id DESC) = 1)"""


@query(with_lanes(f", {_WALKED} SELECT lane_id, count(*) FILTER (inside) flow_count, count(*) FILTER (inside AND stationary) queue_count FROM last GROUP BY ALL"))
def lane_occupancy(spark, d):
    still = kinematics.stationary(tracks(spark, d), max_path=10000)
    return lanes.occupancy(lanes.lane_observations(still, lanes.lane_table(spark, LANES)))


# A lane for every order: a slanted quadrangle of 5 to 44 pixels somewhere in the image.
_QUADS = """quads AS (SELECT o_orderkey lane_id, x, y, s, x x1, y y1, x + s x2, y + 1 y2, x + s - 2 x3, y + s y3, x + 1 x4, y + s + 2 y4
    FROM (SELECT o_orderkey, o_orderkey * 37 % 490 x, o_orderkey * 91 % 990 y, 5 + o_orderkey % 40 s FROM orders))"""
_IN_QUAD = "((" + " + ".join(f"CASE WHEN (y{i} > py) <> (y{j} > py) THEN CAST(px < (x{j} - x{i}) * (py - y{i}) / CAST(y{j} - y{i} AS DOUBLE) + x{i} AS INT) ELSE 0 END" for i, j in ((1, 4), (2, 1), (3, 2), (4, 3))) + ") % 2 = 1)"


def _order_lanes(spark, d):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("lane_id"), (k * 37 % 490).alias("x"), (k * 91 % 990).alias("y"), (k % 40 + 5).alias("s"))
    at = lambda dx, dy: geometry.point(F.col("x") + dx, F.col("y") + dy)
    s = F.col("s")
    return o.select("lane_id", F.concat(F.lit("lane "), "lane_id").alias("name"), F.array(at(0, 0), at(s, 1), at(s - 2, s), at(1, s + 2)).alias("polygon"), F.lit(True).alias("visible"))


@query(
    f"""WITH {TRACKS_SQL}, {_QUADS}, walked AS (SELECT *, coalesce(CASE WHEN row_number() OVER w >= 30 THEN sum(step) OVER (PARTITION BY session_id, track_id ORDER BY frame_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) END < 10000, false) stationary,
            row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_id DESC) = 1 last
        FROM (SELECT *, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) step FROM tracks WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id)) WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id)),
    met AS (SELECT lane_id, track_id, bool_or(last) last, bool_or(last AND stationary) still FROM walked JOIN quads ON px BETWEEN x - 2 AND x + s + 2 AND py BETWEEN y AND y + s + 2 AND {_IN_QUAD} GROUP BY ALL),
    counts AS (SELECT lane_id, count(*) pass_count, count(*) FILTER (last) flow_count, count(*) FILTER (still) queue_count FROM met GROUP BY ALL)
    SELECT q.lane_id, coalesce(pass_count, 0) pass_count, coalesce(flow_count, 0) flow_count, coalesce(queue_count, 0) queue_count FROM quads q LEFT JOIN counts USING (lane_id)"""
)
def lane_figures_many(spark, d):
    still = kinematics.stationary(tracks(spark, d), max_path=10000)
    return lanes.lane_figures(still, _order_lanes(spark, d)).drop("name")


@query(
    f"""WITH {TRACKS_SQL}, {_QUADS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_id) n FROM tracks),
    met AS (SELECT lane_id, session_id, track_id, frame_id, n FROM numbered JOIN quads ON px BETWEEN x - 2 AND x + s + 2 AND py BETWEEN y AND y + s + 2 AND {_IN_QUAD})
    SELECT lane_id, track_id, frame_id FROM met QUALIFY coalesce(lag(n) OVER (PARTITION BY lane_id, session_id, track_id ORDER BY n) < n - 1, true)"""
)
def lane_entries_many(spark, d):
    seen = tracks(spark, d).select("session_id", "track_id", "frame_id", "px", "py")
    return lanes.entries_inside(seen, _order_lanes(spark, d).drop("name")).select("lane_id", "track_id", "frame_id")


@query(with_lanes(f", {_PASSES} SELECT lane_id, track_id, count(*) OVER (PARTITION BY lane_id ORDER BY CAST(round(first_time * 1000000) AS BIGINT) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) * (3600.0::DOUBLE / 86400) flow_rate FROM passes"))
def flow_rate(spark, d):
    return lanes.flow_rate(lanes.first_passes(_observed(spark, d)), window=86400.0).select("lane_id", "track_id", "flow_rate")


@query(
    f"WITH {_OBSERVED}, {_PASSES}, {_WALKED}, names AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n!r})' for i, n, *_ in LANES)}) AS t(lane_id, name)) "
    """SELECT lane_id, name, coalesce((SELECT count(DISTINCT track_id) FROM observed o WHERE inside AND o.lane_id = n.lane_id), 0) pass_count,
        coalesce((SELECT count(*) FROM last o WHERE inside AND o.lane_id = n.lane_id), 0) current_in_lane,
        coalesce((SELECT count(*) FROM last o WHERE inside AND stationary AND o.lane_id = n.lane_id), 0) queue_count,
        printf('%.0f', coalesce((SELECT count(*) FROM passes p WHERE p.lane_id = n.lane_id AND 1704153600 - first_time >= 0 AND 1704153600 - first_time < 86400), 0) * 3600.0::DOUBLE / 86400) flow_rate_veh_h FROM names n"""
)
def lane_csv(spark, d):
    table = lanes.lane_table(spark, LANES)
    observed = lanes.lane_observations(kinematics.stationary(tracks(spark, d), max_path=10000), table)
    return sinks.lane_rows(lanes.summary(observed, table, 1704153600.0, window=86400.0))


@query("SELECT min(i) next_number FROM range(1, 100) t(i) WHERE i NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 7)")
def next_free_lane(spark, d):
    return lanes.next_free_number(spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("lane_id")))


@query("SELECT coalesce(max(CAST(n_nationkey AS BIGINT)), 0) + 1 next_number FROM nation")
def next_results_folder(spark, d):
    return lanes.next_folder(spark.read.parquet(f"{d}/nation.parquet").select(F.format_string("%02d", F.col("n_nationkey").cast("int")).alias("name")).unionByName(spark.range(1).select(F.lit("notes").alias("name"))))


_SLIDE = "SELECT lane_id, time_bucket(INTERVAL 1 HOUR, to_timestamp(first_time)::TIMESTAMP) - to_hours(k) AS started FROM passes, range(24) t(k)"


@query(with_lanes(f", {_PASSES} SELECT lane_id, epoch(started)::BIGINT started, count(*) passes, count(*) * 3600.0::DOUBLE / 86400 per_hour FROM ({_SLIDE.replace('to_timestamp(first_time)::TIMESTAMP', 'make_timestamp(CAST(round(first_time * 1000000) AS BIGINT))')}) GROUP BY ALL"))
def sliding_rate(spark, d):
    from kerbside.streaming.stateful import sliding_rate as rate

    passes = lanes.first_passes(_observed(spark, d)).withColumn("pass_time", F.timestamp_micros(F.round(F.col("first_time") * 1000000).cast("long")))
    return rate(passes, window="24 hours", slide="1 hour").select("lane_id", F.unix_timestamp("window.start").alias("started"), "passes", "per_hour")


@query(
    """SELECT user_id session_id, CAST(floor(epoch_us(min(ts)) / 1000000.0) AS BIGINT) started, count(*) "rows" FROM (
        SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) s FROM (
            SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 14400000000 THEN 1 ELSE 0 END g FROM events)) GROUP BY user_id, s"""
)
def session_gap_windows(spark, d):
    from kerbside.streaming.stateful import sessions

    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("seen"))
    return sessions(e, "seen", "4 hours").select("session_id", F.unix_timestamp("started").alias("started"), "rows")


# Places.

H = (1.2, 0.05, -30.0, -0.02, 1.1, 12.0, 0.0004, 0.0002, 1.0)
CAMERA = geo.Camera((800.0, 0.0, 245.0, 0.0, 790.0, 495.0, 0.0, 0.0, 1.0), (-0.12, 0.03, 0.001, -0.0008, 0.002))
ORIGIN = (121.47, 31.23)


def _d(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def persp_sql(x: str, y: str) -> tuple[str, str]:
    a, b, w = (f"({x} * {_d(H[i])} + {y} * {_d(H[i + 1])} + {_d(H[i + 2])})" for i in (0, 3, 6))
    return f"(CASE WHEN abs({w}) >= 1e-12 THEN {a} / {w} END)", f"(CASE WHEN abs({w}) >= 1e-12 THEN {b} / {w} END)"


def undistort_sql(source: str, x: str = "px", y: str = "py", rounds: int = 10) -> str:
    """A query with ux, uy beside the columns of source."""
    m, k = CAMERA.matrix, CAMERA.distortion
    q = f"SELECT *, ({x} - {_d(m[2])}) / {_d(m[0])} u0, ({y} - {_d(m[5])}) / {_d(m[4])} v0 FROM {source}"
    q = f"SELECT *, u0 u, v0 v FROM ({q})"
    for _ in range(rounds):
        r2, radial = "(u*u + v*v)", f"(1 + {_d(k[0])} * (u*u+v*v) + {_d(k[1])} * power(u*u+v*v, 2) + {_d(k[4])} * power(u*u+v*v, 3))"
        dx, dy = f"(2 * {_d(k[2])} * u * v + {_d(k[3])} * ({r2} + 2*u*u))", f"({_d(k[2])} * ({r2} + 2*v*v) + 2 * {_d(k[3])} * u * v)"
        q = f"SELECT * REPLACE ((u0 - {dx}) / {radial} AS u, (v0 - {dy}) / {radial} AS v) FROM ({q})"
    return f"SELECT * EXCLUDE (u, v, u0, v0), u * {_d(m[0])} + {_d(m[2])} ux, v * {_d(m[4])} + {_d(m[5])} uy FROM ({q})"


def utm_sql(lon: str, lat: str, zone: str | None = None) -> dict[str, str]:
    z = zone or f"least(greatest(CAST(floor(({lon} + 180) / 6) AS INT) + 1, 1), 60)"
    e = _d(geo.ECCENTRICITY)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    away = f"radians({lon} - (({z}) * 6 - 183))"
    a, b = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt({t} * {t} + 1))"
    east, north = b, a
    for j, w in enumerate(geo.TO_GRID, 1):
        north += f" + {_d(w)} * sin({2 * j} * {a}) * cosh({2 * j} * {b})"
        east += f" + {_d(w)} * cos({2 * j} * {a}) * sinh({2 * j} * {b})"
    k = _d(geo.SCALE * geo.RADIUS)
    return {"easting": f"({k} * ({east}) + 500000)", "northing": f"({k} * ({north}) + CASE WHEN {lat} >= 0 THEN 0 ELSE 10000000 END)", "zone": f"({z})", "north": f"({lat} >= 0)"}


def lonlat_sql(east: str, north: str, zone: str, is_north: str) -> dict[str, str]:
    k = _d(geo.SCALE * geo.RADIUS)
    a, b = f"((({north}) - CASE WHEN {is_north} THEN 0 ELSE 10000000 END) / {k})", f"((({east}) - 500000) / {k})"
    x, y = a, b
    for j, w in enumerate(geo.FROM_GRID, 1):
        x += f" - {_d(w)} * sin({2 * j} * {a}) * cosh({2 * j} * {b})"
        y += f" - {_d(w)} * cos({2 * j} * {a}) * sinh({2 * j} * {b})"
    chi = f"asin(sin({x}) / cosh({y}))"
    lat = chi + "".join(f" + {_d(w)} * sin({2 * j} * {chi})" for j, w in enumerate(geo.TO_GEODETIC, 1))
    return {"lon": f"(degrees(atan2(sinh({y}), cos({x}))) + (({zone}) * 6 - 183))", "lat": f"degrees({lat})"}


_PLACES = TRACKS_SQL + ", places AS (SELECT *, px / CAST(490 AS DOUBLE) * 360 - 180 lon, py / CAST(990 AS DOUBLE) * 160 - 80 lat FROM tracks)"


def _places(spark, d):
    return tracks(spark, d).withColumns({"lon": F.col("px") / 490 * 360 - 180, "lat": F.col("py") / 990 * 160 - 80})


@query(with_tracks(f"SELECT track_id, frame_id, round({persp_sql('px', 'py')[0]}, 6) ground_x, round({persp_sql('px', 'py')[1]}, 6) ground_y FROM tracks"))
def homography(spark, d):
    return tracks(spark, d).withColumn("g", geo.perspective("px", "py", H)).select("track_id", "frame_id", r("g.x").alias("ground_x"), r("g.y").alias("ground_y"))


@query(with_tracks(f"SELECT track_id, frame_id, round(ux, 6) ux, round(uy, 6) uy FROM ({undistort_sql('tracks')})"))
def undistort(spark, d):
    return tracks(spark, d).withColumn("u", geo.undistorted("px", "py", CAMERA)).select("track_id", "frame_id", r("u.x").alias("ux"), r("u.y").alias("uy"))


_U = utm_sql("lon", "lat")


@query(f"WITH {_PLACES} SELECT track_id, frame_id, round({_U['easting']}, 4) easting, round({_U['northing']}, 4) northing, {_U['zone']} \"zone\", CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {_U['zone']} epsg FROM places")
def lonlat_to_utm(spark, d):
    return _places(spark, d).withColumn("u", geo.to_utm("lon", "lat")).select("track_id", "frame_id", r("u.easting", 4).alias("easting"), r("u.northing", 4).alias("northing"), F.col("u.zone").alias("zone"), geo.utm_epsg("lon", "lat").alias("epsg"))


_B = lonlat_sql("east", "north", "31 + track_id % 20", "track_id % 2 = 0")


@query(f"WITH {TRACKS_SQL} SELECT track_id, frame_id, round({_B['lon']}, 8) lon, round({_B['lat']}, 8) lat FROM (SELECT *, 300000 + px * 800 east, 100000 + py * 8000 north FROM tracks)")
def utm_to_lonlat(spark, d):
    t = tracks(spark, d).withColumn("p", geo.from_utm(F.col("px") * 800 + 300000, F.col("py") * 8000 + 100000, 31 + F.col("track_id") % 20, F.col("track_id") % 2 == 0))
    return t.select("track_id", "frame_id", r("p.lon", 8).alias("lon"), r("p.lat", 8).alias("lat"))


_O = utm_sql(_d(ORIGIN[0]), _d(ORIGIN[1]))
_G = lonlat_sql("oe + px", "onn + py", "oz", "true")


@query(with_tracks(f"SELECT track_id, frame_id, round({_G['lon']}, 8) lon, round({_G['lat']}, 8) lat FROM (SELECT *, {_O['easting']} oe, {_O['northing']} onn, {_O['zone']} oz FROM tracks)"))
def ground_to_lonlat(spark, d):
    t = tracks(spark, d).withColumn("p", geo.from_ground("px", "py", F.lit(ORIGIN[0]), F.lit(ORIGIN[1])))
    return t.select("track_id", "frame_id", r("p.lon", 8).alias("lon"), r("p.lat", 8).alias("lat"))


_N = utm_sql("lon", "lat", "51")


@query(with_tracks(f"SELECT track_id, frame_id, round({_N['easting']} - oe, 4) x, round({_N['northing']} - onn, 4) y FROM (SELECT *, 121 + px / CAST(1000 AS DOUBLE) lon, 31 + py / CAST(2000 AS DOUBLE) lat, {_O['easting']} oe, {_O['northing']} onn FROM tracks)"))
def lonlat_to_ground(spark, d):
    t = tracks(spark, d).withColumn("g", geo.to_ground(F.col("px") / 1000 + 121, F.col("py") / 2000 + 31, F.lit(ORIGIN[0]), F.lit(ORIGIN[1])))
    return t.select("track_id", "frame_id", r("g.x", 4).alias("x"), r("g.y", 4).alias("y"))


@query(f"WITH {_PLACES} SELECT track_id, frame_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(power(sin((radians({_d(ORIGIN[1])}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({_d(ORIGIN[1])})) * power(sin(radians({_d(ORIGIN[0])} - lon) / 2), 2))), 3) metres FROM places")
def haversine(spark, d):
    return _places(spark, d).select("track_id", "frame_id", r(geo.haversine("lon", "lat", F.lit(ORIGIN[0]), F.lit(ORIGIN[1])), 3).alias("metres"))


_GX, _GY = persp_sql("ux", "uy")
_GG = lonlat_sql("oe + gx", "onn + gy", "oz", "true")


@query(with_tracks(f"SELECT track_id, frame_id, round(gx, 5) ground_x, round(gy, 5) ground_y, round({_GG['lon']}, 7) lon, round({_GG['lat']}, 7) lat FROM (SELECT *, {_GX} gx, {_GY} gy, {_O['easting']} oe, {_O['northing']} onn, {_O['zone']} oz FROM ({undistort_sql('tracks')}))"))
def geo_transform(spark, d):
    """Undistorted once, whether or not the stage before has done it."""
    t = tracks(spark, d).withColumns({"cx": F.col("px"), "cy": F.col("py")})
    t = geo.geo_stage(geo.undistort_stage(t, CAMERA), H, ORIGIN, CAMERA)
    return t.select("track_id", "frame_id", r("ground_x", 5).alias("ground_x"), r("ground_y", 5).alias("ground_y"), r("lon", 7).alias("lon"), r("lat", 7).alias("lat"))


_CX, _CY = persp_sql("(px + 4)", "(py + 2)")


@query(with_tracks(f"SELECT track_id, frame_id, round({_CX}, 6) x3, round({_CY}, 6) y3 FROM tracks"))
def corners_on_ground(spark, d):
    box = geometry.rect_corners(F.col("px") - 4, F.col("py") - 2, F.col("px") + 4, F.col("py") + 2)
    return tracks(spark, d).withColumn("c", geo.ground_corners(box, H)).select("track_id", "frame_id", r(F.get("c", 2)["x"]).alias("x3"), r(F.get("c", 2)["y"]).alias("y3"))


_UX, _UY = persp_sql("ux", "uy")
_ALL_CORNERS = "(" + " UNION ALL ".join(f"SELECT track_id, frame_id, {i} corner, px {a} 4 cx, py {b} 2 cy FROM tracks" for i, (a, b) in enumerate((("-", "-"), ("+", "-"), ("+", "+"), ("-", "+")), 1)) + ")"


@query(with_tracks(f"SELECT track_id, frame_id, corner, round({_UX}, 5) x, round({_UY}, 5) y FROM ({undistort_sql(_ALL_CORNERS, 'cx', 'cy')})"))
def undistorted_corners(spark, d):
    """All four corners, through the lens and onto the ground."""
    box = geometry.rect_corners(F.col("px") - 4, F.col("py") - 2, F.col("px") + 4, F.col("py") + 2)
    seen = tracks(spark, d).select("track_id", "frame_id", box.alias("box"))
    out = geo.each_corner_on_ground(seen, "box", H, CAMERA)
    return out.select("track_id", "frame_id", "corner", r("x", 5).alias("x"), r("y", 5).alias("y"))


# Detections. embeddings are 8 boxes of 4 + 3 + 1 features each.

_RAW = """raw AS (SELECT vec_id frame_id, i AS det_idx, list_transform(range(1, 9), lambda k: CAST(embedding[i * 8 + k] AS DOUBLE)) f FROM embeddings, range(8) t(i)),
    scored AS (SELECT *, f[1] cx, f[2] cy, f[3] w, f[4] h, greatest(f[5], f[6], f[7]) top, degrees(f[8]) angle FROM raw),
    found AS (SELECT * EXCLUDE (top), CASE WHEN top > 0 THEN list_position(f[5:7], top) - 1 ELSE 0 END class_id, greatest(top, 0) confidence FROM scored)"""


def _found(spark, d):
    return decode.scored(decode.boxes(boxes(spark, d)))


@query(f"WITH {_RAW} SELECT frame_id, det_idx, CAST(class_id AS INT) class_id, round(confidence, 6) confidence, round(angle, 6) angle FROM found")
def decode_argmax(spark, d):
    return _found(spark, d).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), "class_id", r("confidence").alias("confidence"), r("angle").alias("angle"))


@query(f"WITH {_RAW} SELECT frame_id, det_idx, round(confidence, 6) confidence FROM found WHERE confidence >= 0.2")
def decode_confidence_filter(spark, d):
    return decode.kept(_found(spark, d), 0.2).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), r("confidence").alias("confidence"))


# The same 64 numbers as boxes of 4 + 4 features without an angle, as ten boxes of 7 end-to-end features (of the first 56: eight),
# and as features of ten boxes, 6 rows of 10 (of the first 60).
_LAYOUTS = """raw AS (SELECT vec_id frame_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) e FROM embeddings),
    hbb AS (SELECT 'hbb' layout, frame_id, i det_idx, list_transform(range(1, 9), lambda k: e[i * 8 + k]) f FROM raw, range(8) t(i)),
    e2e AS (SELECT 'end_to_end' layout, frame_id, i det_idx, list_transform(range(1, 8), lambda k: e[i * 7 + k]) f FROM raw, range(8) t(i)),
    turned AS (SELECT 'transposed' layout, frame_id, i det_idx, list_transform(range(0, 6), lambda k: e[k * 10 + i + 1]) f FROM raw, range(10) t(i)),
    found AS (SELECT layout, frame_id, det_idx, f[1] cx, CASE WHEN greatest(f[5], f[6], f[7], f[8]) > 0 THEN list_position(f[5:8], greatest(f[5], f[6], f[7], f[8])) - 1 ELSE 0 END class_id, greatest(f[5], f[6], f[7], f[8], 0) confidence, 0 angle FROM hbb
        UNION ALL SELECT layout, frame_id, det_idx, f[1], trunc(f[6]), f[5], degrees(f[7]) FROM e2e
        UNION ALL SELECT layout, frame_id, det_idx, f[1], 0, greatest(f[5], 0), degrees(f[6]) FROM turned)"""


@query(f"WITH {_LAYOUTS} SELECT layout, frame_id, det_idx, round(cx, 6) cx, CAST(class_id AS INT) class_id, round(confidence, 6) confidence, round(angle, 6) angle FROM found")
def decode_layouts(spark, d):
    """Tensors without an angle, end-to-end ones, and some whose rows are features."""
    b, parts = boxes(spark, d), []
    for name, size, shape, is_obb, layout in (("hbb", 64, (1, 8, 8), False, "hbb"), ("end_to_end", 56, (1, 8, 7), True, "end_to_end"), ("transposed", 60, (1, 6, 10), True, None)):
        t = b.withColumns({"data": F.slice("data", 1, size), "shape": F.array(*map(F.lit, shape))})
        parts.append(decode.scored(decode.boxes(t, is_obb, layout), is_obb, layout).withColumn("layout", F.lit(name)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("layout", "frame_id", F.col("det_idx").cast("long").alias("det_idx"), r("cx").alias("cx"), "class_id", r("confidence").alias("confidence"), r("angle").alias("angle"))


@query(
    """WITH raw AS (SELECT vec_id frame_id, i AS det_idx, list_transform(range(1, 9), lambda k: CASE WHEN (vec_id + i * 8 + k) % 13 = 0 THEN 'NaN'::DOUBLE ELSE CAST(embedding[i * 8 + k] AS DOUBLE) END) f FROM embeddings, range(8) t(i)),
    s AS (SELECT *, list_transform(f[5:7], lambda v: CASE WHEN isnan(v) THEN 0 ELSE v END) scores FROM raw), top AS (SELECT *, greatest(scores[1], scores[2], scores[3]) top FROM s)
    SELECT frame_id, det_idx, CAST(CASE WHEN top > 0 THEN list_position(scores, top) - 1 ELSE 0 END AS INT) class_id, round(greatest(top, 0), 6) confidence FROM top
    WHERE top >= 0.05 AND NOT (isnan(f[1]) OR isnan(f[2]) OR isnan(f[3]) OR isnan(f[4]))"""
)
def decode_without_numbers(spark, d):
    """A thirteenth of the features isn't a number: as a place or size it drops its box, as a score it counts for nothing."""
    t = boxes(spark, d).withColumn("data", F.transform("data", lambda v, i: F.when((F.col("frame_id") + i + 1) % 13 == 0, float("nan")).otherwise(v)))
    out = decode.kept(decode.scored(decode.boxes(t)), 0.05)
    return out.select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), "class_id", r("confidence").alias("confidence"))


_NAMES = ["car", "pedestrian"]


@query(f"WITH {_RAW} SELECT frame_id, det_idx, CASE class_id WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian' ELSE 'class_' || CAST(class_id AS INT) END class_name FROM found")
def class_names(spark, d):
    return decode.named(_found(spark, d), decode.class_names(' "car" , pedestrian')).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), "class_name")


_IMAGE = f"""{_RAW}, image AS (SELECT frame_id, det_idx, class_id, confidence, angle,
    greatest(0, least(640, (cx * 1000 + 500 - 0) / 1.6::FLOAT::DOUBLE)) cx, greatest(0, least(480, (cy * 1000 + 500 - 128) / 1.6::FLOAT::DOUBLE)) cy,
    abs(w) * 400 / 1.6::FLOAT::DOUBLE w, abs(h) * 400 / 1.6::FLOAT::DOUBLE h FROM found WHERE confidence >= 0.1)"""


def _image(spark, d):
    f = decode.kept(_found(spark, d), 0.1).withColumns({"cx": F.col("cx") * 1000 + 500, "cy": F.col("cy") * 1000 + 500, "w": F.abs("w") * 400, "h": F.abs("h") * 400, "orig_w": F.lit(640), "orig_h": F.lit(480)})
    return decode.to_image(f.withColumn("letterbox", decode.letterbox("orig_w", "orig_h", 1024, 1024)))


@query(f"WITH {_IMAGE} SELECT frame_id, det_idx, round(cx, 5) cx, round(cy, 5) cy, round(w, 5) w, round(h, 5) h FROM image")
def inverse_letterbox(spark, d):
    return _image(spark, d).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), *(r(c, 5).alias(c) for c in ("cx", "cy", "w", "h")))


@query("SELECT p_partkey id, round(least(CAST(1024 AS DOUBLE) / ow, CAST(640 AS DOUBLE) / oh), 4) scale, CAST((1024 - CAST(floor(ow::FLOAT * s) AS INT)) // 2 AS INT) pad_x, CAST((640 - CAST(floor(oh::FLOAT * s) AS INT)) // 2 AS INT) pad_y FROM (SELECT *, least(CAST(CAST(1024 AS DOUBLE) / ow AS FLOAT), CAST(CAST(640 AS DOUBLE) / oh AS FLOAT)) s FROM (SELECT p_partkey, 200 + p_size * 37 ow, 150 + p_size * 11 oh FROM part))")
def letterbox_parameters(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), decode.letterbox(F.col("p_size") * 37 + 200, F.col("p_size") * 11 + 150, 1024, 640).alias("l"))
    return p.select("id", r(F.col("l.scale").cast("double"), 4).alias("scale"), "l.pad_x", "l.pad_y")


_CORNERS = f"""{_IMAGE}, turned AS (SELECT *, cos(radians(angle)) / 2 b, sin(radians(angle)) / 2 a FROM image),
    c01 AS (SELECT *, cx - a*h - b*w x0, cy + b*h - a*w y0, cx + a*h - b*w x1, cy - b*h - a*w y1 FROM turned),
    cornered AS (SELECT *, 2*cx - x0 x2, 2*cy - y0 y2, 2*cx - x1 x3, 2*cy - y1 y3 FROM c01),
    boxed AS (SELECT *, CAST(floor(least(x0, x1, x2, x3)) AS INT) bx, CAST(floor(least(y0, y1, y2, y3)) AS INT) by_,
        CAST(ceil(greatest(x0, x1, x2, x3)) AS INT) - CAST(floor(least(x0, x1, x2, x3)) AS INT) + 1 bw, CAST(ceil(greatest(y0, y1, y2, y3)) AS INT) - CAST(floor(least(y0, y1, y2, y3)) AS INT) + 1 bh FROM cornered)"""


@query(f"WITH {_CORNERS} SELECT frame_id, det_idx, round(x0, 5) x0, round(y0, 5) y0, round(x1, 5) x1, round(y1, 5) y1, round(x2, 5) x2, round(y3, 5) y3, bx, by_ AS \"by\", bw, bh FROM boxed")
def obb_corners(spark, d):
    g = decode.with_geometry(_image(spark, d))
    at = lambda i, k: r(F.get("corners", i)[k], 5)
    return g.select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(2, "x").alias("x2"), at(3, "y").alias("y3"), *(F.col(f"bbox.{k}").alias(f"b{k}") for k in "xywh"))


_RANKED = f"{_CORNERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, det_idx) \"rank\" FROM boxed)"


@query(f"WITH {_RANKED} SELECT frame_id, det_idx, \"rank\" FROM ranked")
def score_order(spark, d):
    return nms.score_order(_image(spark, d)).select("frame_id", F.col("det_idx").cast("long").alias("det_idx"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_RANKED}, pairs AS (SELECT p.frame_id, p.det_idx kept_idx, q.det_idx other_idx,
        CAST((least(p.bx + p.bw, q.bx + q.bw) - greatest(p.bx, q.bx)) * (least(p.by_ + p.bh, q.by_ + q.bh) - greatest(p.by_, q.by_)) AS DOUBLE) common, p.bw * p.bh + q.bw * q.bh total
        FROM ranked p JOIN ranked q ON p.frame_id = q.frame_id AND p."rank" < q."rank" AND p.bx < q.bx + q.bw AND q.bx < p.bx + p.bw AND p.by_ < q.by_ + q.bh AND q.by_ < p.by_ + p.bh)
        SELECT frame_id, kept_idx, other_idx, round(common / (total - common), 6) iou FROM pairs WHERE common / (total - common) > 0.1"""
)
def nms_pairs(spark, d):
    out = nms.overlapping_pairs(decode.with_geometry(_image(spark, d)), 0.1)
    return out.select("frame_id", F.col("kept_idx").cast("long").alias("kept_idx"), F.col("other_idx").cast("long").alias("other_idx"), r("iou").alias("iou"))


@query()
def nms_rotated(spark, d):
    return nms.suppress(_image(spark, d).drop("letterbox"), 0.1).select("frame_id", "det_idx", "class_id", r("confidence").alias("confidence"))


# Box after box, best first: each stays unless it overlaps one of those that stay by now.
_KEPT = f"""{_RANKED}, bad AS (SELECT q.frame_id, q."rank" AS r, list(p."rank") better
        FROM ranked p JOIN ranked q ON p.frame_id = q.frame_id AND p."rank" < q."rank" AND p.bx < q.bx + q.bw AND q.bx < p.bx + p.bw AND p.by_ < q.by_ + q.bh AND q.by_ < p.by_ + p.bh
        WHERE ((least(p.bx + p.bw, q.bx + q.bw) - greatest(p.bx, q.bx)) * (least(p.by_ + p.bh, q.by_ + q.bh) - greatest(p.by_, q.by_)))::DOUBLE
            / (p.bw * p.bh + q.bw * q.bh - (least(p.bx + p.bw, q.bx + q.bw) - greatest(p.bx, q.bx)) * (least(p.by_ + p.bh, q.by_ + q.bh) - greatest(p.by_, q.by_))) > 0.1 GROUP BY ALL),
    steps AS (SELECT DISTINCT frame_id, 0::BIGINT r, []::BIGINT[] kept FROM ranked UNION ALL
        SELECT s.frame_id, s.r + 1, CASE WHEN b.better IS NOT NULL AND list_has_any(s.kept, b.better) THEN s.kept ELSE list_append(s.kept, s.r + 1) END
        FROM steps s JOIN ranked n ON n.frame_id = s.frame_id AND n."rank" = s.r + 1 LEFT JOIN bad b ON b.frame_id = s.frame_id AND b.r = s.r + 1),
    kept AS (SELECT frame_id, unnest(kept) AS "rank" FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY r DESC) = 1))
    SELECT frame_id, CAST(det_idx AS INT) det_idx, CAST(class_id AS INT) class_id, round(confidence, 6) confidence FROM ranked JOIN kept USING (frame_id, "rank")"""


@query(f"WITH RECURSIVE {_KEPT}")
def nms_by_rounds(spark, d):
    return nms.suppress_by_rounds(_image(spark, d).drop("letterbox"), 0.1, rotated=False).select("frame_id", "det_idx", "class_id", r("confidence").alias("confidence"))


@query(f"WITH RECURSIVE {_KEPT}")
def nms_axis_aligned(spark, d):
    return nms.suppress(_image(spark, d).drop("letterbox"), 0.1, rotated=False).select("frame_id", "det_idx", "class_id", r("confidence").alias("confidence"))


@query(with_tracks("SELECT track_id, frame_id, round(px - 5.5::DOUBLE, 6) x, round(py + 3, 6) y FROM tracks"))
def corners_and_centre(spark, d):
    """Two points make a box, whose corners' mean is the centre."""
    two = F.array(geometry.point(F.col("px") - 8, F.col("py") + 1), geometry.point(F.col("px") - 3, F.col("py") + 5))
    t = tracks(spark, d).withColumn("c", geometry.centre(geometry.four_corners(two)))
    return t.select("track_id", "frame_id", r("c.x").alias("x"), r("c.y").alias("y"))


#: Users whose events are a session's detections; sessions grow in number with the table.
SESSION_USERS = 16


def _detections(spark, d):
    """All of events as boxes, so wide that those of successive frames overlap and tracks form."""
    o = observations(spark, d).withColumns({"session_id": F.floor(F.col("track_id") / SESSION_USERS).cast("string"), "cx": F.col("px"), "cy": F.col("py"), "w": F.lit(200.0), "h": F.lit(600.0), "angle": F.lit(0.0), "class_id": (F.crc32("event_type") % 2).cast("int")})
    order = Window.partitionBy("session_id", "frame_id").orderBy("event_id")
    return o.withColumn("det_idx", F.row_number().over(order) - 1).select("session_id", "frame_id", "det_idx", "event_id", *tracker.BOX, "confidence", "class_id")


@query()
def track_objects(spark, d):
    return tracker.track(_detections(spark, d)).select("session_id", "frame_id", "det_idx", "event_id", "track_id")


@query()
def planned_pipeline(spark, d):
    request = {"config": {"yolo": {"confidence": 0.1}, "geo_transform": {"homography": list(H), "origin_lon": ORIGIN[0], "origin_lat": ORIGIN[1]}}}
    run = registry.build(config.plan(request))
    tensors = boxes(spark, d).withColumns({"data": F.transform("data", lambda v: v), "orig_w": F.lit(640), "orig_h": F.lit(480)})
    return run(tensors).select("session_id", "frame_id", "det_idx", "track_id", "class_name", r("confidence").alias("confidence"), r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


@query(
    f"""WITH {_RAW} SELECT 'r' || frame_id AS request_id, CASE WHEN frame_id % 7 = 0 OR frame_id % 11 = 0 THEN 'error' ELSE 'result' END kind,
        CASE WHEN frame_id % 7 = 0 OR frame_id % 11 = 0 THEN 'Processing failed' END error, CASE WHEN NOT (frame_id % 7 = 0 OR frame_id % 11 = 0) THEN CAST(count(*) FILTER (confidence >= 0.3) AS INT) END detections
        FROM found GROUP BY frame_id"""
)
def executed_plan(spark, d):
    """Every frame once: a seventh of the tensors is cut short, an eleventh is missing. No overlap is over 2, so that none is suppressed."""
    frames = boxes(spark, d).withColumns({"request_id": F.concat(F.lit("r"), "frame_id"), "orig_w": F.lit(640), "orig_h": F.lit(480)})
    frames = frames.withColumn("data", F.when(F.col("frame_id") % 11 != 0, F.when(F.col("frame_id") % 7 == 0, F.slice("data", 1, 60)).otherwise(F.col("data"))))
    out = registry.execute(config.plan({"config": {"yolo": {"confidence": 0.3}}}), frames, {"yolo": {"nms_threshold": 2.0}})
    n = F.size(F.from_json("message", "detections array<struct<class_id:int>>")["detections"])
    answered = out.results.select("request_id", F.get_json_object("message", "$.type").alias("kind"), F.lit(None).cast("string").alias("error"), n.alias("detections"))
    return answered.unionByName(out.errors.select("request_id", F.get_json_object("message", "$.type").alias("kind"), F.get_json_object("message", "$.error").alias("error"), F.lit(None).cast("int").alias("detections")))


# Messages.


@query(
    """SELECT user_id::VARCHAR session_id, CAST(idx - 1 AS INT) idx, s - len "start", len size, event_type AS "content" FROM (
        SELECT *, row_number() OVER w idx, CAST(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) s, length(event_type) len FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
)
def batch_slices(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("event_type").alias("content"))
    return _sliced(e).select("session_id", "idx", "start", "size", "content")


#: Frames and bytes of a batch at most, but for the bytes of its last frame.
BATCH_FRAMES, BATCH_BYTES = 256, 1 << 18


def _sliced(events: DataFrame) -> DataFrame:
    """session_id, idx, start, size, content of events (session_id, event_id, content), a session's joined by event_id.

    start and size count characters. A session is cut into batches of bounded size, which go through split_batches()
    each; what is null or too long for a payload is a slice as it stands.
    """
    w = Window.partitionBy("session_id").orderBy("event_id", "content").rowsBetween(Window.unboundedPreceding, 0)
    size, octets = F.length("content").cast("bigint"), F.octet_length("content").cast("bigint")
    placed = events.select(
        "session_id", "event_id", "content", (F.row_number().over(w) - 1).alias("at"), (F.sum(size).over(w) - size).alias("start"), F.coalesce(F.sum(octets).over(w) - octets, F.lit(0)).alias("before"), octets.alias("octets")
    )
    fits = F.coalesce(F.col("octets") <= readers.MAX_PAYLOAD - BATCH_BYTES, F.lit(False))
    frame = F.struct("at", "start", "event_id", "octets", "content")
    batch = [F.floor(F.col("at") / BATCH_FRAMES).alias("_frames"), F.floor(F.col("before") / BATCH_BYTES).alias("_bytes")]
    lists = placed.where(fits).groupBy("session_id", *batch).agg(F.array_sort(F.collect_list(frame)).alias("l"))
    of = lambda f: F.transform("l", f)
    batches = lists.select(
        "session_id",
        of(lambda e: F.struct(e["event_id"].cast("string").alias("request_id"), (e["at"] + 1).alias("frame_id"))).alias("frames"),
        of(lambda e: e["octets"]).alias("sizes"),
        of(lambda e: e["start"]).alias("starts"),
        F.encode(F.array_join(of(lambda e: e["content"]), ""), "UTF-8").alias("content"),
    )
    cut = readers.split_batches(batches).withColumn("text", F.decode("content", "UTF-8"))
    cut = cut.select("session_id", (F.col("frame_id") - 1).alias("idx"), F.get("starts", F.col("idx")).alias("start"), F.length("text").cast("bigint").alias("size"), F.col("text").alias("content"))
    return cut.unionByName(placed.where(~fits).select("session_id", F.col("at").alias("idx"), "start", size.alias("size"), "content"))


_MESSAGES = {
    0: ("""'{"type":"infer_header","request_id":"r' || {id} || '","session_id":"s","frame_id":' || ({id} + 1) || '}'""", "NULL"),
    1: ("""'{"type":"infer_header","request_id":"","session_id":"s","frame_id":1}'""", "'invalid_request'"),
    2: ("""'{"type":"infer_header","request_id":"r","session_id":"s","frame_id":0}'""", "'invalid_request'"),
    3: ("""'{"type":"infer_batch","session_id":"s","frames":[{"request_id":"a","frame_id":1}],"sizes":[' || {id} || ']}'""", "NULL"),
    4: ("""'{"type":"infer_batch","session_id":"s","frames":[{"request_id":"a","frame_id":1}],"sizes":[]}'""", "'invalid_request'"),
    5: ("""'{"type":"infer"}'""", "'legacy_infer_removed'"),
    6: ("""'{"type":"ping"}'""", "NULL"),
    7: ("""'{"type":"dance"}'""", "'unknown_type'"),
    8: ("""'{"type":'""", "'invalid_json'"),
}


@query("SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {k} THEN {code}" for k, (_, code) in _MESSAGES.items()) + " END code FROM events")
def header_validation(spark, d):
    text = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN {m.replace('{id}', 'event_id')}" for k, (m, _) in _MESSAGES.items()) + " END"
    return readers.parse_headers(spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(text).alias("message"))).select("event_id", "code")


@query("SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'payload_too_large' WHEN doc_id % 2 = 1 THEN 'payload_size_mismatch' END code FROM documents")
def payload_guards(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").withColumn("sizes", F.array(F.octet_length("text").cast("bigint"), F.col("doc_id") % 2))
    return t.select("doc_id", readers.payload_code("text", "sizes", 5000).alias("code"))


# Of each user's events: clicks and views are headers (views without an id), purchases payloads.
_MESSAGES_OF_USERS = {"click": ("header", None), "view": ("header", "invalid_request"), "purchase": ("payload", None)}


@query(
    """WITH m AS (SELECT user_id, event_id, event_type, event_type = 'purchase' AS payload, event_type = 'click' AS header, props FROM events),
    runs AS (SELECT *, coalesce(sum(payload::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) run FROM m),
    f AS (SELECT *, min(event_id) FILTER (header) OVER (PARTITION BY user_id, run) waiting FROM runs)
    SELECT user_id AS connection_id, event_id AS seq, CASE WHEN payload THEN waiting END AS header_seq,
        CASE WHEN payload AND waiting IS NULL THEN 'unexpected_binary' WHEN payload AND strlen(coalesce(props, '')) > 8 THEN 'payload_too_large'
            WHEN header AND event_id > waiting THEN 'previous_header_unpaired' WHEN event_type = 'view' THEN 'invalid_request' END AS code FROM f"""
)
def message_pairs(spark, d):
    kind, code = (F.create_map(*(F.lit(x) for k, v in _MESSAGES_OF_USERS.items() for x in (k, v[i])))[F.col("event_type")] for i in (0, 1))
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("connection_id"), F.col("event_id").alias("seq"), kind.alias("kind"), code.alias("code"), F.coalesce("props", F.lit("")).alias("content"))
    return readers.pair_messages(e, limit=8).select("connection_id", "seq", "header_seq", "code")


#: Half a day: users' events are about eleven hours apart.
_WAIT = 43_200_000


@query(
    f"""WITH RECURSIVE m AS (SELECT user_id::VARCHAR c, event_id seq, epoch_ms(ts) t, event_type e, event_id % 3 size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events),
    s AS (SELECT DISTINCT c, 0::BIGINT rn, NULL::BIGINT seq, NULL::BIGINT h, NULL::BIGINT ht, NULL::BIGINT b, NULL::BIGINT bt, NULL::VARCHAR kind, NULL::BIGINT hseq, NULL::VARCHAR code, NULL::BIGINT lh, NULL::BIGINT lb FROM m
    UNION ALL SELECT c, rn, seq,
        CASE WHEN reset THEN NULL WHEN e IN ('click', 'signup') AND h1 IS NULL THEN seq WHEN e = 'purchase' AND b1 IS NULL THEN NULL ELSE h1 END,
        CASE WHEN reset THEN NULL WHEN e IN ('click', 'signup') AND h1 IS NULL THEN t WHEN e = 'purchase' AND b1 IS NULL THEN NULL ELSE ht1 END,
        CASE WHEN reset OR e = 'purchase' THEN NULL WHEN e = 'view' AND h1 IS NULL AND b1 IS NULL THEN seq ELSE b1 END,
        CASE WHEN reset OR e = 'purchase' THEN NULL WHEN e = 'view' AND h1 IS NULL AND b1 IS NULL THEN t ELSE bt1 END,
        CASE WHEN e = 'purchase' THEN 'payload' WHEN e = 'view' THEN 'infer_batch' WHEN e = 'error' THEN CASE WHEN reset THEN 'reset' ELSE 'dance' END ELSE 'infer_header' END,
        CASE WHEN e = 'purchase' THEN coalesce(b1, h1) END,
        CASE WHEN e = 'purchase' THEN CASE WHEN b1 IS NULL AND h1 IS NULL THEN 'unexpected_binary' WHEN size > 1 THEN 'payload_too_large' WHEN b1 IS NOT NULL AND b1 % 3 <> size THEN 'payload_size_mismatch' END
            WHEN e = 'error' THEN CASE WHEN NOT reset THEN 'unknown_type' END WHEN h1 IS NOT NULL OR (e = 'view' AND b1 IS NOT NULL) THEN 'previous_header_unpaired' END,
        CASE WHEN h1 IS NULL THEN h END, CASE WHEN b1 IS NULL THEN b END
    FROM (SELECT m.*, s.h, s.b, e = 'error' AND m.seq % 2 = 0 reset, CASE WHEN t - ht <= {_WAIT} THEN h END h1, CASE WHEN t - ht <= {_WAIT} THEN ht END ht1,
        CASE WHEN t - bt <= {_WAIT} THEN b END b1, CASE WHEN t - bt <= {_WAIT} THEN bt END bt1 FROM s JOIN m ON m.c = s.c AND m.rn = s.rn + 1)),
    ends AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY rn DESC) = 1), now AS (SELECT max(t) t FROM m),
    late AS (SELECT c, lh AS seq FROM s UNION ALL SELECT c, lb FROM s UNION ALL SELECT c, h FROM ends, now WHERE now.t - ht > {_WAIT} UNION ALL SELECT c, b FROM ends, now WHERE now.t - bt > {_WAIT})
    SELECT c AS connection_id, seq, kind, hseq AS header_seq, code FROM s WHERE rn > 0
    UNION ALL SELECT c, seq, 'timeout', seq, 'header_timeout' FROM late WHERE seq IS NOT NULL"""
)
def connection_protocol(spark, d):
    """Users as connections: clicks and signups send headers, views batch headers, purchases payloads, half of the errors resets."""
    size = F.col("event_id") % 3
    text = (
        F.when(F.col("event_type").isin("click", "signup"), F.format_string('{"type":"infer_header","request_id":"r%d","frame_id":1}', "event_id"))
        .when(F.col("event_type") == "view", F.format_string('{"type":"infer_batch","frames":[{"request_id":"b","frame_id":1}],"sizes":[%d]}', size))
        .when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, '{"type":"reset"}').otherwise('{"type":"dance"}'))
    )
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("connection_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), text.alias("message"), F.when(F.col("event_type") == "purchase", F.expr("cast(repeat('x', cast(event_id % 3 as int)) as binary)")).alias("content"))
    return connections.pair_connections(e, _WAIT, limit=1).select("connection_id", "seq", "kind", "header_seq", "code")


@query(
    """WITH gone AS (SELECT user_id, max(event_id) // 2 AS last FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT CAST(e.user_id AS VARCHAR) session_id, CAST(event_id AS INT) frame_id, event_id epoch, 'stale_session' code FROM events e JOIN gone g ON g.user_id = e.user_id WHERE event_id <= last"""
)
def stale_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("frame_id"), F.col("event_id").alias("epoch"), "event_type")
    retired = e.where("event_type = 'error'").groupBy("session_id").agg(F.floor(F.max("epoch") / 2).alias("epoch"))
    return stateful.stale(e, retired)


@query("""SELECT 'r' || event_id request_id, '{"type":"error","request_id":"r' || event_id || '","error":"' || CASE event_type WHEN 'error' THEN 'the queue is full","code":"queue_full"}' WHEN 'click' THEN 'invalid request","code":"invalid_request"}' ELSE 'Processing failed"}' END message FROM events""")
def error_messages(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("r"), "event_id").alias("request_id"), F.when(F.col("event_type") == "error", "queue_full").when(F.col("event_type") == "click", "invalid_request").alias("code"))
    return sinks.errors(e)


@query(f"WITH {_CORNERS} SELECT frame_id, count(*) n, sum(det_idx) idx_sum, sum(bx) bx_sum FROM boxed GROUP BY ALL")
def result_messages(spark, d):
    """Frames' messages, read again."""
    g = decode.named(decode.with_geometry(_image(spark, d)), decode.CLASS_NAMES).withColumn("track_id", F.col("det_idx"))
    frames = g.select("session_id", "frame_id").distinct().withColumns({"request_id": F.col("frame_id").cast("string"), "timing": F.struct(F.lit(1.5).alias("total_ms"))})
    back = F.from_json("message", "detections array<struct<track_id:int,bbox:array<int>,obb:array<double>>>")["detections"]
    total = lambda f: F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return sinks.results(g, frames).select("frame_id", back.alias("d")).select("frame_id", F.size("d").cast("long").alias("n"), total(lambda x: x["track_id"]).alias("idx_sum"), total(lambda x: x["bbox"][0]).alias("bx_sum"))


@query(
    f"""WITH {_CORNERS} SELECT 'result' AS "type", frame_id::VARCHAR request_id, frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY det_idx) - 1 AS INT) place, CAST(det_idx AS INT) track_id, CAST(class_id AS INT) class_id,
        {_list(decode.CLASS_NAMES)}[CAST(class_id AS INT) + 1] class_name, round(confidence, 6) confidence, round(angle, 6) angle,
        round(x0, 5) x0, round(y0, 5) y0, round(x1, 5) x1, round(y1, 5) y1, round(x2, 5) x2, round(y2, 5) y2, round(x3, 5) x3, round(y3, 5) y3, bx, by_ AS "by", bw, bh,
        CASE WHEN det_idx % 2 = 0 THEN round(cx / 2, 5) END ground_x, 1.5::DOUBLE total_ms FROM boxed"""
)
def result_details(spark, d):
    """Every field of every message, read again; every other detection has a place on the ground."""
    g = decode.named(decode.with_geometry(_image(spark, d)), decode.CLASS_NAMES).withColumns({"track_id": F.col("det_idx"), "ground_x": F.when(F.col("det_idx") % 2 == 0, F.col("cx") / 2)})
    frames = g.select("session_id", "frame_id").distinct().withColumns({"request_id": F.col("frame_id").cast("string"), "timing": F.struct(F.lit(1.5).alias("total_ms"))})
    kind = "type string, request_id string, frame_id long, detections array<struct<track_id:int,class_id:int,class_name:string,confidence:double,angle:double,obb:array<double>,bbox:array<int>,ground_x:double>>, timing struct<total_ms:double>"
    back = sinks.results(g, frames).select(F.from_json("message", kind).alias("m")).select("m.*").select("*", F.posexplode("detections").alias("place", "d"))
    obb = [r(F.get("d.obb", 2 * i + j), 5).alias(f"{k}{i}") for i in range(4) for j, k in enumerate("xy")]
    box = [F.get("d.bbox", i).alias(f"b{k}") for i, k in enumerate("xywh")]
    return back.select("type", "request_id", "frame_id", "place", "d.track_id", "d.class_id", "d.class_name", r("d.confidence").alias("confidence"), r("d.angle").alias("angle"), *obb, *box, r("d.ground_x", 5).alias("ground_x"), "timing.total_ms")


def _exchange(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    requests = e.select("user_id", F.col("event_id").alias("request_id"), (F.col("event_id") * 0.1).alias("sent"))
    responses = e.where("event_id % 4 <> 3").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 0.1 + F.col("value") / 1000).alias("received"), (F.col("event_id") % 100 * 1.0).alias("total_ms"))
    return readers.responses_in_time(requests, responses, e.where("event_id % 10 = 0").select(F.col("event_id").alias("request_id")))


_EXCHANGE = "SELECT user_id, event_id request_id, event_id * 0.1::DOUBLE + value / 1000 received, (event_id * 0.1::DOUBLE + value / 1000 - event_id * 0.1::DOUBLE) * 1000 latency_ms, event_id % 100 * 1.0::DOUBLE total_ms FROM events WHERE event_id % 4 <> 3 AND event_id % 10 <> 0"


@query(f"SELECT request_id, round(latency_ms, 4) latency_ms, round(greatest(0, latency_ms - total_ms), 4) overhead_ms FROM ({_EXCHANGE})")
def response_latency(spark, d):
    return _exchange(spark, d).select("request_id", r("latency_ms", 4).alias("latency_ms"), r("overhead_ms", 4).alias("overhead_ms"))


@query(f"SELECT user_id, round(count(*) / (max(received) - min(received)), 6) fps FROM ({_EXCHANGE}) GROUP BY ALL HAVING max(received) - min(received) > 0.5")
def response_rate(spark, d):
    return kinematics.rate(_exchange(spark, d), "received", ["user_id"]).withColumn("fps", r("fps"))


@query(f"WITH {OBSERVATIONS_SQL} SELECT event_id, round(greatest(0.3, least(0.7, confidence)), 6) confidence FROM obs")
def clamp_overrides(spark, d):
    return observations(spark, d).select("event_id", r(config.clamped("confidence", 0.3, 0.7)).alias("confidence"))


# Files.

_GROUND = f"SELECT *, {persp_sql('px', 'py')[0]} gx, {persp_sql('px', 'py')[1]} gy FROM tracks"


def fixed_sql(x: str, places: int) -> str:
    return f"CAST(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12)) AS DECIMAL(38,{places}))::VARCHAR"


_PIXELS = f"track_id, frame_id, {fixed_sql('px', 1)} pixel_x, {fixed_sql('py', 1)} pixel_y, CASE WHEN track_id % 2 = 0 THEN {fixed_sql('gx', 3)} END ground_x, CASE WHEN track_id % 2 = 0 THEN {fixed_sql('gy', 3)} END ground_y"


@query(with_tracks(f"SELECT {_PIXELS}, NULL::VARCHAR lat, NULL::VARCHAR lon FROM ({_GROUND})"))
def vehicle_csv(spark, d):
    return _vehicles(tracks(spark, d))


@query(with_tracks(f"SELECT {_PIXELS}, CASE WHEN track_id % 2 = 0 THEN {fixed_sql(_GG['lat'], 8)} END lat, CASE WHEN track_id % 2 = 0 THEN {fixed_sql(_GG['lon'], 8)} END lon FROM (SELECT *, {_O['easting']} oe, {_O['northing']} onn, {_O['zone']} oz FROM ({_GROUND}))"))
def vehicle_csv_all(spark, d):
    """Every track point, with its place on the earth."""
    return _vehicles(tracks(spark, d), ORIGIN)


def _vehicles(t, origin=None):
    t = t.withColumn("g", geo.perspective("px", "py", H)).withColumns({k: F.when(F.col("track_id") % 2 == 0, F.col(f"g.{k[-1]}")) for k in ("ground_x", "ground_y")})
    return sinks.vehicle_rows(geo.with_places(t, origin) if origin else t)


_MOVED = f"""SELECT *, px - lag(px) OVER w dx, py - lag(py) OVER w dy, frame_time - lag(frame_time) OVER w dt, gx - lag(gx) OVER w dgx, gy - lag(gy) OVER w dgy, {_GG['lon']} lon, {_GG['lat']} lat
    FROM (SELECT *, {_O['easting']} oe, {_O['northing']} onn, {_O['zone']} oz FROM ({_GROUND})) WINDOW w AS (PARTITION BY session_id, track_id ORDER BY frame_id)"""


@query(
    with_tracks(f"""SELECT track_id vehicle_id, event_type vehicle_type, frame_time "timestamp", strftime(make_timestamp(CAST(frame_time * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') system_time, px pixel_x, py pixel_y,
        round(gx, 5) ground_x, round(gy, 5) ground_y, round(lon, 7) longitude, round(lat, 7) latitude, round(CASE WHEN dt > 0 THEN sqrt(dx*dx + dy*dy) / dt END, 6) speed_px_s, round(CASE WHEN dt > 0 THEN sqrt(dgx*dgx + dgy*dgy) / dt END, 6) speed_ms,
        round(CASE WHEN dt > 0 THEN CASE WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END END, 6) direction_deg,
        px - 4 corner1_x, py - 2 corner1_y, px + 4 corner2_x, py - 2 corner2_y, px + 4 corner3_x, py + 2 corner3_y, px - 4 corner4_x, py + 2 corner4_y FROM ({_MOVED})""")
)
def trajectory_export_all(spark, d):
    """All 21 columns, with metres a second over the ground."""
    t = tracks(spark, d).withColumns({"class_name": F.col("event_type"), "corners": geometry.rect_corners(F.col("px") - 4, F.col("py") - 2, F.col("px") + 4, F.col("py") + 2), "cx": F.col("px"), "cy": F.col("py")})
    out = sinks.trajectory_rows(kinematics.kinematics(geo.geo_stage(t, H, ORIGIN)))
    places = {"ground_x": 5, "ground_y": 5, "longitude": 7, "latitude": 7, "speed_px_s": 6, "speed_ms": 6, "direction_deg": 6}
    return out.withColumns({c: r(c, n) for c, n in places.items()})


@query(with_tracks(f"SELECT track_id vehicle_id, event_type vehicle_type, strftime(make_timestamp(CAST(frame_time * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') system_time, px pixel_x, round(CASE WHEN dt > 0 THEN sqrt(dx*dx + dy*dy) / dt END, 6) speed_px_s, px - 4 corner1_x, py + 2 corner3_y FROM ({_STEP.format(s='', f='lag')})"))
def trajectory_export(spark, d):
    t = kinematics.kinematics(tracks(spark, d)).withColumns({"class_name": F.col("event_type"), "corners": geometry.rect_corners(F.col("px") - 4, F.col("py") - 2, F.col("px") + 4, F.col("py") + 2)})
    return sinks.trajectory_rows(t).select("vehicle_id", "vehicle_type", "system_time", "pixel_x", r("speed_px_s").alias("speed_px_s"), "corner1_x", "corner3_y")


@query("SELECT p_partkey id, printf('%.8e', p_size / 7.0::DOUBLE) || ' ' || printf('%.8e', p_retailprice::DOUBLE) || ' ' || printf('%.8e', 0::DOUBLE) AS \"line\" FROM part")
def homography_export(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    h = F.array((F.col("p_size") / 7).cast("double"), F.col("p_retailprice").cast("double"), *[F.lit(0.0)] * 6, F.lit(1.0))
    return p.select(F.col("p_partkey").alias("id"), F.split(sinks.homography_text_column(h), "\n")[0].alias("line"))


@query("SELECT p_partkey id, round(p_size / 4.0::DOUBLE, 6) a, round(p_partkey / 4.0::DOUBLE, 6) b, p_size % 5 <> 0 good FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, false FROM part WHERE p_size % 5 = 0")
def homography_parse(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit("[["), "p_size", F.lit(", "), "p_partkey", F.lit(" 0], [0 1e0, -0.5\n"), F.when(F.col("p_size") % 5 == 0, "]").otherwise("0; 0 4]"))
    return p.select(F.col("p_partkey").alias("id"), readers.homography_column(text).alias("h")).select("id", r(F.get("h", 0)).alias("a"), r(F.get("h", 1)).alias("b"), F.col("h").isNotNull().alias("good"))


@query("SELECT p_partkey id, printf('%.8e', p_size / 7.0::DOUBLE) || ' ' || printf('%.8e', p_retailprice::DOUBLE) || ' ' || printf('%.8e', -p_size::DOUBLE) || chr(10) || printf('%.8e', p_partkey / 1000000.0::DOUBLE) || ' 0.00000000e+00 0.00000000e+00' || chr(10) || '0.00000000e+00 0.00000000e+00 1.00000000e+00' AS \"text\" FROM part")
def homography_files(spark, d):
    """Whole files of three lines."""
    p = spark.read.parquet(f"{d}/part.parquet")
    h = F.array(*(c.cast("double") for c in (F.col("p_size") / 7, F.col("p_retailprice"), -F.col("p_size"), F.col("p_partkey") / 1000000)), *[F.lit(0.0)] * 4, F.lit(1.0))
    return p.select(F.col("p_partkey").alias("id"), sinks.homography_text_column(h).alias("text"))


@query(
    "SELECT p_partkey id, " + ", ".join(f"CASE WHEN p_size % 5 <> 0 THEN round({v} / 4::DOUBLE, 6) END h{i}" for i, v in enumerate(("p_size", "p_partkey", "0", "0", "1", "-0.5", "0", "0", "4"))) + " FROM part"
)
def homography_numbers(spark, d):
    """All nine numbers, scaled; none where there are eight."""
    p = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit("[["), "p_size", F.lit(", "), "p_partkey", F.lit(" 0], [0 1e0, -0.5\n"), F.when(F.col("p_size") % 5 == 0, "]").otherwise("0; 0 4]"))
    return p.select(F.col("p_partkey").alias("id"), readers.homography_column(text).alias("h")).select("id", *(r(F.get("h", i)).alias(f"h{i}") for i in range(9)))


@query(
    """SELECT event_id, CAST(event_id % 5 AS INT) class_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0.5 END::DOUBLE confidence, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS INT) END track_id,
        CASE WHEN event_id % 3 = 1 THEN (trunc(0.1::DOUBLE*640)+trunc(0.2::DOUBLE*640)+trunc(0.25::DOUBLE*640)+trunc(0.15::DOUBLE*640))/4 ELSE (trunc((x - 0.125::DOUBLE)*640) + trunc((x + 0.125::DOUBLE)*640))/2 END px
        FROM (SELECT event_id, (20 + event_id % 60) / 100::DOUBLE x FROM events WHERE event_id % 7 <> 0)"""
)
def label_parse(spark, d):
    x = "format_string('%.2f', (20 + event_id % 60) / 100)"
    line = f"""CASE WHEN event_id % 7 = 0 THEN '1 2 x 4 5 6 7' WHEN event_id % 3 = 0 THEN concat(event_id % 5, ' ', {x}, '  0.5 0.25 0.25 0.5 ', event_id % 50)
        WHEN event_id % 3 = 1 THEN concat(' ', event_id % 5, ' 0.1 0.1 0.2 0.1 0.25 0.2 0.15 0.2 0.5 -1') ELSE concat(event_id % 5, ' ', {x}, ' 0.5 0.25 0.25') END"""
    lines = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(line).alias("value"))
    return readers.parse_labels(lines, 640, 480).select("event_id", "class_id", "confidence", "track_id", "px")


@query("SELECT c_custkey % 100 / 4.0::DOUBLE image_x, c_nationkey * 1.0::DOUBLE image_y, 0.0::DOUBLE lon, c_custkey * 1.0::DOUBLE lat FROM customer WHERE c_custkey % 3 <> 0")
def control_point_import(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return readers.resolve_control_points(c.select((F.col("c_custkey") % 100 / 4).cast("string").alias(" U"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).otherwise("?").alias("image_y"), F.lit("-").alias("Longitude"), F.col("c_custkey").cast("string").alias("lat")))


_VALID = f"""valid AS (SELECT event_id frame, {persp_sql('value', 'k')[0]} pgx, {persp_sql('value', 'k')[1]} pgy, {_N['easting']} - {_O['easting']} tgx, {_N['northing']} - {_O['northing']} tgy,
    value img_x, k img_y, lon, lat, {_O['easting']} oe, {_O['northing']} onn, {_O['zone']} oz
    FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 k, 121.47::DOUBLE + value / 100000 lon, 31.23::DOUBLE + event_id % 50 / 100000::DOUBLE lat FROM events))"""


def _validated(spark, d):
    o = observations(spark, d)
    points = o.select(F.col("event_id").alias("frame"), F.col("px").alias("image_x"), F.col("py").alias("image_y"), (F.lit(121.47) + F.col("px") / 100000).alias("lon"), (F.lit(31.23) + F.col("event_id") % 50 / 100000).alias("lat"))
    return calibrate.validate(points, H, ORIGIN)


@query(f"WITH {_VALID} SELECT frame, round(pgx, 4) pred_gx, round(tgy, 4) true_gy, round(sqrt(power(pgx - tgx, 2) + power(pgy - tgy, 2)), 4) error_m FROM valid")
def validate_points(spark, d):
    return _validated(spark, d).select("frame", r("pred_gx", 4).alias("pred_gx"), r("true_gy", 4).alias("true_gy"), r("error_m", 4).alias("error_m"))


_V = lonlat_sql("pgx + oe", "pgy + onn", "oz", "true")


@query(
    f"WITH {_VALID} SELECT frame, img_x, img_y, round(pgx, 4) pred_gx, round(pgy, 4) pred_gy, round({_V['lon']}, 7) pred_lon, round({_V['lat']}, 7) pred_lat, round(tgx, 4) true_gx, round(tgy, 4) true_gy, round(lon, 7) true_lon, round(lat, 7) true_lat, round(sqrt(power(pgx - tgx, 2) + power(pgy - tgy, 2)), 4) error_m FROM valid"
)
def validation_csv(spark, d):
    """All twelve columns."""
    places = {c: 4 for c in ("pred_gx", "pred_gy", "true_gx", "true_gy", "error_m")} | {c: 7 for c in ("pred_lon", "pred_lat", "true_lon", "true_lat")}
    return _validated(spark, d).withColumns({c: r(c, n) for c, n in places.items()})


@query(f"WITH {_VALID} SELECT round(sqrt(avg(power(pgx - tgx, 2) + power(pgy - tgy, 2))), 3) rmse_m, count(*) points FROM valid")
def rmse(spark, d):
    return calibrate.rmse(_validated(spark, d)).select(r("rmse_m", 3).alias("rmse_m"), "points")


_PAIRS_SQL = f"WITH {_VALID} SELECT a.frame \"first\", b.frame \"second\", round(sqrt(power(a.pgx - b.pgx, 2) + power(a.pgy - b.pgy, 2)), 4) pred_m, round(sqrt(power(a.tgx - b.tgx, 2) + power(a.tgy - b.tgy, 2)), 4) true_m FROM valid a JOIN valid b ON b.frame = a.frame + 7"


@query(_PAIRS_SQL)
def pair_distances(spark, d):
    return _pairs(*[_validated(spark, d)] * 2)


@query(_PAIRS_SQL)
def pair_distances_all(spark, d):
    """A pair begins with every validated point that has one seven frames later."""
    v = _validated(spark, d)
    return _pairs(v, v)


def _pairs(v, starts):
    pairs = starts.select(F.col("frame").alias("first"), (F.col("frame") + 7).alias("second"))
    return calibrate.pair_distances(v, pairs).select("first", "second", r("pred_m", 4).alias("pred_m"), r("true_m", 4).alias("true_m"))
