"""Boundary cases of columns and plans."""

import json
import math
import random
import warnings

import numpy as np
import pytest
from kerbside.functions import geo, geometry
from kerbside.operators import calibrate, decode, kinematics, lanes, nms
from kerbside.plans import config, registry
from kerbside.sources import readers, sinks
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
ELL = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]


@pytest.mark.parametrize(
    "x, y, points, half_open, inclusive",
    [(5, 5, SQUARE, True, True), (11, 5, SQUARE, False, False), (0, 5, SQUARE, True, True), (10, 5, SQUARE, False, True), (10, 10, SQUARE, False, True), (5, 10, SQUARE, False, True), (7, 7, ELL, False, False), (2, 7, ELL, True, True), (4, 7, ELL, False, True), (1, 1, SQUARE[:2], False, False)],
)
def test_point_in_polygon(spark, x, y, points, half_open, inclusive):
    p = geometry.polygon_literal(points)
    assert value(spark, geometry.in_polygon(float(x), float(y), p)) is half_open
    assert value(spark, geometry.in_polygon(float(x), float(y), p, inclusive=True)) is inclusive


def test_convex_overlap_against_samples():
    rng = np.random.default_rng(4)
    for _ in range(15):
        a, b = np.concatenate([rng.random((2, 2)) * 20, rng.random((2, 2)) * 30 + 5, rng.random((2, 1)) * 180], axis=1)
        grid = np.stack(np.meshgrid(np.linspace(-40, 60, 400), np.linspace(-40, 60, 400)), -1).reshape(-1, 2)

        def inside(box):
            t = math.radians(box[4])
            d = (grid - box[:2]) @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
            return (np.abs(d) <= box[2:4] / 2).all(1)

        p, q = inside(a), inside(b)
        assert geometry.rotated_iou(a, b) == pytest.approx((p & q).sum() / (p | q).sum(), abs=0.02)
    assert geometry.rotated_iou(np.array([0, 0, 0.5, 9, 0.0]), np.array([0, 0, 0.5, 9, 0.0]), 1.0) == 0
    assert geometry.polygon_area(geometry.convex_intersection(geometry.corners_of(a)[0], geometry.corners_of(a)[0])) == pytest.approx(a[2] * a[3])


def test_suppression(spark):
    rng = np.random.default_rng(2)
    boxes = np.column_stack([rng.random((40, 2)) * 60, rng.random((40, 2)) * 20 + 5, rng.random(40) * 180])
    scores = rng.random(40)
    for rotated in (True, False):
        stay = nms.survivors(boxes, scores, 0.3, rotated)
        assert sorted(nms.survivors(boxes[stay], scores[stay], 0.3, rotated)) == list(range(len(stay)))
    stay = nms.survivors(boxes, scores, 0.3)
    slow = []
    for i in np.argsort(-scores):
        if all(not (geometry.aabb_overlap(geometry.aabb(boxes[[i]]), geometry.aabb(boxes[[j]]))[0, 0] and geometry.rotated_iou(boxes[j], boxes[i]) > 0.3) for j in slow):
            slow.append(i)
    assert stay.tolist() == slow
    rows = [("s", 1 + i % 2, i, *map(float, boxes[i]), float(scores[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double")
    flat = {(r.frame_id, r.det_idx) for r in nms.suppress(df, 0.3).collect()}
    frames = df.groupBy("session_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", "cx", "cy", "w", "h", "angle", "confidence"))).alias("detections"))
    assert {(r.frame_id, d.det_idx) for r in nms.suppress_frames(frames, 0.3).collect() for d in r.detections} == flat
    assert nms.suppress(df, 0.3, end_to_end=True).count() == 40


def test_utm_against_published_coordinates(spark):
    """The Eiffel Tower and the CN Tower as their articles give them, and the latter's mirror in the south."""
    for lon, lat, zone, e, n in ((2.2945, 48.8582, 31, 448252, 5411933), (-79.387139, 43.642567, 17, 630084, 4833438), (-79.387139, -43.642567, 17, 630084, 10000000 - 4833438)):
        u = value(spark, geo.to_utm(F.lit(lon), F.lit(lat)))
        assert u.zone == zone and u.north == (lat > 0)
        assert abs(u.easting - e) < 60 and abs(u.northing - n) < 60


def test_utm_round_trip_and_borders(spark):
    rows = spark.createDataFrame([(lo, la) for lo in (-180.0, -177.1, 0.0, 5.999, 6.0, 179.9, 180.0) for la in (-79.0, -0.001, 0.0, 31.2, 80.0)], "lon double, lat double")
    u = rows.withColumn("u", geo.to_utm("lon", "lat")).withColumn("b", geo.from_utm("u.easting", "u.northing", "u.zone", "u.north"))
    for r in u.collect():
        assert 1 <= r.u.zone <= 60
        turn = (r.b.lon - r.lon + 180) % 360 - 180
        if abs(r.lon - (r.u.zone * 6 - 183)) <= 3.001:
            assert math.hypot(turn * math.cos(math.radians(r.lat)), r.b.lat - r.lat) * 111320 < 1e-3
    assert value(spark, geo.from_ground(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) is None
    assert value(spark, geo.from_ground(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is not None  # an origin like any other


def test_undistort_round_trip(spark):
    camera = geo.Camera((800.0, 0, 320, 0, 810.0, 240, 0, 0, 1), (-0.1, 0.01, 0.001, -0.001, 0.0))
    x, y = (300 - 320) / 800, (100 - 240) / 810
    q = x * x + y * y
    radial = 1 - 0.1 * q + 0.01 * q * q
    dx, dy = x * radial + 2 * 0.001 * x * y - 0.001 * (q + 2 * x * x), y * radial + 0.001 * (q + 2 * y * y) - 2 * 0.001 * x * y
    p = value(spark, geo.undistorted(F.lit(dx * 800 + 320), F.lit(dy * 810 + 240), camera))
    assert (p.x, p.y) == (pytest.approx(300, abs=1e-4), pytest.approx(100, abs=1e-4))
    same = value(spark, geo.undistorted(F.lit(7.0), F.lit(8.0), geo.Camera(camera.matrix)))
    assert (same.x, same.y) == (pytest.approx(7), pytest.approx(8))
    assert value(spark, geo.perspective(F.lit(1.0), F.lit(1.0), (1, 0, 0, 0, 1, 0, 1, 0, -1))) is None


def tracks(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "session_id string, track_id int, frame_id int, frame_time double, px double, py double")


@pytest.mark.parametrize("compat", [False, True])
def test_headings_of_steps_along_the_axes_and_nowhere(spark, compat):
    """As in the queries' SQL, where -(x - x) is -0.0."""
    import duckdb
    from kerbside import queries

    way = [(5.0, 5.0), (5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 6.0), (5.0, 5.0), (0.0, 0.0), (-0.0, 0.0), (-0.0, -0.0), (0.0, 0.0)]
    t = tracks(spark, [(1, i, float(i), x, y) for i, (x, y) in enumerate(way)])
    con = duckdb.connect()
    con.register("tracks", t.toArrow())
    step = queries._STEP.format(**({"s": "-", "f": "lead"} if compat else {"s": "", "f": "lag"}))
    want = {n: (speed, heading) for _, _, n, speed, heading in con.sql(queries._SPEED.format(step=step)).fetchall()}
    got = kinematics.kinematics(t, compat=compat).select("frame_id", queries.r("speed_px_s"), queries.r("heading_deg")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
    assert want[0][1] == (180 if compat else None)


def test_kinematics_boundaries(spark):
    t = tracks(spark, [(1, 1, 0.0, 0.0, 0.0), (1, 2, 1.0, 3.0, 4.0), (1, 3, 1.0, 9.0, 4.0), (1, 4, 0.5, 9.0, 9.0), (2, 1, 0.0, 0.0, 0.0), (2, 2, 1.0, 0.0, -1.0), (2, 3, 2.0, -1.0, -1.0), (2, 4, 3.0, -1.0, 0.0)])
    got = {(r.track_id, r.frame_id): (r.speed_px_s, r.heading_deg, r.speed_ms) for r in kinematics.kinematics(t).collect()}
    assert got[1, 1] == (None, None, None) and got[1, 2][0] == 5 and got[1, 3][0] is None and got[1, 4][0] is None
    assert [got[2, f][1] for f in (2, 3, 4)] == [270, 180, 90]
    g = t.withColumns({"ground_x": F.when(F.col("frame_id") < 3, F.col("px")), "ground_y": F.col("py")})
    assert {r.frame_id: r.speed_kmh for r in kinematics.kinematics(g).where("track_id = 2").collect()} == {1: None, 2: 3.6, 3: None, 4: None}


@pytest.mark.parametrize("step, n, still", [(15 / 29 - 1e-6, 30, True), (15 / 29, 30, False), (0.0, 29, False)])
def test_stationary_boundaries(spark, step, n, still):
    t = tracks(spark, [(1, f, float(f), f * step, 0.0) for f in range(1, n + 1)])
    assert [r.stationary for r in kinematics.stationary(t).where(F.col("frame_id") == n).collect()] == [still]


def test_gaps_and_missing(spark):
    t = tracks(spark, [(1, f, 0.0, 0.0, 0.0) for f in (1, 2, 5, 9, 10)] + [(2, 12, 0.0, 0.0, 0.0)])
    assert [r.segment for r in kinematics.segments(t).where("track_id = 1").orderBy("frame_id").collect()] == [0, 0, 0, 1, 1]
    assert sorted((r.track_id, r.frame_id) for r in kinematics.missing(t).collect()) == [(1, 3), (1, 6), (1, 11)]
    assert {r.track_id for r in kinematics.visible(t, 20).collect()} == {1, 2} and {r.track_id for r in kinematics.visible(t, 21).collect()} == {2}


def test_flow_rate_boundaries(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 300.0), (1, 300.000001), (2, 5.0)], "lane_id int, first_time double")
    rate = lambda **k: sorted(r.flow_rate for r in lanes.flow_rate(p, **k).where("lane_id = 1").collect())
    assert rate() == [12, 12, 24] and rate(closed=True) == [12, 24, 24]
    assert {r.lane_id: r.flow_rate for r in lanes.flow_rate_at(p, 300.0).collect()} == {1: 12.0, 2: 12.0}


def test_flow_rate_by_stretches_of_time(spark):
    times = random.Random(5).choices(range(-900, 3000), k=400)
    p = spark.createDataFrame([(k % 2, k, float(t)) for k, t in enumerate(times)] + [(0, 400, None), (0, 401, None)], "lane_id int, id int, first_time double")
    for closed in (False, True):
        got = {r.id: r.flow_rate for r in lanes.flow_rate(p, closed=closed).where("first_time is not null").collect()}
        assert got == {k: 12.0 * sum(k % 2 == j % 2 and (0 <= t - u < 300 or closed and t - u == 300) for j, u in enumerate(times)) for k, t in enumerate(times)}
        assert lanes.flow_rate(p, closed=closed).count() == 402


def test_messages_are_paired_in_order(spark, monkeypatch):
    monkeypatch.setattr(readers, "STRETCH", 7)
    pick = random.Random(8)
    rows = [(c, s, *pick.choice([("header", None), ("header", None), ("header", "invalid_request"), ("payload", None), ("payload", None), ("ping", None), (None, None)]), "x" * pick.randrange(12)) for c in range(6) for s in range(90)]
    rows += [(None, 5, "payload", None, "x"), (3, None, "header", None, "x"), (9, 0, "payload", None, "")]
    want = []
    for c in {r[0] for r in rows}:
        waiting = None
        for _, s, kind, code, content in sorted((r for r in rows if r[0] == c), key=lambda r: -1 if r[1] is None else r[1]):
            paired = None
            if c is not None and s is not None and kind == "payload":
                paired, waiting = waiting, None
                code = "unexpected_binary" if paired is None else "payload_too_large" if len(content) > 10 else None
            elif c is not None and s is not None and kind == "header" and code is None:
                code, waiting = ("previous_header_unpaired", waiting) if waiting is not None else (None, s)
            want.append((c, s, paired, code))
    kinds = "connection_id int, seq int, kind string, code string, content string"
    got = [tuple(r) for r in readers.pair_messages(spark.createDataFrame(rows, kinds), limit=10).select("connection_id", "seq", "header_seq", "code").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert readers.pair_messages(spark.createDataFrame([], kinds)).count() == 0


def test_summary_is_that_of_its_parts(spark):
    pick = random.Random(3)
    t = tracks(spark, [(k, f, f / 30, pick.uniform(-5, 15), pick.uniform(-5, 15)) for k in range(8) for f in range(1, 20)]).withColumn("stationary", F.col("track_id") % 2 == 0)
    table = lanes.lane_table(spark, [(1, "a", SQUARE), (2, "empty", [(90, 90), (99, 90), (99, 99)])])
    seen = lanes.lane_observations(t, table)
    parts = lanes.pass_counts(seen).join(lanes.occupancy(seen), "lane_id").join(lanes.flow_rate_at(lanes.first_passes(seen), 100.0), "lane_id", "left").fillna(0.0)
    rows = lanes.summary(seen, table, 100.0).select("lane_id", "pass_count", "current_in_lane", "queue_count", "flow_rate_veh_h")
    assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(r) for r in parts.select("lane_id", "pass_count", "flow_count", "queue_count", "flow_rate").collect())
    assert {r.lane_id: r.flow_rate_veh_h > 0 for r in rows.collect()} == {1: True, 2: False}


def test_lanes_keep_what_vanishes_and_may_forget_it(spark):
    t = tracks(spark, [(1, 1, 0.0, 5.0, 5.0), (2, 90, 9.0, 5.0, 5.0), (2, 91, 9.1, 50.0, 5.0), (0, 92, 9.2, 5.0, 5.0)])
    seen = lanes.lane_observations(t, lanes.lane_table(spark, [(1, "a", SQUARE)]))
    assert lanes.occupancy(seen).first().flow_count == 2
    assert lanes.occupancy(seen, now=100, max_age=20).first().flow_count == 1
    assert lanes.pass_counts(seen).first().pass_count == 3
    assert sorted(r.track_id for r in lanes.inside_only(t, lanes.lane_table(spark, [(1, "a", SQUARE)]), cell=3.0).collect()) == [0, 1, 2]


def test_tensor_layouts(spark):
    def read(shape, data, **k):
        df = spark.createDataFrame([(shape, [float(v) for v in data])], "shape array<bigint>, data array<float>")
        return decode.scored(decode.boxes(df, **k), **k).orderBy("det_idx").collect()

    flat = [1, 2, 3, 4, 0.2, 0.9, 0.9, math.pi / 2]
    more = [[v + i for v in flat] for i in range(9)]
    a = read([1, 9, 8], sum(more, []))
    b = read([8, 9], [more[i][f] for f in range(8) for i in range(9)])
    assert len(a) == len(b) == 9
    assert (a[0].class_id, round(a[0].confidence, 5), round(a[0].angle, 3)) == (1, 0.9, 90.0)
    assert [r.cx for r in a] == [r.cx for r in b]
    e2e = read([1, 8, 7], [5, 6, 7, 8, 0.75, 2, 0.0] * 8)
    assert (e2e[0].class_id, e2e[0].confidence) == (2, 0.75)
    two = read([1, 8, 7], [5, 6, 7, 8, 0.75, 0.8, 0.0] * 8, layout="obb")
    assert (two[0].class_id, round(two[0].confidence, 5)) == (1, 0.8)
    low = read([1, 9, 8], [1, 2, 3, 4, -1, -0.5, -2, 0] * 9)
    assert (low[0].class_id, low[0].confidence) == (0, 0.0)
    assert read([1, 2, 3, 4], [0] * 24) == []


def test_nan_is_no_box(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.9), (nan, 2.0, 3.0, 4.0, 0.9), (1.0, 2.0, 3.0, 4.0, nan), (1.0, 2.0, 3.0, 4.0, 0.5), (1.0, 2.0, 3.0, 4.0, 0.49)], "cx double, cy double, w double, h double, confidence double")
    assert sorted(r.confidence for r in decode.kept(df).collect()) == [0.5, 0.9]


@pytest.mark.parametrize("given", [["a", "b c"], '["a", "b c"]', " a , 'b c' ,"])
def test_class_names(given):
    assert decode.class_names(given) == ["a", "b c"]
    assert decode.class_names("")[0] == "car"


def test_labels(spark):
    lines = ["2 0.1 0.1 0.2 0.1 0.2 0.2 0.1 0.2 0.7 4", "1 0.5 0.5 0.2 0.2 0.6 -3", "1 0.5 0.5 0.2 0.2", "", "x 1 2 3 4", "1 2 3", "1 2 3 4 5 6 7 8"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, value string")
    got = {r.n: r for r in readers.parse_labels(df, 100, 200).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0].kind, got[0].class_id, got[0].confidence, got[0].track_id, got[0].px, got[0].py) == ("obb", 2, 0.7, 4, 15.0, 30.0)
    assert (got[1].track_id, got[1].confidence, got[1].px, got[2].confidence) == (None, 0.6, 50.0, 1.0)
    lenient = {r.n: r for r in readers.parse_labels(df, 100, 200, lenient=True).collect()}
    assert 6 in lenient and lenient[6].confidence == 7.0


def test_label_folder(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "labels").mkdir()
    for n in ("a1", "a2", "b"):
        (tmp_path / "images" / f"{n}.jpg").write_bytes(b"x")
    (tmp_path / "labels" / "a1.txt").write_text("0 0.5 0.5 0.2 0.2 0.9 7\n0 0.1 0.1 0.1 0.1 0.8 8\n")
    (tmp_path / "labels" / "b.txt").write_text("1 0.5 0.5 0.2 0.2 0.9 7\n")
    got = sorted((r.frame_id, r.name, r.track_id) for r in readers.label_folder(spark, str(tmp_path), 100, 100).collect())
    assert [g for g in got if g[2] is not None] == [(0, "a1", 7), (0, "a1", 8), (2, "b", 7)] and (1, "a2", None) in got


def test_files_of_parameters(spark, tmp_path):
    h = readers.parse_homography("[[2, 0, 4], [0 2e0 -6]\n 0; 0; 2]")
    assert h == (1, 0, 2, 0, 1, -3, 0, 0, 1)
    with pytest.raises(ValueError):
        readers.parse_homography("1 2 3")
    np.save(tmp_path / "h.npy", np.arange(9.0).reshape(3, 3))
    assert readers.load_homography(str(tmp_path / "h.npy"))[8] == 8.0
    (tmp_path / "h.txt").write_text(sinks.homography_text(h))
    assert readers.load_homography(str(tmp_path / "h.txt")) == h
    for text in ('{"K": [[1,0,2],[0,3,4],[0,0,1]], "dist": [0.1, 0.2]}', "camera_matrix: [1,0,2,0,3,4,0,0,1]\ndist_coeffs: [0.1, 0.2]\n", "camera_matrix:\n  rows: 3\n  data: [1,0,2,0,3,4,0,0,1]\ndist:\n  data: [0.1, 0.2]\n"):
        assert readers.parse_camera(text) == geo.Camera((1, 0, 2, 0, 3, 4, 0, 0, 1), (0.1, 0.2))
    (tmp_path / "g.csv").write_text("u, v, longitude\n1, 2, 3\n4,x,5\n6, 7,\n")
    got = sorted(tuple(r) for r in readers.control_points(spark, str(tmp_path / "g.csv")).collect())
    assert got == [(1, 2, 3, 0), (6, 7, 0, 0)]


def test_batches_are_cut_and_gathered(spark):
    rows = [("s", [("a", 1), ("b", 2)], [2, 3], b"xxyyy"), ("t", [("a", 1)], [2], b"x"), ("u", [("a", 1)], [1, 2], b"xyz")]
    df = spark.createDataFrame(rows, "session_id string, frames array<struct<request_id:string,frame_id:int>>, sizes array<bigint>, content binary")
    got = sorted((r.session_id, r.idx, r.start, bytes(r.content)) for r in readers.split_batches(df).collect())
    assert got == [("s", 0, 0, b"xx"), ("s", 1, 2, b"yyy")]
    results = spark.createDataFrame([("s", 1, 1, "B"), ("s", 1, 0, "A")], "session_id string, batch_id int, idx int, result string")
    assert readers.gather_batches(results).first().results == ["A", "B"]


def test_csv_round_trip(spark, tmp_path):
    t = tracks(spark, [(1, 1, 0.0, 1.25, 2.0)]).withColumns({"ground_x": F.lit(None).cast("double"), "ground_y": F.lit(1.0), "lat": F.lit(31.123456789), "lon": F.lit(None).cast("double")})
    sinks.write_csv(sinks.vehicle_rows(t), str(tmp_path / "v"))
    text = next((tmp_path / "v").glob("*.csv")).read_text().splitlines()
    assert text == ["track_id,frame_id,pixel_x,pixel_y,ground_x,ground_y,lat,lon", "1,1,1.3,2.0,,1.000,31.12345679,"] or text[1].startswith("1,1,1.2,2.0,,1.000")


def test_config_files():
    text = '# top\nserver:\n  port: 9001\n  name: "x"\n  ratio: 0.5\n  on: true\n  list: ["a", 1]\n  odd: 1 # one\nflat: 3\n'
    c = config.parse(text)
    assert c == {"server": {"port": 9001, "name": "x", "ratio": 0.5, "on": True, "list": '["a", 1]', "odd": "1 # one"}, "flat": 3}
    assert config.lookup(c, "server.port") == 9001 and config.lookup(c, "server.port.x", 5) == 5 and config.lookup(c, "no.way") is None
    assert config.parse('{"a": {"b": 1}}') == {"a": {"b": 1}}
    assert config.server_config({"tracker": {"min_hits": 2}, "limits": {"nms_min": 0.2}})["defaults"]["tracker"]["min_hits"] == 2
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "d": 3}}) == {"a": {"c": 2, "d": 3}}


def test_plans():
    k, h = list(range(1, 10)), [1, 0, 0, 0, 1, 0, 0, 0, 1]
    request = {"features": {"tracker": False, "geo_transform": False}, "config": {"yolo": {"confidence": 7, "model_path": "x"}, "tracker": {"min_hits": 1.5, "max_time_lost": 99}, "undistort": {"camera_matrix": k, "dist_coeffs": [0]}, "geo_transform": {"homography": h, "origin_lon": 1, "origin_lat": 2}}}
    p = config.plan(request)
    assert p["pipeline"] == ["decoder", "yolo", "undistort", "geo_transform"]
    assert p["config"]["yolo"]["confidence"] == 0.95 and p["config"]["yolo"]["model_path"] == config.DEFAULTS["yolo"]["model_path"]
    assert p["config"]["tracker"]["min_hits"] == 3 and p["config"]["tracker"]["max_time_lost"] == 99
    assert config.plan(request, strict_features=True)["pipeline"] == ["decoder", "yolo"]
    assert config.plan({"pipeline": ["tracker"]})["pipeline"] == ["decoder", "yolo", "tracker"]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert config.plan({"features": {"geo_transform": True}})["pipeline"] == ["decoder", "yolo", "tracker"]
        assert w
    assert json.loads(json.dumps(p)) == p
    with pytest.raises(ValueError):
        registry.stage("nothing")
    registry.register("twice")(lambda df, c: df.unionByName(df))
    assert registry.build({"pipeline": ["twice"], "config": {}}) is not None
    assert registry.STAGES["tracker"][1] and not registry.STAGES["yolo"][1]


def test_homography_is_recovered(spark):
    rng = np.random.default_rng(9)
    h = np.array([0.02, 0.001, -3, -0.0005, 0.03, 2, 1e-5, 2e-5, 1])
    image = rng.random((40, 2)) * [1900, 1000]
    ground = np.column_stack([image, np.ones(40)]) @ h.reshape(3, 3).T
    ground = ground[:, :2] / ground[:, 2:]
    bad = ground.copy()
    bad[:12] += rng.random((12, 2)) * 200 + 20
    fit = calibrate.ransac(image, bad, seed=1)
    assert fit.inliers.sum() == 28 and not fit.inliers[:12].any() and fit.rmse < 1e-6
    assert calibrate.errors(fit.homography, image[12:], ground[12:]).max() < 1e-6
    four = calibrate.ransac(image[:4], bad[:4])
    assert four.rmse < 1e-6
    assert calibrate.ransac(np.zeros((4, 2)), np.zeros((4, 2))) is None
    with pytest.raises(ValueError):
        calibrate.solve(image[:3], ground[:3])
    lonlat = [tuple(r) for r in spark.createDataFrame([tuple(map(float, (*p, *g))) for p, g in zip(image, ground)], "image_x double, image_y double, gx double, gy double").withColumn("l", geo.from_ground("gx", "gy", F.lit(121.4), F.lit(31.2))).select("image_x", "image_y", "l.lon", "l.lat").collect()]
    points = spark.createDataFrame(lonlat, "image_x double, image_y double, lon double, lat double")
    fit = calibrate.from_control_points(points, (121.4, 31.2))
    assert fit.rmse < 1e-3
    checked = calibrate.validate(points.withColumn("frame", F.monotonically_increasing_id()), fit.homography.tolist(), (121.4, 31.2))
    assert calibrate.rmse(checked).first().rmse_m < 1e-3
