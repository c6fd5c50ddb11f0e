"""What holds for any number of lanes, files and passes, against one after the other."""

import math
import random

import pytest
from kerbside.functions import geo
from kerbside.operators import kinematics, lanes
from kerbside.shared import numbered
from kerbside.streaming import stateful
from pyspark.sql import functions as F

LANES = "lane_id int, name string, polygon array<struct<x:double,y:double>>, visible boolean"
TRACKS = "session_id string, track_id int, frame_id int, px double, py double, frame_time double"


def inside(x, y, p):
    odd = False
    for (ax, ay), (bx, by) in zip(p, p[-1:] + p[:-1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def scene(spark, n_lanes, n_points, seed=0):
    rng = random.Random(seed)
    polygons = []
    for i in range(n_lanes):
        cx, cy, r = rng.uniform(-50, 550), rng.uniform(-50, 1050), rng.choice([0.3, 5, 20, 300])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 4, 9])))
        polygons.append([(cx + r * rng.uniform(0.3, 1) * math.cos(t), cy + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns])
    polygons[0] = [(0.0, 0.0), (256.0, 0.0), (256.0, 128.0), (0.0, 128.0)]  # edges on the borders of cells
    polygons[1] = [(64.0, 64.0), (128.0, 64.0)]
    points = [(rng.choice([0, 32, 64, 128, 256]) * 1.0, rng.choice([0, 32, 64, 128]) * 1.0) if i % 5 == 0 else (rng.uniform(0, 490), rng.uniform(0, 990)) for i in range(n_points)]
    table = spark.createDataFrame([(i, f"l{i}", p, i % 50 != 7) for i, p in enumerate(polygons)], LANES)
    rows = [("s", i % 20, i // 20, x, y, i / 10) for i, (x, y) in enumerate(points)]
    used = {i: p for i, p in enumerate(polygons) if len(p) > 2 and i % 50 != 7}
    return table, spark.createDataFrame(rows, TRACKS), rows, used


def test_any_number_of_lanes(spark):
    table, tracks, rows, used = scene(spark, 3000, 400)
    want = {(i, r[1], r[2]) for r in rows for i, p in used.items() if inside(r[3], r[4], p)}
    assert {(r.lane_id, r.track_id, r.frame_id) for r in lanes.inside_only(tracks, table).collect()} == want
    assert lanes.grid(table).where("whole").count() > 1000 and lanes.grid(table).groupBy("lane_id").count().agg(F.max("count")).first()[0] <= (lanes.ACROSS * 2 + 1) ** 2


def test_figures_of_lanes_are_those_of_all_pairs(spark):
    table, tracks, _, _ = scene(spark, 60, 700, 1)
    still = kinematics.stationary(tracks, max_path=9000)
    pairs = lanes.lane_observations(still, table)
    for now, age in ((None, None), (34, 0)):
        flows = {r.lane_id: (r.flow_count, r.queue_count) for r in lanes.occupancy(pairs, now=now, max_age=age).collect()}
        passes = {r.lane_id: r.pass_count for r in lanes.pass_counts(pairs).collect()}
        got = lanes.lane_figures(still, table, now=now, max_age=age).collect()
        assert len(got) == 60 and sum(r.flow_count for r in got) > 0
        assert all((r.pass_count, r.flow_count, r.queue_count) == (passes.get(r.lane_id, 0), *flows.get(r.lane_id, (0, 0))) for r in got)
    key = lambda r: (r.lane_id, r.track_id, r.frame_id)
    assert sorted(map(key, lanes.entries_inside(tracks, table).collect())) == sorted(map(key, lanes.entries(pairs).collect()))
    assert lanes.lane_figures(still, table.limit(0)).count() == 0 and lanes.inside_only(tracks.limit(0), table).count() == 0


def test_places_in_order(spark):
    rng = random.Random(2)
    names = [(f"n{rng.randrange(300):03}", i) for i in range(1000)]
    got = numbered(spark.createDataFrame(names, "name string, i int").repartition(7), ["name", "i"], "at").collect()
    assert [(r.name, r.i) for r in sorted(got, key=lambda r: r["at"])] == sorted(names) and sorted(r["at"] for r in got) == list(range(1000))
    assert numbered(spark.createDataFrame([], "name string"), ["name"], "at").columns == ["name", "at"]


def test_one_place_as_a_column(spark):
    for lon, lat in ((121.47, 31.23), (-79.4, -43.6), (180.0, 0.0), (-180.0, 64.5)):
        u = spark.range(1).select(geo.to_utm(F.lit(lon), F.lit(lat)).alias("u")).first().u
        assert geo.utm_of(lon, lat) == (pytest.approx(u.easting, abs=1e-6), pytest.approx(u.northing, abs=1e-6), u.zone, u.north)
        ground = spark.createDataFrame([(3.5, -70.25)], "ground_x double, ground_y double")
        steps, once = geo.with_places(ground, (lon, lat)).first(), ground.select(geo.from_ground("ground_x", "ground_y", F.lit(lon), F.lit(lat)).alias("p")).first().p
        assert (steps.lon, steps.lat) == (pytest.approx(once.lon, abs=1e-12), pytest.approx(once.lat, abs=1e-12))


def test_a_track_passes_once_in_a_stream(spark, tmp_path):
    kind = "lane_id int, session_id string, track_id int, t long"
    parts = [
        [(1, "s", 1, 0), (1, "s", 1, 1), (1, "s", 2, 30), (2, "s", 1, 40)],
        [(1, "s", 1, 100), (1, "s", 2, 20), (1, "s", 3, 110)],  # again, and late
        [(1, "s", 1, 400), (1, "s", 9, 2000)],
        [(1, "s", 9, 2001)],
        [(1, "s", 4, 90), (1, "s", 1, 2100), (3, "s", 5, 9000)],  # too late; away for long, and so passes anew; the last one closes windows
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).select("lane_id", "session_id", "track_id", F.timestamp_seconds("t").alias("pass_time")).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    import os

    os.makedirs(tmp_path / "flat")
    for k in range(len(parts)):
        for f in os.listdir(tmp_path / "in" / f"p={k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / "in" / f"p={k}" / f, tmp_path / "flat" / f"{k}.parquet")
                os.utime(tmp_path / "flat" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("lane_id int, session_id string, track_id int, pass_time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    rate = stateful.pass_rate(stream, window="600 seconds", slide="600 seconds", late="600 seconds")
    q = rate.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120) and q.exception() is None
    got = {(r.lane_id, r.window.start.timestamp()): (r.passes, r.per_hour) for r in spark.read.schema(rate.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0.0): (3, 18.0), (2, 0.0): (1, 6.0), (1, 1800.0): (2, 12.0)}
