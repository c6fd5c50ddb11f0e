"""Lanes that overlap by the hundred, against one pair after the other; cells in blocks, buckets and chunks of a few rows."""

import random

import numpy as np
import pytest
from kerbside.operators import crowds, lanes
from kerbside.queries import QUERIES
from pyspark.sql import functions as F
from test_scale import LANES, TRACKS, scene


def crowd(spark, seed=0):
    """Lanes of all sizes, some with the same outline, some of two outlines, some with corners that aren't there; points that aren't numbers."""
    table, tracks, rows, _ = scene(spark, 120, 900, seed)
    rng = random.Random(seed)
    made = [tuple(r) for r in table.collect()]
    made += [(200 + i, "again", made[i % 40][2], True) for i in range(100)]
    made += [(i, "also", made[i + 1][2], True) for i in range(0, 60, 3)]
    made += [(400, "gap", [(0.0, 0.0), (None, None), (300.0, 0.0), (300.0, 500.0)], True), (401, "gap", [(0.0, 0.0), (300.0, None), (300.0, 500.0)], True), (402, "none", [(None, None)] * 3, True), (403, "none", None, True)]
    made += [(500, "wide", [(-1e7, -1.0), (1e7, -1.0), (1e7, 400.25), (-1e7, 400.25)], True)]
    rows = [(*r[:3], *rng.choice([(None, 1.0), (1.0, float("nan")), (float("nan"), float("nan")), (float("inf"), 64.0), (1e300, -1e300)]), r[5]) if i % 17 == 0 else r for i, r in enumerate(rows)]
    used: dict = {}
    for i, _, p, seen in made:
        if seen and p is not None and len(p) > 2:
            used.setdefault(i, []).append([tuple(q) for q in p])
    return spark.createDataFrame(made, LANES), spark.createDataFrame(rows, TRACKS), rows, used


def holds(polygons, x, y):
    if x is None or not np.isfinite([x, y]).all():
        return False
    sides = [[(a, b) for a, b in zip(p, p[-1:] + p[:-1], strict=True) if a[1] is not None and b[1] is not None] for p in polygons]
    within = False
    for s in sides:
        crossed = [(a, b) for a, b in s if (a[1] > y) != (b[1] > y)]
        if all(None not in (a[0], b[0]) for a, b in crossed):
            within |= sum(x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in crossed) % 2 == 1
    return within


@pytest.fixture
def few(monkeypatch, spark):
    """Tasks run here, in order, on batches of a few rows."""

    def here(df, f, schema):
        return spark.createDataFrame([tuple(r.values()) for b in f(iter(df.toArrow().to_batches(max_chunksize=7))) for r in b.to_pylist()], schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", here)
    for k, v in {"ROWS": 40, "PAIRS": 50, "OUT": 9, "BLOCK": 30, "BUCKET": 2000, "EACH": 10}.items():
        monkeypatch.setattr(crowds, k, v)


def wanted_entries(rows, used):
    want, before = [], {}
    for r in sorted(rows, key=lambda r: r[2]):
        now = {i for i, p in used.items() if holds(p, r[3], r[4])}
        want += [(i, r[1], r[2]) for i in now - before.get(r[1], set())]
        before[r[1]] = now
    return sorted(want)


@pytest.mark.parametrize("seed", [0, 1])
def test_entries_of_a_few_rows_at_a_time(spark, few, seed):
    table, tracks, rows, used = crowd(spark, seed)
    want = wanted_entries(rows, used)
    got = lanes.entries_inside(tracks, table)
    assert got.columns == [*tracks.columns, "lane_id", "lane_name"]
    assert sorted((r.lane_id, r.track_id, r.frame_id) for r in got.collect()) == want and len(want) > 2000


def test_entries_in_tasks(spark):
    table, tracks, rows, used = crowd(spark, 2)
    got = lanes.entries_inside(tracks, table.drop("name"))
    assert got.columns == [*tracks.columns, "lane_id"]
    assert sorted((r.lane_id, r.track_id, r.frame_id) for r in got.collect()) == wanted_entries(rows, used)
    assert lanes.entries_inside(tracks, table.limit(0)).count() == 0 and lanes.entries_inside(tracks.limit(0), table).count() == 0


def test_lanes_of_one_outline_are_one_shape(spark):
    table = spark.createDataFrame([(i, "l", [(float(i % 3), 0.0), (50.0, 0.0), (50.0, 50.0)], True) for i in range(20)], LANES)
    shapes = crowds.named_shapes(table.select("lane_id", "polygon"), 4)
    assert sorted(len(r.names) for r in shapes.collect()) == [2, 3, 3, 4, 4, 4] and sorted(n.lane_id for r in shapes.collect() for n in r.names) == list(range(20))


def test_pairs_of_a_crowd_arent_moved(spark):
    """Neither a shuffle nor a sort comes after the observations meet the lanes."""
    plan = QUERIES["lane_entries_many"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in top and "Window" not in top and "Join" not in top


def wanted_figures(rows, used, table, now=None, age=None):
    last = {}
    for r in sorted(rows, key=lambda r: r[2]):
        last[r[1]] = r
    last = {k: r for k, r in last.items() if age is None or now - r[2] <= age}
    ever = {i: len({r[1] for r in rows if holds(p, r[3], r[4])}) for i, p in used.items()}
    flow = {i: sum(holds(p, r[3], r[4]) for r in last.values()) for i, p in used.items()}
    return sorted((r.lane_id, r.name, ever.get(r.lane_id, 0), flow.get(r.lane_id, 0)) for r in table.select("lane_id", "name").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_figures_of_a_few_rows_at_a_time(spark, few, seed):
    table, tracks, rows, used = crowd(spark, seed)
    rows += [("s", 77, i, 20.0 + i % 9, 30.0, 0.0) for i in range(300)]  # a track over many chunks
    tracks = spark.createDataFrame(rows, TRACKS).withColumn("stationary", F.col("track_id") % 2 == 0)
    for now, age in ((None, None), (300, 0)):
        got = lanes.lane_figures(tracks, table, now=now, max_age=age).collect()
        assert sorted((r.lane_id, r.name, r.pass_count, r.flow_count) for r in got) == wanted_figures(rows, used, table, now, age)
        assert all(r.queue_count <= r.flow_count <= r.pass_count for r in got) and any(0 < r.queue_count < r.flow_count for r in got) == (age is None)


def test_figures_in_tasks(spark):
    table, tracks, rows, used = crowd(spark, 2)
    got = lanes.lane_figures(tracks, table.unionByName(spark.createDataFrame([(None, "no id", [(0.0, 0.0), (490.0, 0.0), (0.0, 990.0)], True)], LANES))).collect()
    assert sorted((r.lane_id, r.name, r.pass_count, r.flow_count) for r in got if r.lane_id is not None) == wanted_figures(rows, used, table)
    assert [tuple(r) for r in got if r.lane_id is None] == [(None, "no id", 0, 0, 0)]


def test_tracks_of_a_crowd_arent_moved(spark):
    """Only counts leave the tasks in which tracks meet lanes, not a row for each lane and track."""
    plan = QUERIES["lane_figures_many"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "track_id" not in plan[: plan.index("MapInArrow")]
