"""Corners through the lens and onto the ground, as compiled steps, against one fold after the other."""

import math
import random
import re

from kerbside.functions import geo
from kerbside.queries import CAMERA, QUERIES, H
from pyspark.sql import functions as F


def same(a, b):
    return a is b is None or (a is not None and b is not None and (a == b or math.isnan(a) and math.isnan(b)))


def test_corners_as_rows_are_those_of_the_column(spark):
    rng = random.Random(0)
    odd = [None, float("nan"), float("inf"), -0.0, 1e6]
    boxes = [(i, [(rng.uniform(-50, 900), rng.uniform(-50, 900)) for _ in range(4)]) for i in range(60)]
    boxes += [(100 + i, [(v, 3.0), (3.0, v), (v, v), (1.0, 2.0)]) for i, v in enumerate(odd)] + [(200, []), (201, None)]
    df = spark.createDataFrame(boxes, "i int, c array<struct<x:double,y:double>>").repartition(3)
    for camera in (CAMERA, geo.Camera(CAMERA.matrix, (-0.1,)), None):
        column = {(r.i, k): (p.x, p.y) if p else (None, None) for r in df.select("i", geo.ground_corners("c", H, camera).alias("g")).collect() for k, p in enumerate(r.g or [], 1)}
        rows = {(r.i, r.corner): (r.x, r.y) for r in geo.each_corner_on_ground(df, "c", H, camera).collect()}
        one = df.select("i", F.posexplode("c")).withColumn("u", geo.undistorted("col.x", "col.y", camera) if camera else F.col("col")).select("i", "pos", geo.perspective("u.x", "u.y", H).alias("g")).collect()
        each = {(r.i, r.pos + 1): (r.g.x, r.g.y) if r.g else (None, None) for r in one}
        assert column.keys() == rows.keys() == each.keys() and len(rows) == 260
        assert all(same(p, q) and same(p, s) for k in rows for p, q, s in zip(rows[k], column[k], each[k], strict=True))
    assert geo.each_corner_on_ground(df.where("i < 60"), "c", (1, 0, 0, 0, 1, 0, 0, 0, 0)).where("x is not null or y is not null").count() == 0


def test_all_steps_are_compiled(spark):
    """No fold is left, and no method is too long for the JVM, which interprets those of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["undistorted_corners"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "lambdafunction" not in plan.toString()
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    assert 1000 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
