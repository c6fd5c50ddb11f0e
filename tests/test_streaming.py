"""Streams against batches. Every wait has an end."""

import json
import os
import time

import pytest
from kerbside.operators.tracker import track
from kerbside.streaming import stateful
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def boxes(frame_id, n=2):
    return json.dumps([{"det_idx": i, "cx": 10.0 + 2 * frame_id, "cy": 100.0 * i, "w": 40.0, "h": 20.0, "angle": 0.0, "confidence": 0.9, "class_id": 0} for i in range(n)])


def row(session, frame_id, kind="frame", config=None):
    return {"session_id": session, "frame_id": frame_id, "kind": kind, "config": config, "detections": boxes(frame_id) if kind == "frame" else None}


def streamed(spark, tmp_path, parts, settle=0.0, **options):
    """What the stream tells of parts, each a micro-batch of its own."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    for i, rows in enumerate(parts):
        (source / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    frames = spark.readStream.schema(stateful.FRAME_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    q = stateful.track_stream(frames, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="200 milliseconds").start(out)
    try:
        end = time.time() + 90
        want = sum(1 for rows in parts for r in rows if r["kind"] == "frame" and r["frame_id"] > 0)
        got = []
        while time.time() < end and q.isActive:
            time.sleep(1)
            if os.path.isdir(f"{out}/_spark_metadata"):
                got = spark.read.schema(stateful.OUT_SCHEMA).parquet(out).collect()
                if len({(r.session_id, r.frame_id, r.epoch, r.late) for r in got}) >= want:
                    break
        assert q.exception() is None
        return got
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ids(rows, session, epoch=0):
    out = {}
    for r in sorted((r for r in rows if r.session_id == session and r.epoch == epoch and not r.late), key=lambda r: (r.frame_id, r.det_idx)):
        out.setdefault(r.frame_id, []).append(r.track_id)
    return out


def test_stream_is_batch_gap_late_and_reset(spark, tmp_path):
    parts = [
        [row("a", 1), row("a", 2), row("gap", 1), row("gap", 2), row("late", 2), row("late", 1), row("reset", 1), row("reset", 2)],
        [row("a", 4), row("a", 3), row("gap", 3), row("late", 3), row("late", 4), row("reset", 3)],
        [row("a", 5), row("gap", 10), row("late", 2), row("reset", 0, "reset")],
        [row("a", 6), row("reset", 1), row("config", 1, config="x")],
        [row("a", 7), row("config", 2, config="y"), row("config", 1, config="y")],
    ]
    got = streamed(spark, tmp_path, parts)
    flat = [(s, f, *json.loads(boxes(f))[i].values()) for s, f in (("a", f) for f in range(1, 8)) for i in range(2)]
    df = spark.createDataFrame(flat, "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double, class_id int")
    batch = {}
    for r in sorted(track(df).collect(), key=lambda r: (r.frame_id, r.det_idx)):
        batch.setdefault(r.frame_id, []).append(r.track_id)
    assert ids(got, "a") == batch and batch[7] == [1, 2]
    assert ids(got, "gap")[10] == [1, 2]  # after the gap's time, and one step
    assert [(r.frame_id, r.track_id) for r in got if r.session_id == "late" and r.late] == [(2, -1)] * 2
    assert ids(got, "reset")[3] == [1, 2] and ids(got, "reset", 1)[1] == [-1, -1]
    assert {r.epoch for r in got if r.session_id == "config"} == {0, 1}


def test_headers_wait_for_payloads(spark):
    h = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "request_id string, t int").withColumn("header_time", F.timestamp_seconds("t")).drop("t")
    p = spark.createDataFrame([("a", 60, "x"), ("b", 61, "y")], "request_id string, t int, content string").withColumn("payload_time", F.timestamp_seconds("t")).drop("t")
    assert sorted((r.request_id, r.content, r.code) for r in stateful.paired(h, p).collect()) == [("a", "x", None), ("b", None, "header_timeout"), ("c", None, "header_timeout")]


def test_results_of_ended_sessions_are_dropped(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "session_id string, epoch int")
    retired = spark.createDataFrame([("a", 0)], "session_id string, epoch int")
    assert sorted(tuple(r) for r in stateful.current_epoch(rows, retired).collect()) == [("a", 1), ("b", 0)]
    rows = rows.unionByName(rows).withColumn("frame_id", F.lit(7))
    assert [tuple(r) for r in stateful.stale(rows, retired).collect()] == [("a", 7, 0, "stale_session")]


@pytest.mark.parametrize("f", ["rate", "sessions"])
def test_windows_in_streams(spark, tmp_path, f):
    schema = "lane_id int, session_id string, pass_time timestamp"
    spark.createDataFrame([(1, "s", 0), (1, "s", 60), (1, "s", 1000)], "lane_id int, session_id string, t int").select("lane_id", "session_id", F.timestamp_seconds("t").alias("pass_time")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    df = stateful.sliding_rate(s) if f == "rate" else stateful.sessions(s, "pass_time")
    q = df.writeStream.format("memory").queryName(f"w_{f}").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    rows = spark.table(f"w_{f}").collect()
    if f == "rate":
        assert {r.passes for r in rows} == {1, 2} and max(r.per_hour for r in rows) == 24.0
    else:
        assert sorted(r["rows"] for r in rows) == [1, 2]
