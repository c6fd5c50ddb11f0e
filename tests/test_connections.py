"""Connections as tables and as streams, against the protocol's steps one message after the other."""

import datetime
import json
import os
import random

import pytest
from kerbside.sources import sinks
from kerbside.streaming import connections as C
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGES = "connection_id string, seq long, time timestamp, message string, content binary"
T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def header(request, frame=1, **more):
    return json.dumps({"type": "infer_header", "request_id": request, "frame_id": frame} | more)


def batch(sizes, **more):
    return json.dumps({"type": "infer_batch", "frames": [{"request_id": f"b{i}", "frame_id": i + 1} for i in range(len(sizes))], "sizes": sizes} | more)


RESET = json.dumps({"type": "reset", "session_id": "t"})

#: connection: (seconds, message or payload, code, header_seq, ends of waits told before it)
SCENES = {
    "plain": [(0, header("a", session_id="s"), None, None), (1, b"xy", None, 0), (2, b"z", "unexpected_binary", None)],
    "taken": [(0, header("a"), None, None), (1, header("b"), "previous_header_unpaired", None), (2, b"x", None, 0), (3, header("c"), None, None), (4, b"y", None, 3)],
    "batch": [(0, batch([2, 1]), None, None), (1, b"abc", None, 0), (2, batch([2, 2]), None, None), (3, b"abc", "payload_size_mismatch", 2), (4, b"abcd", "unexpected_binary", None)],
    "both": [(0, batch([1]), None, None), (1, header("a"), None, None), (2, batch([1]), "previous_header_unpaired", None), (3, b"x", None, 0), (4, b"yy", None, 1)],
    "reset": [(0, header("a"), None, None), (1, RESET, None, None), (2, b"x", "unexpected_binary", None), (3, header("b"), None, None), (4, b"x", None, 3)],
    "wait": [(0, header("a"), None, None), (60, b"x", None, 0), (61, header("b"), None, None), (122, b"x", "unexpected_binary", None), (123, header("c"), None, None), (200, header("d"), None, None), (201, b"x", None, 5)],
    "long": [(0, header("a"), None, None), (1, b"x" * 11, "payload_too_large", 0), (2, b"x", "unexpected_binary", None)],
    "refused": [(0, "{", "invalid_json", None), (1, '{"type":"infer"}', "legacy_infer_removed", None), (2, header("", 1), "invalid_request", None), (3, '{"type":"ping","request_id":"p"}', None, None), (4, b"x", "unexpected_binary", None)],
    "end": [(0, header("a"), None, None), (5, batch([1]), "previous_header_unpaired", None)],
    "still": [(290, header("a"), None, None)],
}
TIMEOUTS = {("wait", 2, "b"), ("wait", 4, "c"), ("end", 0, "a")}
ROWS = [(name, i, at(s), None if isinstance(m, bytes) else m, m if isinstance(m, bytes) else None) for name, scene in SCENES.items() for i, (s, m, *_) in enumerate(scene)]
ROWS.append(("clock", 0, at(300), '{"type":"ping"}', None))


def told(rows):
    return sorted((r.connection_id, r.seq, r.kind, r.request_id or "", r.header_seq if r.header_seq is not None else -1, r.code or "", bytes(r.content or b""), r.session_id or "", str(r.time)) for r in rows)


def test_scenes_as_a_table(spark):
    rows = ROWS + [(None, 1, at(0), header("n"), None), ("plain", None, at(0), None, b"x"), ("plain", 1, at(9), None, b"again")]
    got = C.pair_connections(spark.createDataFrame(rows, MESSAGES).repartition(5), limit=10).collect()
    by = {(r.connection_id, r.seq): r for r in got if r.kind != "timeout" and r.connection_id and r.seq is not None}
    for name, scene in SCENES.items():
        for i, (_, m, code, header_seq) in enumerate(scene):
            r = by[name, i]
            assert (r.code, r.header_seq) == (code, header_seq), (name, i)
            assert bytes(r.content or b"") == (m if isinstance(m, bytes) and code is None else b"")
    assert {(r.connection_id, r.seq, r.request_id) for r in got if r.kind == "timeout"} == TIMEOUTS
    assert {(r.connection_id, r.seq, r.header_seq, r.code) for r in got if r.connection_id is None or r.seq is None} == {(None, 1, None, None), ("plain", None, None, None)}
    assert by["plain", 0].session_id == "s" and by["reset", 4].session_id == "t" and len(by) == len(ROWS)
    assert [r.time for r in got if r.kind == "timeout" and r.connection_id == "end"] == [at(60)]


def test_frames_and_errors(spark):
    paired = C.pair_connections(spark.createDataFrame(ROWS, MESSAGES), limit=10)
    got = {(r.connection_id, r.header_seq, r.idx): (r.session_id, r.request_id, r.frame_id, bytes(r.content)) for r in C.requests(paired).collect()}
    assert got["plain", 0, 0] == ("s", "a", 1, b"xy") and got["batch", 0, 0][1:] == ("b0", 1, b"ab") and got["batch", 0, 1][1:] == ("b1", 2, b"c")
    assert len(got) == 2 + sum(1 for scene in SCENES.values() for _, m, code, _ in scene if isinstance(m, bytes) and code is None) - 1
    messages = [json.loads(r.message) for r in sinks.errors(C.refusals(paired)).collect()]
    assert len(messages) == sum(1 for scene in SCENES.values() for *_, code, _ in scene if code) + len(TIMEOUTS)
    assert {m["request_id"] for m in messages if m["code"] == "header_timeout"} == {"a", "b", "c"}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_is_table(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = sorted(ROWS, key=lambda r: (r[2], r[1]))
    source, cut = tmp_path / "in", [len(rows) * k // parts for k in range(parts + 1)]
    os.makedirs(source)
    pieces = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    pieces.append([("clock", 1, at(320), '{"type":"ping"}', None)])  # moves the watermark to 310
    for k, piece in enumerate(pieces):
        rng.shuffle(piece)
        spark.createDataFrame(piece, MESSAGES).coalesce(1).write.parquet(str(source / f"p{k}"))
        for f in os.listdir(source / f"p{k}"):
            if f.endswith(".parquet"):
                os.rename(source / f"p{k}" / f, source / f"{k:03}.parquet")
                os.utime(source / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(source) + "/*.parquet")
        q = C.connection_stream(stream, limit=10).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120) and q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = told(spark.read.schema(C.OUT_SCHEMA).parquet(str(tmp_path / "out")).collect())
    everything = spark.createDataFrame([r for p in pieces for r in p], MESSAGES)
    assert got == told(C.pair_connections(everything, limit=10, until=F.lit(at(310)).cast("timestamp")).collect())
    assert {(c, s) for c, s, kind, *_ in got if kind == "timeout"} == {(c, s) for c, s, _ in TIMEOUTS}


def test_state_survives_a_dump():
    c = C.Connection()
    c.take(0, 5, "infer_batch", None, None, "s", "{}", 7)
    d = C.Connection.load(c.dump(), c.wait_ms, c.limit)
    assert d == c and d.take(1, 6, "payload", None, None, None, None, 7) == (None, 0, "{}", None)
