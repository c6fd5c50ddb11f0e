"""Images through a plan to tracks; bad frames among good ones, each told once."""

import json
import struct
import zlib

import numpy as np
import pytest
from kerbside.operators import inference
from kerbside.plans import config, registry
from pyspark.sql import functions as F


def png(pixels, color=2, filters=(0,), palette=b""):
    """A PNG file whose lines are filtered in turn as said."""
    h, w, n = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    flat, lines = pixels.astype(np.int64).reshape(h, w * n), []
    for y in range(h):
        kind, a, b, c = filters[y % len(filters)], np.zeros(w * n, np.int64), np.zeros(w * n, np.int64), np.zeros(w * n, np.int64)
        a[n:] = flat[y, :-n] if w > 1 else 0
        if y:
            b, c[n:] = flat[y - 1], flat[y - 1, :-n]
        p = a + b - c
        near = [np.abs(p - x) for x in (a, b, c)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), a, np.where(near[1] <= near[2], b, c))
        lines.append(bytes([kind]) + ((flat[y] - [0, a, b, (a + b) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"")
    return data + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color", [0, 2, 3, 4, 6])
def test_pixels_of_files(color):
    rng = np.random.default_rng(color)
    pixels = rng.integers(0, 256, (11, 7, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]))
    palette = rng.integers(0, 256, 768).astype(np.uint8).tobytes() if color == 3 else b""
    got = inference.decoded(png(pixels, color, (0, 1, 2, 3, 4), palette))
    want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]] if palette else pixels[:, :, :3] if color in (2, 6) else np.repeat(pixels[:, :, :1], 3, 2)
    assert (got == want[:, :, ::-1]).all()
    assert inference.decoded(png(pixels, color)[:40]) is None and inference.decoded(b"nothing") is None and inference.decoded(None) is None


def nodes():
    def model():
        """A box wherever the image is bright, whose place is told by the blue; refuses images that are nearly white, and any batch with one."""

        def predict(tensors):
            if tensors.mean((1, 2, 3)).max() > 0.95:
                raise RuntimeError("no")
            out = np.zeros((len(tensors), 9, 8), np.float32)
            out[:, 0, :4] = np.stack([tensors[:, 2].mean((1, 2)) * 60, np.full(len(tensors), 30), np.full(len(tensors), 24), np.full(len(tensors), 12)], 1)
            out[:, 0, 4] = tensors[:, 0].mean((1, 2))
            return out

        return predict

    return {"yolo": {"predictor": model, "input_width": 64, "input_height": 64, "batch_size": 4, "confidence": 0.5}}


def frames_of(spark):
    rows, fate = [], {}
    for session in ("a", "b"):
        for f in range(1, 13):
            bright, blue, kind = 200, 20 + f, "result"
            data = png(np.full((32, 32, 3), 0) + np.array([bright, 0, blue]))
            if (session, f) == ("a", 4):
                data, kind = b"broken", "error"
            elif (session, f) == ("a", 5):
                data, kind = None, "error"
            elif (session, f) == ("b", 6):
                data, kind = png(np.full((32, 32, 3), 255)), "error"
            elif (session, f) == ("b", 7):
                data, kind = png(np.full((32, 32, 3), 3)), "empty"
            rows.append((f"{session}{f}", session, f, data))
            fate[f"{session}{f}"] = kind
    return spark.createDataFrame(rows, "request_id string, session_id string, frame_id int, content binary").repartition(3), fate


def test_images_to_tracks(spark):
    frames, fate = frames_of(spark)
    got = registry.build(config.plan({}), nodes())(frames).collect()
    assert {f"{r.session_id}{r.frame_id}" for r in got} == {k for k, v in fate.items() if v == "result"}
    assert {r.track_id for r in got} == {-1, 1} and all(r.track_id == 1 for r in got if r.frame_id > 3)


def test_every_frame_is_told_once(spark):
    frames, fate = frames_of(spark)
    out = registry.execute(config.plan({}), frames, nodes())
    results = {r.request_id: json.loads(r.message) for r in out.results.collect()}
    errors = {r.request_id: json.loads(r.message) for r in out.errors.collect()}
    assert set(errors) == {k for k, v in fate.items() if v == "error"} and set(results) == set(fate) - set(errors)
    assert out.results.count() + out.errors.count() == len(fate)
    assert all(m["error"] == "Processing failed" and "code" not in m for m in errors.values())
    assert results["b7"]["detections"] == [] and results["a12"]["detections"][0]["track_id"] == 1


def test_a_stage_may_fail_a_detection(spark):
    @registry.register("picky")
    def picky(df, cfg):
        return registry.failing(df, "picky", F.col("frame_id") == 2)

    try:
        frames, fate = frames_of(spark)
        out = registry.execute({"pipeline": ["decoder", "yolo", "picky"], "config": {}}, frames, nodes())
        assert {r.request_id for r in out.errors.collect()} == {k for k, v in fate.items() if v == "error"} | {"a2", "b2"}
        assert out.results.count() == len(fate) - out.errors.count()
    finally:
        del registry.STAGES["picky"]
