import struct
import zlib

import numpy as np
from kerbside.operators import decode, inference
from pyspark.sql import functions as F


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_letterbox_of_pixels():
    image = np.zeros((30, 60, 3), np.uint8)
    image[..., 2] = 255  # red, as BGR
    t = inference.fitted(image, 64, 64)
    assert t.shape == (3, 64, 64) and t.dtype == np.float32
    assert np.allclose(t[:, 32, 32], [1, 0, 0]) and np.allclose(t[:, 0, 0], 114 / 255) and np.allclose(t[:, 63, 0], 114 / 255)
    same = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (inference.resize(same, 4, 4) == same).all()


def test_images_to_detections(spark, tmp_path):
    def mean_model():
        """One box per image, whose confidence is the image's mean; refuses batches, and any bright image."""

        def predict(tensors):
            if len(tensors) > 1 or tensors[0].mean() > 0.9:
                raise RuntimeError("no")
            out = np.zeros((len(tensors), 9, 8), np.float32)
            out[:, :, :4] = [16, 16, 8, 8]
            out[:, 0, 4] = tensors.mean((1, 2, 3))
            return out

        return predict

    for name, level in (("a", 200), ("b", 100), ("c", 255)):
        png(tmp_path / f"{name}.png", np.full((32, 32, 3), level))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    images = inference.read_images(spark, str(tmp_path)).coalesce(1)
    assert images.count() == 3
    out = inference.infer(images, mean_model, (32, 32), batch=2).withColumn("name", F.regexp_extract("image.origin", r"(\w+)\.png", 1)).drop("image")
    rows = {r.name: r for r in out.collect()}
    assert rows["c"].data is None and list(rows["a"].shape) == [1, 9, 8]
    found = decode.kept(decode.scored(decode.boxes(out.where("data is not null"))), 0.3).collect()
    assert sorted(round(r.confidence, 3) for r in found) == [round(100 / 255, 3), round(200 / 255, 3)]
