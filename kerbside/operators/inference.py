"""Images to tensors, and tensors to model outputs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL = 114


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    im = image.astype(np.float32)
    top = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx
    low = im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(np.uint8)


def fitted(image: np.ndarray, model_width: int, model_height: int) -> np.ndarray:
    """A BGR image as float32 [3, height, width], RGB from 0 to 1, letterboxed."""
    h, w = image.shape[:2]
    scale = min(np.float32(model_width / w), np.float32(model_height / h))
    nw, nh = int(np.float32(w) * scale), int(np.float32(h) * scale)
    out = np.full((model_height, model_width, 3), FILL, np.uint8)
    left, top = (model_width - nw) // 2, (model_height - nh) // 2
    out[top : top + nh, left : left + nw] = resize(image, nw, nh)
    return np.ascontiguousarray(out[:, :, ::-1].transpose(2, 0, 1), np.float32) / 255


def read_images(spark, path: str) -> DataFrame:
    """image structs of all images that can be read; data is BGR. Others are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image", F.col("image.width").alias("orig_w"), F.col("image.height").alias("orig_h"))


def _png(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG of 8 bits a channel that isn't interlaced, as BGR, or None."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    parts, at = {}, 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    w, h, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if bits != 8 or interlaced:
        return None
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind:  # what is left of a pixel is needed first
            for x in range(0, w * channels, channels):
                a = line[x - channels : x] if x else np.zeros(channels, np.int64)
                b, c = above[x : x + channels], above[x - channels : x] if x else np.zeros(channels, np.int64)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    near = np.abs(np.stack([b - c, a - c, a + b - 2 * c]))
                    guess = np.choose(near.argmin(0), [a, b, c])
                line[x : x + channels] = (line[x : x + channels] + guess) % 256
        above = line % 256
        out[y] = above
    pixels = out.reshape(h, w, channels)
    if color == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0], ::-1]
    return np.repeat(pixels[:, :, :1], 3, 2) if channels < 3 else pixels[:, :, 2::-1]


def decoded(data: bytes | None) -> np.ndarray | None:
    """An image file's pixels [height, width, 3], BGR, or None where there is no image: by OpenCV or Pillow if executors have
    one of them, else PNG only. Image files in a folder are decoded by Spark itself, see read_images()."""
    if not data:
        return None
    try:
        import cv2

        return cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
    except ImportError:
        pass
    try:
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))[:, :, ::-1]
    except ImportError:
        pass
    except Exception:
        return None
    try:
        return _png(data)
    except Exception:  # whatever a broken file brings about
        return None


IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
_BGR_MODE = 16


def decode_images(frames: DataFrame, column: str = "content") -> DataFrame:
    """Adds image (as Spark's image source gives it), orig_w and orig_h to frames with files' bytes; null where these hold no image."""

    @F.pandas_udf(IMAGE)
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            pixels = decoded(None if data is None else bytes(data))
            rows.append((None,) * 6 if pixels is None else ("", *pixels.shape[:2], 3, _BGR_MODE, np.ascontiguousarray(pixels).tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")})

    out = frames.withColumn("_i", run(column))
    out = out.withColumn("image", F.when(F.col("_i.data").isNotNull(), F.col("_i"))).drop("_i")
    return out.withColumns({"orig_w": F.col("image.width"), "orig_h": F.col("image.height")})


def preprocess(model_width: int, model_height: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def run(images: pd.DataFrame) -> pd.Series:
        made = []
        for h, w, n, data in zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True):
            pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
            made.append(fitted(np.repeat(pixels, 3, 2) if n == 1 else pixels[:, :, :3], model_width, model_height).ravel())
        return pd.Series(made)

    return run


def infer(images: DataFrame, make_predictor: Callable, model: tuple[int, int] = (1024, 1024), batch: int = 6) -> DataFrame:
    """Adds data and shape to images. make_predictor() gives a function from float32 [n, 3, height, width] to [n, a, b].

    It is made once per worker. Where a batch fails, its images are tried one by one, and those that fail have null data.
    """
    w, h = model

    def load():
        predict = make_predictor()

        def one(tensors):
            try:
                return np.asarray(predict(tensors), np.float32)
            except Exception:
                if len(tensors) == 1:
                    return None
                parts = [one(t[None]) for t in tensors]
                shape = next((p.shape[1:] for p in parts if p is not None), (0, 0))
                return np.concatenate([np.full((1, *shape), np.nan, np.float32) if p is None else p for p in parts])

        def run(tensors: np.ndarray):
            out = one(tensors)
            if out is None:
                out = np.full((len(tensors), 0, 0), np.nan, np.float32)
            failed = np.isnan(out).reshape(len(out), -1).all(1) if out[0].size else np.ones(len(out), bool)
            return [{"data": o.ravel()[: 0 if bad else o.size], "shape": np.array([1, *o.shape])} for o, bad in zip(out, failed, strict=True)]

        return run

    from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

    kind = StructType([StructField("data", ArrayType(FloatType())), StructField("shape", ArrayType(LongType()))])
    udf = predict_batch_udf(load, return_type=kind, batch_size=batch, input_tensor_shapes=[[3, h, w]])
    out = images.withColumn("_o", udf(preprocess(w, h)("image")))
    return out.withColumns({"data": F.when(F.size("_o.data") > 0, F.col("_o.data")), "shape": F.col("_o.shape")}).drop("_o")


def onnx_predictor(path: str, cuda: bool = True, threads: int = 4) -> Callable:
    """make_predictor for infer(): an ONNX model at a path that every executor has, on a GPU if there is one."""

    def make():
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = threads
        wanted = ["CUDAExecutionProvider"] * cuda + ["CPUExecutionProvider"]
        session = ort.InferenceSession(path, options, providers=[p for p in wanted if p in ort.get_available_providers()])
        name = session.get_inputs()[0].name
        return lambda tensors: session.run(None, {name: tensors.astype(np.float32)})[0]

    return make
