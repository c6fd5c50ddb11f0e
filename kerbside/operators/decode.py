"""From raw detector tensors to boxes in image pixels, as columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import _c, bounding_box, obb_corners

#: Names of classes where none are configured.
CLASS_NAMES = ("car", "truck", "bus", "motorcycle", "bicycle", "person", "traffic_light", "stop_sign")
MOST_BOXES = 100_000

END_TO_END, OBB, HBB = "end_to_end", "obb", "hbb"


def letterbox(width, height, model_width: int, model_height: int) -> Column:
    """struct<scale: float, pad_x: int, pad_y: int> of an image that is fitted into the model's input."""
    w, h = _c(width), _c(height)
    scale = F.least((F.lit(model_width) / w).cast("float"), (F.lit(model_height) / h).cast("float"))
    pad = lambda side, model: F.floor((F.lit(model) - (side.cast("float") * scale).cast("int")) / 2).cast("int")
    return F.struct(scale.alias("scale"), pad(w, model_width).alias("pad_x"), pad(h, model_height).alias("pad_y"))


def layout_of(features: int, is_obb: bool) -> str:
    """Seven features are an end-to-end tensor; callers name the layout where that is wrong."""
    return END_TO_END if features == 7 else OBB if is_obb else HBB


def boxes(tensors: DataFrame, is_obb: bool = True, layout: str | None = None) -> DataFrame:
    """A row per box: det_idx and features, an array of doubles.

    shape has 3 sizes (the first is the batch) or 2. Rows are boxes unless there are fewer of them than columns, then
    they are features. Tensors of other shapes, without a class, or of over 100,000 boxes have no boxes.
    """
    n = F.size("shape")
    rows, columns = (F.when(n == 3, F.element_at("shape", i + 1)).when(n == 2, F.element_at("shape", i)).cast("int") for i in (1, 2))
    sized = tensors.withColumns({"_m": F.greatest(rows, columns), "_f": F.least(rows, columns), "_t": rows < columns})
    least = {None: 6 if is_obb else 5, END_TO_END: 7, OBB: 6, HBB: 5}[layout]
    sized = sized.where(F.col("_m").isNotNull() & (F.col("_m") > 0) & (F.col("_m") <= MOST_BOXES) & (F.col("_f") >= least))
    each = sized.withColumn("det_idx", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    where = lambda f: F.when(F.col("_t"), f * F.col("_m") + F.col("det_idx")).otherwise(F.col("det_idx") * F.col("_f") + f) + 1
    picked = F.transform(F.sequence(F.lit(0), F.col("_f") - 1), lambda f: F.element_at("data", where(f)).cast("double"))
    return each.withColumn("features", picked).drop("data", "shape", "_m", "_f", "_t")


def scored(rows: DataFrame, is_obb: bool = True, layout: str | None = None) -> DataFrame:
    """Adds cx, cy, w, h, class_id, confidence, angle (degrees) to boxes.

    The class is the first with the largest score; if no score is over 0, class 0 with confidence 0.
    """
    f, n = F.col("features"), F.size("features")
    e2e = F.lit(layout == END_TO_END) if layout else n == 7
    turned = layout == OBB if layout else is_obb
    scores = F.slice(f, F.lit(5), n - (5 if turned else 4))
    top = F.array_max(F.transform(scores, lambda v: F.when(F.isnan(v), 0.0).otherwise(v)))  # a NaN is no score, though it sorts above any
    best = F.when(top > 0, F.array_position(scores, top).cast("int") - 1).otherwise(0)
    angle = F.degrees(F.element_at(f, -1))
    return rows.withColumns(
        {
            **{c: F.element_at(f, i) for i, c in enumerate(("cx", "cy", "w", "h"), 1)},
            "class_id": F.when(e2e, F.element_at(f, 6).cast("int")).otherwise(best),
            "confidence": F.when(e2e, F.element_at(f, 5)).otherwise(F.greatest(top, F.lit(0.0))),
            "angle": F.when(e2e, angle).otherwise(angle if turned else F.lit(0.0)),
        }
    ).drop("features")


def kept(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes of enough confidence without a NaN; NaN is tested by itself, as it sorts above any number."""
    return rows.where((F.col("confidence") >= threshold) & ~F.isnan("confidence")).where(~(F.isnan("cx") | F.isnan("cy") | F.isnan("w") | F.isnan("h")))


def to_image(rows: DataFrame, scale="letterbox.scale", pad_x="letterbox.pad_x", pad_y="letterbox.pad_y", width="orig_w", height="orig_h") -> DataFrame:
    """From model to image pixels: centres are clamped to the image, sizes aren't."""
    s, px, py, w, h = map(_c, (scale, pad_x, pad_y, width, height))
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))
    return rows.withColumns({"cx": clamp((F.col("cx") - px) / s, w), "cy": clamp((F.col("cy") - py) / s, h), "w": F.col("w") / s, "h": F.col("h") / s})


def class_names(configured=None) -> list[str]:
    """From a list, a JSON string or a string with commas; without any, the default names."""
    if isinstance(configured, str):
        try:
            read = json.loads(configured)
        except ValueError:
            read = None
        if not isinstance(read, list):
            read = [x.strip() for x in configured.split(",")]
            read = [x[1:-1].strip() if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'" else x for x in read]
        configured = [x for x in read if x]
    return list(configured or CLASS_NAMES)


def named(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    inside = (F.col("class_id") >= 0) & (F.col("class_id") < len(names))
    return rows.withColumn("class_name", F.when(inside, F.get(known, F.col("class_id"))).otherwise(F.concat(F.lit("class_"), F.col("class_id"))))


def with_geometry(rows: DataFrame) -> DataFrame:
    """Adds corners and bbox."""
    return rows.withColumn("corners", obb_corners("cx", "cy", "w", "h", "angle")).withColumn("bbox", bounding_box("corners"))


def decode(tensors: DataFrame, threshold: float = 0.5, model: tuple[int, int] = (1024, 1024), names: Sequence[str] = CLASS_NAMES, is_obb: bool = True, layout: str | None = None) -> DataFrame:
    """Tensors (shape, data, orig_w, orig_h) to detections with names and geometry, before duplicates are suppressed."""
    fitted = tensors.withColumn("letterbox", letterbox("orig_w", "orig_h", *model))
    rows = kept(scored(boxes(fitted, is_obb, layout), is_obb, layout), threshold)
    return with_geometry(named(to_image(rows), names)).drop("letterbox")
