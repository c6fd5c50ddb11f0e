"""Stages by name, and the chain of them that a plan describes."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any, NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import Camera, geo_stage, undistort_stage
from kerbside.operators.decode import class_names, decode
from kerbside.operators.inference import decode_images, infer, onnx_predictor
from kerbside.operators.nms import suppress
from kerbside.operators.tracker import Settings, track
from kerbside.shared import kept_table
from kerbside.sources.sinks import errors, results


class Stage(Protocol):
    def __call__(self, df: DataFrame, config: dict[str, Any]) -> DataFrame: ...


STAGES: dict[str, tuple[Stage, bool]] = {}


def register(name: str, stateful: bool = False) -> Callable[[Stage], Stage]:
    """Makes a function (df, config) -> df a stage; stateful ones need the frames of a session in order."""

    def add(f: Stage) -> Stage:
        STAGES[name] = (f, stateful)
        return f

    return add


def stage(name: str) -> Stage:
    if name not in STAGES:
        raise ValueError(f"unknown stage {name!r}; there are {', '.join(sorted(STAGES))}")
    return STAGES[name][0]


class Outcome(NamedTuple):
    results: DataFrame  # request_id, session_id, frame_id, message
    errors: DataFrame  # request_id, message
    detections: DataFrame


def execute(plan: dict[str, Any], frames: DataFrame, nodes: dict[str, dict] | None = None) -> Outcome:
    """The plan over frames (request_id, session_id, frame_id, and content, image or data and shape): every frame gives one
    message, a result or an error.

    A frame fails at the first stage that can't do its part, and the stages after that don't see it. Frames without
    detections have an empty result, and age the tracks of their session. What the model gives is kept as a table, so
    that it runs once. A stage that sets failed for a detection fails its frame. session_id and frame_id name a frame.
    """
    config = copy.deepcopy(plan["config"])
    of = lambda n: {**config.get(n, {}), **(nodes or {}).get(n, {})}
    key = ["session_id", "frame_id"]
    given = _decoder(frames, of("decoder")) if "decoder" in plan["pipeline"] else frames
    known = kept_table(tensors(given, of("yolo")), "tensors")
    good = passed(known)
    found = stage("yolo")(good.drop("request_id"), of("yolo"))
    rest = [n for n in plan["pipeline"] if n not in ("decoder", "yolo")]
    for name in rest:
        if STAGES[name][1]:  # frames in which nothing was found count for what comes in order
            found = good.select(*key).join(found, key, "left")
        found = stage(name)(found, of(name))
    found = found.where("det_idx is not null")
    heads, bad = good.select("request_id", *key), known.where("failed is not null").select("request_id")
    if "failed" in found.columns:
        found = kept_table(found, "detections")
        out = found.where("failed is not null").select(*key).distinct()
        bad, heads = bad.unionByName(heads.join(out, key).select("request_id")), heads.join(out, key, "left_anti")
        found = found.join(out, key, "left_anti").drop("failed")
    if "track_id" not in found.columns:
        found = found.withColumn("track_id", F.lit(-1))
    answers = results(found, heads.withColumn("timing", F.struct(F.lit(None).cast("double").alias("total_ms"))))
    return Outcome(answers, errors(bad.withColumn("code", F.lit(None).cast("string"))), found)


def build(plan: dict[str, Any], nodes: dict[str, dict] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The plan's stages one after the other; nodes: config of single stages, over the plan's. Frames that fail are left out, see execute()."""
    config = copy.deepcopy(plan["config"])
    chain = [(stage(n), {**config.get(n, {}), **(nodes or {}).get(n, {})}) for n in plan["pipeline"]]

    def run(df: DataFrame) -> DataFrame:
        for f, c in chain:
            df = f(df, c)
        return df

    return run


@register("decoder")
def _decoder(df, config):
    """Files' bytes (content) to images; what isn't one fails. Images and tensors pass."""
    if "image" in df.columns or "data" in df.columns:
        return df
    out = decode_images(df)
    return failing(out, "decoder", F.col("image").isNull()).drop("content")


@register("yolo")
def _yolo(df, config):
    """Images or raw tensors (session_id, frame_id, orig_w, orig_h, shape, data) to detections without duplicates.

    Images go through the model first: config has predictor (a function that makes one, see infer()) or model_path. Frames
    that failed before, or whose tensor doesn't have the size that it says, have no detections.
    """
    found = passed(tensors(df, config))
    is_obb = config.get("is_obb", True)
    found = decode(found, config.get("confidence", 0.5), _model(config), class_names(config.get("class_names")), is_obb, config.get("layout"))
    return suppress(found, config.get("nms_threshold", 0.45), is_obb, end_to_end=config.get("layout") == "end_to_end")


def _model(config) -> tuple[int, int]:
    return config.get("input_width", 1024), config.get("input_height", 1024)


def failing(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """df with failed, the name of the first stage at which a row has failed."""
    before = F.col("failed") if "failed" in df.columns else F.lit(None).cast("string")
    return df.withColumn("failed", F.coalesce(before, F.when(bad, name)))


def passed(df: DataFrame) -> DataFrame:
    return df.where("failed is null").drop("failed") if "failed" in df.columns else df


def tensors(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Frames with the model's outputs (data, shape); failed where there is none, or not as much as the shape says."""
    if "data" not in df.columns:
        make = config.get("predictor") or onnx_predictor(config["model_path"])
        bare = df if "failed" in df.columns else df.withColumn("failed", F.lit(None).cast("string"))
        some = infer(bare.where("failed is null"), make, _model(config), config.get("batch_size", 6)).drop("image")
        none = bare.where("failed is not null").drop("image").withColumns({k: F.lit(None).cast(some.schema[k].dataType) for k in ("data", "shape")})
        df = some.unionByName(none)
    wanted = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    return failing(df, "yolo", F.col("data").isNull() | F.col("shape").isNull() | (F.size("data") != wanted))


@register("undistort")
def _undistort(df, config):
    return undistort_stage(df, Camera(tuple(config["camera_matrix"]), tuple(config["dist_coeffs"])))


@register("tracker", stateful=True)
def _tracker(df, config):
    return track(df, Settings(**{k: config[k] for k in Settings.__dataclass_fields__ if k in config}))


@register("geo_transform")
def _geo(df, config):
    camera = Camera(tuple(config["camera_matrix"]), tuple(config["dist_coeffs"])) if "camera_matrix" in config else None
    return geo_stage(df, config["homography"], (config["origin_lon"], config["origin_lat"]), camera, config.get("pixel_scale", 1.0))
