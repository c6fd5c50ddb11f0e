"""Sinks: result and error messages as JSON, CSV of vehicles, lanes, trajectories and validations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.sources.readers import ERRORS

GEO = ("ground_x", "ground_y", "lon", "lat")


def results(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """One message per frame: request_id, session_id, frame_id, message.

    frames: request_id, session_id, frame_id, timing (a struct of milliseconds). Detections come in the order of
    det_idx; geographic fields without a value are left out, as are empty ones of frames without any.
    """
    geo = [c for c in GEO if c in detections.columns]
    one = F.struct(
        "det_idx",
        F.struct(
            "track_id", "class_id", "class_name", "confidence", "angle",
            F.flatten(F.transform("corners", lambda p: F.array(p["x"], p["y"]))).alias("obb"),
            F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h").alias("bbox"), *geo,
        ).alias("d"),
    )
    lists = detections.groupBy("session_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["d"]).alias("detections"))
    kind = lists.schema["detections"].dataType.simpleString()
    whole = frames.join(lists, ["session_id", "frame_id"], "left").withColumn("detections", F.coalesce("detections", F.from_json(F.lit("[]"), kind)))
    body = F.to_json(F.struct(F.lit("result").alias("type"), "request_id", "session_id", "frame_id", "detections", "timing"), {"ignoreNullFields": "true"})
    return whole.select("request_id", "session_id", "frame_id", body.alias("message"))


def error_text(code) -> Column:
    pairs = [F.lit(x) for kv in ERRORS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), code)


def errors(refused: DataFrame) -> DataFrame:
    """request_id, message of rows with code; without a code, processing itself has failed."""
    text = F.coalesce(error_text(F.col("code")), F.lit("Processing failed"))
    return refused.select("request_id", F.to_json(F.struct(F.lit("error").alias("type"), "request_id", text.alias("error"), "code")).alias("message"))


def fixed(column, places: int) -> Column:
    """With so many decimals, rounded half away from zero as the number reads in decimal; null stays null, which CSV writes as nothing, as does what isn't finite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double").try_cast("decimal(38,12)"), places).cast(f"decimal(38,{places})").cast("string")


def vehicle_rows(tracks: DataFrame) -> DataFrame:
    have = lambda c, n: fixed(c, n) if c in tracks.columns else F.lit(None).cast("string")
    return tracks.select("track_id", "frame_id", fixed("px", 1).alias("pixel_x"), fixed("py", 1).alias("pixel_y"), have("ground_x", 3).alias("ground_x"), have("ground_y", 3).alias("ground_y"), have("lat", 8).alias("lat"), have("lon", 8).alias("lon"))


def lane_rows(summary: DataFrame) -> DataFrame:
    return summary.select("lane_id", "name", "pass_count", "current_in_lane", "queue_count", F.format_string("%.0f", F.col("flow_rate_veh_h").cast("double")).alias("flow_rate_veh_h"))


def trajectory_rows(tracks: DataFrame) -> DataFrame:
    """vehicle_id to corner4_y of tracks with kinematics; system_time is the frame's time as text, to the millisecond."""
    have = lambda c: F.col(c) if c in tracks.columns else F.lit(None).cast("double")
    corners = [F.get("corners", i)[k].alias(f"corner{i + 1}_{k}") if "corners" in tracks.columns else F.lit(None).cast("double").alias(f"corner{i + 1}_{k}") for i in range(4) for k in "xy"]
    return tracks.select(
        F.col("track_id").alias("vehicle_id"), F.col("class_name").alias("vehicle_type"), F.col("frame_time").alias("timestamp"),
        F.date_format(F.timestamp_micros((F.col("frame_time") * 1000000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("system_time"),
        F.col("px").alias("pixel_x"), F.col("py").alias("pixel_y"), have("ground_x").alias("ground_x"), have("ground_y").alias("ground_y"),
        have("lon").alias("longitude"), have("lat").alias("latitude"), "speed_px_s", "speed_ms", F.col("heading_deg").alias("direction_deg"), *corners,
    )


def homography_text(h: Sequence[float]) -> str:
    return "\n".join(" ".join(f"{v:.8e}" for v in h[i : i + 3]) for i in (0, 3, 6))


def homography_text_column(h) -> Column:
    """The same for an array column."""
    rows = [F.format_string("%.8e %.8e %.8e", *(F.element_at(h, i + j) for j in (1, 2, 3))) for i in (0, 3, 6)]
    return F.concat_ws("\n", *rows)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, quoted where it has to be, nothing for null."""
    rows.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_labels(detections: DataFrame, path: str, width: float, height: float) -> None:
    """Label lines of eleven fields, a folder per frame (name=...)."""
    at = [F.get("corners", i)[k] / (width if k == "x" else height) for i in range(4) for k in "xy"]
    line = F.concat_ws(" ", F.col("class_id"), *(F.format_string("%.6f", a) for a in at), F.format_string("%.4f", F.col("confidence").cast("double")), F.coalesce("track_id", F.lit(-1)))
    detections.select(line.alias("value"), F.format_string("%06d", "frame_id").alias("name")).write.partitionBy("name").text(path)
