"""Trajectories in long form, one row per track and frame: steps, stationarity, trails, gaps and ends.

All functions take a DataFrame with track_id, frame_id, px, py (and what they name) and add columns or drop rows. Windows
are per track; the rows of one track are sorted once and the sort is shared by functions applied one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id", "track_id")


def by_track(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("frame_id")


def frame_time(candidates: Sequence[str], fps: float) -> Column:
    """The first of some columns that reads as a number, else frame_id / fps, else the time now."""
    return F.coalesce(*(F.expr(f"try_cast(`{c}` as double)") for c in candidates), F.col("frame_id") / F.lit(float(fps)), F.unix_micros(F.current_timestamp()) / 1e6)


def kinematics(tracks: DataFrame, keys: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """Adds speed_px_s, speed_ms, speed_kmh, heading_deg of the step that ends in each row.

    They are null in a track's first row and where time doesn't pass; speed_ms is null unless both ends have a ground
    position (ground_x, ground_y, if there are such columns). Headings are clockwise from +x, as y points down.
    compat: each row carries the step that begins in it; as it is a negated difference, one that leads nowhere is
    (-0.0, -0.0) and heads for 180.
    """
    w = by_track(keys)
    near = F.lead if compat else F.lag
    sign = -1 if compat else 1
    step = {c: (F.col(c) - near(c).over(w)) * sign for c in ("px", "py", "frame_time")}
    has_ground = "ground_x" in tracks.columns
    if has_ground:
        step |= {c: (F.col(c) - near(c).over(w)) * sign for c in ("ground_x", "ground_y")}
    out = tracks.withColumns({f"_{k}": v for k, v in step.items()})
    moved = F.col("_frame_time") > 0
    # Spark's atan2 takes -0.0 for 0.0, which matters where both are zero
    degrees, nowhere = F.degrees(F.atan2("_py", "_px")), (F.col("_px") == 0) & (F.col("_py") == 0)
    heading = F.when(nowhere & (F.col("_px").cast("string") == "-0.0"), 180.0).when(degrees < 0, degrees + 360).otherwise(degrees)
    pace = F.when(moved, F.hypot("_ground_x", "_ground_y") / F.col("_frame_time")) if has_ground else F.lit(None).cast("double")
    return out.withColumns(
        {
            "speed_px_s": F.when(moved, F.hypot("_px", "_py") / F.col("_frame_time")),
            "speed_ms": pace,
            "speed_kmh": pace * 3.6,
            "heading_deg": F.when(moved, heading),
        }
    ).drop(*(f"_{k}" for k in step))


def stationary(tracks: DataFrame, frames: int = 30, max_path: float = 15.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds path_px, the length of the way over the last so many observations (null with fewer), and stationary: path_px < max_path."""
    w = by_track(keys)
    out = tracks.withColumn("_step", F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)))
    path = F.when(F.row_number().over(w) >= frames, F.sum("_step").over(w.rowsBetween(2 - frames, 0)))
    return out.withColumn("path_px", path).withColumn("stationary", F.coalesce(F.col("path_px") < max_path, F.lit(False))).drop("_step")


def trail(tracks: DataFrame, last: int, upto: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last so many rows of each track, of those up to a frame if one is given."""
    rows = tracks if upto is None else tracks.where(F.col("frame_id") <= upto)
    newest = Window.partitionBy(*keys).orderBy(F.desc("frame_id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def trails(tracks: DataFrame, last: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per track with its last points, an array of struct<frame_id,px,py> in order."""
    return trail(tracks, last, keys=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame_id", "px", "py"))).alias("points"))


def segments(tracks: DataFrame, max_gap: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds segment: it goes up by one wherever more than max_gap frames (or none) have passed."""
    w = by_track(keys)
    gap = F.col("frame_id") - F.lag("frame_id").over(w)
    out = tracks.withColumn("_break", F.when((gap > max_gap) | (gap <= 0), 1).otherwise(0))
    return out.withColumn("segment", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def last_seen(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return tracks.groupBy(*keys).agg(F.max("frame_id").alias("last_frame"))


def visible(tracks: DataFrame, now: int, within: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tracks seen within so many frames of now; within=300 keeps those that haven't expired."""
    return last_seen(tracks.where(F.col("frame_id") <= now), keys).where(F.lit(now) - F.col("last_frame") <= within)


def missing(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, frame_id: tracks that have a row in the frame before but none in that frame, up to the last frame of all."""
    end = tracks.agg(F.max("frame_id").alias("end"))
    after = tracks.select(*keys, (F.col("frame_id") + 1).alias("frame_id"))
    # one row, whatever the size of tracks
    return after.join(tracks.select(*keys, "frame_id"), [*keys, "frame_id"], "left_anti").join(F.broadcast(end), F.col("frame_id") <= F.col("end")).drop("end")


def latest(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest row of each track."""
    rest = [c for c in tracks.columns if c not in keys]
    return tracks.groupBy(*keys).agg(F.max_by(F.struct(*rest), "frame_id").alias("_r")).select(*keys, "_r.*")


def track_counts(tracks: DataFrame, now: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each track, and those up to a frame."""
    return tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("frame_id") <= now).alias("points_so_far"))


def tracked(detections: DataFrame, fallback: str | None = None) -> DataFrame:
    """Without rows that have no track: track_id null or negative, unless a fallback column gives one. Track 0 is one."""
    ids = F.when(F.col("track_id") >= 0, F.col("track_id"))
    return detections.withColumn("track_id", F.coalesce(ids, F.col(fallback)) if fallback else ids).where(F.col("track_id").isNotNull())


def every(frames: DataFrame, k: int) -> DataFrame:
    """Each k-th frame."""
    return frames.where(F.col("frame_id") % k == 0)


def resumed(frames: DataFrame, last: int) -> DataFrame:
    """The frames that a paused run hasn't seen."""
    return frames.where(F.col("frame_id") > last)


def sample_times(videos: DataFrame, fps: float = 10.0, tail: float = 0.05) -> DataFrame:
    """The times, t += 1 / fps, at which videos (duration in seconds) are sampled, up to tail seconds before the end."""
    n = F.greatest(F.lit(0), F.ceil((F.col("duration") - tail) * fps)).cast("int")
    return videos.withColumn("_i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))).withColumn("t", F.col("_i") / fps).drop("_i")


def objects_per_frame(observations: DataFrame, keys: Sequence[str] = ("session_id", "frame_id")) -> DataFrame:
    """keys, objects: how many observations each frame has."""
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("objects"))


def rate(times: DataFrame, column: str, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """keys, fps: rows per second between the first time and the last, of those that are more than least seconds apart."""
    elapsed = F.max(column) - F.min(column)
    return times.groupBy(*keys).agg((F.count(F.lit(1)) / elapsed).alias("fps"), elapsed.alias("_s")).where(F.col("_s") > least).drop("_s")
