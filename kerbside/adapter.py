"""The driver's tables as detections and tracks, for queries over data that holds no video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a frame, and the first second.
FRAME_SECONDS, EPOCH = 3600, 1704067200

#: Successive vectors that are the frames of a session.
SESSION_FRAMES = 128


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: several may share a track and frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        (F.col("user_id") % 8).alias("session_id"),
        F.col("user_id").alias("track_id"),
        (F.floor((micros - EPOCH * 1000000) / (FRAME_SECONDS * 1000000)) + 1).cast("long").alias("frame_id"),
        (micros / 1000000).alias("frame_time"),
        F.col("value").alias("px"),
        (F.get_json_object("props", "$.k").cast("double") * 10).alias("py"),
        "event_type",
        (F.lit(0.05) + (F.col("event_id") * 37 % 91) / 100).alias("confidence"),
        "event_id",
    )


OBSERVATIONS_SQL = """obs AS (
    SELECT user_id % 8 AS session_id, user_id AS track_id,
           CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS BIGINT) + 1 AS frame_id,
           epoch_us(ts) / 1000000.0 AS frame_time, value AS px,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 AS py, event_type,
           CAST(0.05 AS DOUBLE) + (event_id * 37 % 91) / CAST(100 AS DOUBLE) AS confidence, event_id
    FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per track and frame: the one with the largest event_id."""
    o = observations(spark, sf_dir)
    rest = [c for c in o.columns if c not in ("track_id", "frame_id")]
    best = o.groupBy("track_id", "frame_id").agg(F.max_by(F.struct(*rest), "event_id").alias("o"))
    return best.select("track_id", "frame_id", "o.*")


TRACKS_SQL = OBSERVATIONS_SQL + """, tracks AS (
    SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY track_id, frame_id ORDER BY event_id DESC) = 1)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as raw tensors of 8 boxes x 8 features: session_id, frame_id, data, shape; a session is a range of vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / SESSION_FRAMES)).alias("session_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("data"), F.array(F.lit(1), F.lit(8), F.lit(8)).alias("shape"))
