"""Sources: requests with payloads, label and image folders, control points, camera and homography files."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import Camera
from kerbside.functions.geometry import point, rect_corners
from kerbside.shared import numbered

MAX_PAYLOAD = 100 * 1024 * 1024
HEADER_SCHEMA = "type string, request_id string, session_id string, frame_id int, features struct<tracker:boolean,undistort:boolean,geo_transform:boolean>, config string, frames array<struct<request_id:string,frame_id:int>>, sizes array<bigint>"

#: Error codes and their texts.
ERRORS = {
    "invalid_json": "invalid JSON",
    "unknown_type": "unknown message type",
    "legacy_infer_removed": "infer is no longer supported",
    "invalid_request": "invalid request",
    "payload_too_large": "payload too large",
    "payload_size_mismatch": "sizes don't add up to the payload",
    "unexpected_binary": "binary without a header",
    "previous_header_unpaired": "the header before has no payload",
    "header_timeout": "no payload came in time",
    "session_busy": "too many requests of the session are open",
    "stale_session": "the session has ended",
    "queue_full": "the queue is full",
    "internal_error": "internal error",
}


def parse_headers(messages: DataFrame, column: str = "message") -> DataFrame:
    """messages with the fields of their JSON headers and code: null, or why a header is refused. config stays JSON text."""
    whole = F.from_json(F.col(column), HEADER_SCHEMA)
    is_json = F.expr(f"try_parse_json(`{column}`) is not null")
    h = F.col("_h")
    single = (F.coalesce(F.length(h["request_id"]), F.lit(0)) > 0) & (h["frame_id"] > 0)
    n = F.size(h["frames"])
    batch = (n > 0) & (n == F.size(h["sizes"])) & ~F.exists(h["frames"], lambda f: F.coalesce(f["frame_id"] <= 0, F.lit(True)) | (F.coalesce(F.length(f["request_id"]), F.lit(0)) == 0)) & ~F.exists(h["sizes"], lambda s: F.coalesce(s < 0, F.lit(True)))
    kind = h["type"]
    code = (
        F.when(~is_json | is_json.isNull(), "invalid_json")
        .when(kind == "infer", "legacy_infer_removed")
        .when(kind == "infer_header", F.when(F.coalesce(single, F.lit(False)), F.lit(None)).otherwise("invalid_request"))
        .when(kind == "infer_batch", F.when(F.coalesce(batch, F.lit(False)), F.lit(None)).otherwise("invalid_request"))
        .when(kind.isin("ping", "reset"), F.lit(None))
        .otherwise("unknown_type")
    )
    return messages.withColumn("_h", whole).withColumn("code", code).select(*[c for c in messages.columns], "_h.*", "code")


def payload_code(content, sizes=None, limit: int = MAX_PAYLOAD) -> Column:
    """Why a payload is refused, or null: too large, or (with sizes) of another length than their sum."""
    n = F.octet_length(content)
    out = F.when(n > limit, "payload_too_large")
    if sizes is not None:
        out = out.when(F.aggregate(F.col(sizes), F.lit(0).cast("bigint"), lambda a, s: a + s) != n, "payload_size_mismatch")
    return out


#: Messages of a connection that are numbered together.
STRETCH = 100_000


def pair_messages(messages: DataFrame, limit: int = MAX_PAYLOAD) -> DataFrame:
    """Adds to the messages of connections header_seq and code: which header a payload belongs to, and what is refused.

    messages: connection_id, seq (place in the connection), kind (header, payload; others pass), code (why a header is
    refused already, see parse_headers(), or null), content (a payload's). A header waits for the next payload; one
    that comes while another waits is refused (previous_header_unpaired), and so is a payload for which none waits
    (unexpected_binary) or that is too large; the header of that is used up. Refused headers don't wait. Rows with a
    null connection_id or seq, or of another kind, keep their code and have no header_seq.

    Runs between payloads are numbered by stretches of seq, so that a long connection isn't one task's.
    """
    payload, header = F.col("kind") == "payload", (F.col("kind") == "header") & F.col("code").isNull()
    known = F.col("connection_id").isNotNull() & F.col("seq").isNotNull()
    placed = messages.withColumn("_stretch", F.floor(F.col("seq") / STRETCH))
    totals = placed.where(known & payload).groupBy("connection_id", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    stretches = placed.where(known).select("connection_id", "_stretch").distinct().join(totals, ["connection_id", "_stretch"], "left")
    through = Window.partitionBy("connection_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select("connection_id", "_stretch", F.coalesce(F.sum("_n").over(through), F.lit(0)).alias("_before"))
    within = Window.partitionBy("connection_id", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.join(before, ["connection_id", "_stretch"], "left").withColumn("_run", F.col("_before") + F.coalesce(F.count_if(payload).over(within), F.lit(0)))
    waits = numbered.where(known & header).groupBy("connection_id", "_run").agg(F.min("seq").alias("_first"))
    met = numbered.join(waits, ["connection_id", "_run"], "left")
    code = (
        F.when(~known, F.col("code"))
        .when(payload, F.when(F.col("_first").isNull(), "unexpected_binary").otherwise(payload_code("content", limit=limit)))
        .when(header & (F.col("seq") > F.col("_first")), "previous_header_unpaired")
        .otherwise(F.col("code"))
    )
    return met.select(*(F.col(c) for c in messages.columns if c != "code"), F.when(known & payload, F.col("_first")).alias("header_seq"), code.alias("code"))


def split_batches(batches: DataFrame) -> DataFrame:
    """A row per frame of batches (session_id, frames, sizes, content): idx, request_id, frame_id, start, size, content.

    Other columns of batches come along. A frame's bytes begin where those of the frames before it end. Batches whose sizes don't fit give no rows.
    """
    fits = (F.size("frames") == F.size("sizes")) & payload_code("content", "sizes").isNull()
    none = F.array(F.lit(0).cast("bigint"))
    starts = F.aggregate("sizes", none, lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))  # of each frame, and the end
    parts = F.transform(F.arrays_zip("frames", "sizes", starts.alias("starts")), lambda z: F.struct(z["frames"].alias("f"), z["sizes"].alias("size"), z["starts"].alias("start")))
    parts = F.slice(parts, F.lit(1), F.size("sizes"))
    rest = [c for c in batches.columns if c not in ("session_id", "frames", "sizes", "content")]
    each = batches.where(fits).select("session_id", *rest, "content", F.posexplode(parts).alias("idx", "p"))
    data = F.expr("substring(content, cast(p.start + 1 as int), cast(p.size as int))")
    return each.select("session_id", *rest, "idx", "p.f.request_id", "p.f.frame_id", "p.start", "p.size", data.alias("content"))


def gather_batches(results: DataFrame, keys: Sequence[str] = ("session_id", "batch_id")) -> DataFrame:
    """One row per batch with its frames' results in their order: idx, result."""
    return results.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "result"))), lambda r: r["result"]).alias("results"))


def responses_in_time(requests: DataFrame, responses: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """Responses with their requests by request_id, without those of expired requests; latency_ms, overhead_ms."""
    out = responses.join(requests, "request_id")
    if expired is not None:
        out = out.join(expired.select("request_id"), "request_id", "left_anti")
    latency = (F.col("received") - F.col("sent")) * 1000
    return out.withColumn("latency_ms", latency).withColumn("overhead_ms", F.greatest(F.lit(0.0), latency - F.col("total_ms")))


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_homography(text: str) -> tuple[float, ...]:
    """Nine numbers, whatever stands between them, scaled so that the last is 1 unless it vanishes."""
    h = [float(x) for x in re.findall(NUMBER, text)]
    if len(h) != 9:
        raise ValueError(f"a homography has 9 numbers, not {len(h)}")
    return tuple(v / h[8] for v in h) if abs(h[8]) > 1e-12 else tuple(h)


def homography_column(text) -> Column:
    """The same for a column: an array of nine doubles, or null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda s: s.cast("double"))
    last = F.element_at(found, 9)
    return F.when(F.size(found) == 9, F.when(F.abs(last) > 1e-12, F.transform(found, lambda v: v / last)).otherwise(found))


def load_homography(path: str) -> tuple[float, ...]:
    if path.endswith(".npy"):
        import numpy as np

        h = np.load(path, allow_pickle=False).ravel().tolist()
        if len(h) != 9:
            raise ValueError(f"a homography has 9 numbers, not {len(h)}")
        return tuple(h)
    with open(path, encoding="utf-8") as f:
        return parse_homography(f.read())


def parse_camera(text: str) -> Camera:
    """From JSON or YAML; names camera_matrix or K and dist_coeffs or dist, matrices flat or nested."""
    try:
        data = json.loads(text)
    except ValueError:
        data = {}
        for _, key, body in re.findall(r"(?ms)^([ \t]*)(camera_matrix|K|dist_coeffs|dist)[ \t]*:(.*?)(?=^\1[^\s\-\]]|\Z)", text):
            inner = re.search(r"data\s*:\s*\[(.*?)\]", body, re.S)
            data[key] = [float(x) for x in re.findall(NUMBER, inner.group(1) if inner else body)]

    def flat(x):
        if isinstance(x, dict):
            x = x.get("data", [])
        return [float(v) for row in x for v in (row if isinstance(row, list) else [row])]

    matrix, dist = (next((flat(data[k]) for k in names if k in data), []) for names in (("camera_matrix", "K"), ("dist_coeffs", "dist")))
    return Camera(tuple(matrix), tuple(dist))


def control_points(spark: SparkSession, path: str) -> DataFrame:
    """image_x, image_y, lon, lat from CSV with a header; u, v, longitude, latitude are other names. Places default to 0."""
    return resolve_control_points(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))


def resolve_control_points(raw: DataFrame) -> DataFrame:
    names = {c.strip().lower(): c for c in raw.columns}

    def pick(default, *options):
        found = [F.expr(f"try_cast(trim(`{names[o]}`) as double)") for o in options if o in names]
        return F.coalesce(*found, F.lit(default).cast("double"))

    out = raw.select(pick(None, "image_x", "u").alias("image_x"), pick(None, "image_y", "v").alias("image_y"), pick(0.0, "lon", "longitude").alias("lon"), pick(0.0, "lat", "latitude").alias("lat"))
    return out.where("image_x is not null and image_y is not null")


def parse_labels(lines: DataFrame, width, height, column: str = "value", lenient: bool = False) -> DataFrame:
    """Label lines, class first and coordinates from 0 to 1, as class_id, confidence, track_id, corners, px, py, kind.

    Eleven fields are a rotated box (eight coordinates), seven a box (centre and size), each followed by confidence and
    track; nine or ten and five or six are the same without track, or without both. Pixels are cut to integers. Lines
    with other counts or with words among the numbers are dropped; a negative track is none. lenient: any line of nine
    or more fields is a rotated box and of five or more a box, the second last field from the end is the confidence
    (from six fields on) and the last the track (from seven on), as older files were read.
    """
    w, h = (x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x) for x in (width, height))
    parts = F.transform(F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))
    out = lines.withColumn("_v", parts).withColumn("_n", F.size("_v"))
    at = lambda i: F.element_at("_v", i)
    n = F.col("_n")
    if lenient:
        turned, confidence, track = n >= 9, F.when(n >= 6, at(-2)).otherwise(1.0), F.when(n >= 7, at(-1))
        good = n >= 5
    else:
        turned = n.isin(9, 10, 11)
        first = F.when(turned, 10).otherwise(6)
        confidence, track = F.when(n >= first, F.get("_v", first - 1)).otherwise(1.0), F.when(n > first, F.get("_v", first))
        good = n.isin(5, 6, 7, 9, 10, 11)
    rows = out.where(good & ~F.exists("_v", lambda v: v.isNull()))
    cut = lambda v: v.cast("int").cast("double")
    eight = F.array(*(point(cut(at(i) * w), cut(at(i + 1) * h)) for i in (2, 4, 6, 8)))
    x1, x2 = (cut((at(2) + at(4) / k) * w) for k in (-2, 2))
    y1, y2 = (cut((at(3) + at(5) / k) * h) for k in (-2, 2))
    middle = lambda k: F.aggregate("corners", F.lit(0.0), lambda a, p: a + p[k]) / 4
    rows = rows.withColumns({"class_id": at(1).cast("int"), "confidence": confidence, "track_id": F.when(track >= 0, track.cast("int")), "kind": F.when(turned, "obb").otherwise("rect"), "corners": F.when(turned, eight).otherwise(rect_corners(x1, y1, x2, y2))})
    return rows.withColumns({"px": middle("x"), "py": middle("y")}).drop("_v", "_n")


def stem(path) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def image_list(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, frame_id of the images of a folder, by name; the names are listed, not the pixels read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}").load(folder).select("path").withColumn("name", stem("path"))
    return numbered(found, ["name", "path"], "frame_id").withColumn("frame_id", F.col("frame_id").cast("int"))


def label_folder(spark: SparkSession, folder: str, width, height, lenient: bool = False) -> DataFrame:
    """The labels of images/ in labels/<name>.txt; images without labels give one row with nulls."""
    images = image_list(spark, f"{folder}/images").select("name", "frame_id")
    lines = spark.read.text(f"{folder}/labels").withColumn("name", stem(F.col("_metadata.file_path")))
    return images.join(parse_labels(lines, width, height, lenient=lenient), "name", "left")
