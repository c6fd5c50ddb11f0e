"""Configuration: files, defaults, what clients may override, and the plan that follows."""

from __future__ import annotations

import copy
import json
import warnings
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults and limits.
DEFAULTS: dict[str, Any] = {
    "yolo": {"model_path": "models/3class410.onnx", "input_width": 1024, "input_height": 1024, "confidence": 0.5, "nms_threshold": 0.45, "is_obb": True, "use_cuda": True, "ort_threads": 4, "batch_size": 6, "batch_wait_ms": 30, "batch_max_pending": 16},
    "tracker": {"enabled": True, "track_thresh": 0.5, "high_thresh": 0.6, "match_thresh": 0.8, "max_time_lost": 30, "min_hits": 3},
}
FEATURES = {"tracker": True, "undistort": False, "geo_transform": False}
LIMITS = {
    "session_timeout_sec": 300, "max_payload_bytes": 104857600, "max_pending_tasks": 32, "max_pending_batches": 16, "max_requests_per_session": 8,
    "confidence_min": 0.05, "confidence_max": 0.95, "nms_min": 0.10, "nms_max": 0.95, "tracker_thresh_min": 0.05, "tracker_thresh_max": 0.99, "match_thresh_min": 0.10, "match_thresh_max": 0.99,
}
#: What a client may set: section, key, and the limits that hold; without limits an integer is asked for.
OVERRIDES = {
    ("yolo", "confidence"): ("confidence_min", "confidence_max"),
    ("yolo", "nms_threshold"): ("nms_min", "nms_max"),
    ("tracker", "track_thresh"): ("tracker_thresh_min", "tracker_thresh_max"),
    ("tracker", "high_thresh"): ("tracker_thresh_min", "tracker_thresh_max"),
    ("tracker", "match_thresh"): ("match_thresh_min", "match_thresh_max"),
    ("tracker", "max_time_lost"): None,
    ("tracker", "min_hits"): None,
}


def _scalar(raw: str) -> Any:
    if raw in ("true", "false"):
        return raw == "true"
    if len(raw) > 1 and raw[0] == raw[-1] == '"':
        return raw[1:-1]
    for kind in (float,) if "." in raw else (int,):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


def parse(text: str) -> dict[str, Any]:
    """JSON, or YAML of two levels of which lists and comments behind values stay text."""
    try:
        data = json.loads(text)
        if isinstance(data, dict):
            return data
    except ValueError:
        pass
    out: dict[str, Any] = {}
    section: dict[str, Any] | None = None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] == "#" or ":" not in bare:
            continue
        key, _, raw = bare.partition(":")
        key, raw = key.strip(), raw.strip()
        if line[0] not in " \t":
            section = None
            if raw:
                out[key] = _scalar(raw)
            else:
                section = out.setdefault(key, {})
        elif section is not None:
            section[key] = _scalar(raw)
    return out


def load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def lookup(config: dict, dotted: str, default: Any = None) -> Any:
    """config["a"]["b"] for "a.b"; the default where a level is missing."""
    for key in dotted.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def merged(base: dict, patch: dict) -> dict:
    """base with patch over it, level by level; None takes a key away."""
    out = copy.deepcopy(base)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = merged(out[k] if isinstance(out.get(k), dict) else {}, v)
        else:
            out[k] = copy.deepcopy(v)
    return out


def server_config(file: dict | None = None) -> dict:
    """defaults, features and limits with a file's sections over them."""
    f = file or {}
    defaults = merged(DEFAULTS, f.get("runtime_defaults", {}))
    for section in ("yolo", "tracker"):
        defaults = merged(defaults, {section: f.get(section, {})})
    return {"defaults": defaults, "features": merged(FEATURES, f.get("features", {})), "limits": merged(LIMITS, f.get("limits", {}))}


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _numbers(x: Any, size: int | None = None) -> bool:
    return isinstance(x, list) and bool(x) and all(map(_number, x)) and size in (None, len(x))


def camera_ok(section: dict) -> bool:
    return _numbers(section.get("camera_matrix"), 9) and isinstance(section.get("dist_coeffs"), list)


def geo_ok(section: dict) -> bool:
    return _numbers(section.get("homography"), 9) and _number(section.get("origin_lon")) and _number(section.get("origin_lat"))


def sanitized(request: dict, limits: dict | None = None) -> dict:
    """The part of a request's config that clients may set, within limits."""
    limits = merged(LIMITS, limits or {})
    config = request.get("config")
    out: dict[str, dict] = {}
    if not isinstance(config, dict):
        return out
    for (section, key), bounds in OVERRIDES.items():
        value = config.get(section, {}).get(key) if isinstance(config.get(section), dict) else None
        if not _number(value) or bounds is None and not isinstance(value, int):
            continue
        if bounds:
            value = min(max(float(value), limits[bounds[0]]), limits[bounds[1]])
        out.setdefault(section, {})[key] = value
    camera = config.get("undistort")
    if isinstance(camera, dict) and camera_ok(camera):
        out["undistort"] = {k: camera[k] for k in ("camera_matrix", "dist_coeffs")}
    geo = config.get("geo_transform")
    if isinstance(geo, dict) and geo_ok(geo):
        out["geo_transform"] = {k: geo[k] for k in ("homography", "origin_lon", "origin_lat")} | ({k: geo[k] for k in ("camera_matrix", "dist_coeffs")} if camera_ok(geo) else {})
    return out


def clamped(column, low: float, high: float) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def plan(request: dict, server: dict | None = None, strict_features: bool = False) -> dict:
    """{"pipeline": stage names, "config": ...} in canonical order.

    Camera or geographic parameters switch their stage on even where features says no, unless strict_features. A stage
    that lacks parameters is left out, with a warning.
    """
    server = server or server_config()
    features = dict(server["features"])
    asked = request.get("features")
    if isinstance(asked, dict):
        features |= {k: asked[k] for k in FEATURES if isinstance(asked.get(k), bool)}
    elif isinstance(request.get("pipeline"), list):
        features |= {k: True for k in FEATURES if k in request["pipeline"]}
    overrides = sanitized(request, server["limits"])
    config = merged(server["defaults"], overrides)
    if not (strict_features and isinstance(asked, dict)):
        features |= {k: True for k in ("undistort", "geo_transform") if k in overrides}
    fits = {"undistort": camera_ok(config.get("undistort", {})), "tracker": True, "geo_transform": geo_ok(config.get("geo_transform", {}))}
    for k in FEATURES:
        if features[k] and not fits[k]:
            warnings.warn(f"{k} is left out: its parameters are missing", stacklevel=2)
    return {"pipeline": ["decoder", "yolo", *(k for k in ("undistort", "tracker", "geo_transform") if features[k] and fits[k])], "config": config}
