"""Streams: identities across micro-batches, headers that wait for payloads, sliding rates, sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.operators.tracker import BOX, Settings, Tracker, track_frame

GAP_MS, IDLE_MS = 1200, 300_000

#: A frame per row: detections is JSON of [{det_idx, cx, cy, w, h, angle, confidence, class_id}], config any text.
FRAME_SCHEMA = "session_id string, frame_id int, kind string, config string, detections string"
OUT_SCHEMA = "session_id string, frame_id int, det_idx int, cx double, cy double, w double, h double, angle double, confidence double, class_id int, track_id int, late boolean, epoch int"


class SessionTracker(StatefulProcessor):
    """One session: its tracker, the next frame, and frames that wait for one before them.

    Frames are read in order. One that comes after its turn is told at once, untracked (late). Where a frame is
    missing, those after it wait for GAP_MS, then the turn passes to the least that waits. Frame 1 turns the count
    back, but keeps the tracker. A row of kind reset, another config, or IDLE_MS without rows begin a new epoch.
    """

    def __init__(self, settings: Settings = Settings(), gap_ms: int = GAP_MS, idle_ms: int = IDLE_MS):
        self.settings, self.gap_ms, self.idle_ms = settings, gap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data string")
        self.waiting = handle.getMapState("waiting", "frame_id int", "row string")

    def _load(self) -> dict:
        data = self.state.get() if self.state.exists() else None
        return json.loads(data[0]) if data else {"tracker": Tracker(self.settings).dump(), "next": 1, "config": None, "epoch": 0, "seen": None, "gap": None}

    def _emit(self, key: str, tracker: Tracker, frame_id: int, detections: str | None, late: bool, epoch: int) -> pd.DataFrame:
        rows = pd.DataFrame(json.loads(detections or "[]"), columns=["det_idx", *BOX, "confidence", "class_id"])
        rows = rows.assign(track_id=-1) if late else track_frame(tracker, frame_id, rows)
        return rows.assign(session_id=key, frame_id=frame_id, late=late, epoch=epoch)[[c.split()[0] for c in OUT_SCHEMA.split(", ")]]

    def _clear(self, state: dict, config) -> dict:
        for k in [k[0] for k in self.waiting.keys()]:
            self.waiting.removeKey((k,))
        return {"tracker": Tracker(self.settings).dump(), "next": 1, "config": config, "epoch": state["epoch"] + 1, "seen": None, "gap": None}

    def _drain(self, key: str, state: dict, tracker: Tracker, jump: bool) -> Iterator[pd.DataFrame]:
        held = sorted(k[0] for k in self.waiting.keys())
        for frame_id in held:
            if frame_id != state["next"] and not jump:
                break
            jump = False
            row = self.waiting.getValue((frame_id,))[0]
            self.waiting.removeKey((frame_id,))
            yield self._emit(key, tracker, frame_id, row, False, state["epoch"])
            state["next"] = frame_id + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, state = timerValues.getCurrentProcessingTimeInMs(), self._load()
        if state["seen"] is not None and now - state["seen"] > self.idle_ms:
            state = self._clear(state, state["config"])
        tracker = Tracker.load(state["tracker"])
        for part in rows:
            part = part.assign(_first=part["kind"].eq("reset").cumsum()).sort_values(["_first", "frame_id"], kind="stable")
            for row in part.itertuples():
                if row.kind == "reset" or state["config"] is not None and row.config is not None and row.config != state["config"]:
                    state = self._clear(state, row.config)
                    tracker = Tracker(self.settings)
                if row.kind == "reset" or row.frame_id is None or row.frame_id <= 0:
                    continue
                state["config"] = row.config if row.config is not None else state["config"]
                if row.frame_id == 1 and state["next"] > 1:
                    state["next"] = 1
                if row.frame_id < state["next"]:
                    yield self._emit(key[0], tracker, int(row.frame_id), row.detections, True, state["epoch"])
                else:
                    self.waiting.updateValue((int(row.frame_id),), (row.detections,))
        yield from self._finish(key[0], state, tracker, now)

    def _finish(self, key: str, state: dict, tracker: Tracker, now: int) -> Iterator[pd.DataFrame]:
        jump = state["gap"] is not None and now >= state["gap"]
        yield from self._drain(key, state, tracker, jump)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if next(iter(self.waiting.keys()), None) is not None:
            state["gap"] = now + self.gap_ms if jump or state["gap"] is None else state["gap"]
            self.handle.registerTimer(max(state["gap"], now + 1))
        else:
            state["gap"] = None
            self.handle.registerTimer(now + self.idle_ms)
        state["seen"], state["tracker"] = now, tracker.dump()
        self.state.update((json.dumps(state),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, state = timerValues.getCurrentProcessingTimeInMs(), self._load()
        if state["gap"] is None:
            if state["seen"] is not None and now - state["seen"] >= self.idle_ms:
                self.state.clear()
            return
        yield from self._finish(key[0], state, Tracker.load(state["tracker"]), now)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, settings: Settings = Settings(), gap_ms: int = GAP_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """frames (FRAME_SCHEMA), a stream, to tracked detections. Needs the RocksDB state store."""
    processor = SessionTracker(settings, gap_ms, idle_ms)
    return frames.groupBy("session_id").transformWithStateInPandas(processor, OUT_SCHEMA, "append", "ProcessingTime")


def current_epoch(tracked: DataFrame, retired: DataFrame) -> DataFrame:
    """Results without those of sessions that ended before them: retired has session_id, epoch."""
    last = retired.groupBy("session_id").agg(F.max("epoch").alias("_gone"))
    return tracked.join(last, "session_id", "left").where("_gone is null or epoch > _gone").drop("_gone")


def stale(tracked: DataFrame, retired: DataFrame) -> DataFrame:
    """What current_epoch() leaves out, as a refused row per frame: session_id, frame_id, epoch, code."""
    last = retired.groupBy("session_id").agg(F.max("epoch").alias("_gone"))
    gone = tracked.join(last, "session_id").where("epoch <= _gone")
    return gone.select("session_id", "frame_id", "epoch", F.lit("stale_session").alias("code")).distinct()


def paired(headers: DataFrame, payloads: DataFrame, wait: str = "60 seconds") -> DataFrame:
    """Headers (request_id, header_time, ...) with their payloads (request_id, payload_time, content).

    A header whose payload doesn't come within wait is told with code header_timeout. In streams both need watermarks,
    which this sets.
    """
    h = headers.withWatermark("header_time", wait).alias("h")
    p = payloads.withWatermark("payload_time", wait).alias("p")
    near = F.expr(f"h.request_id = p.request_id and p.payload_time between h.header_time and h.header_time + interval {wait}")
    out = h.join(p, near, "left_outer")
    return out.select("h.*", "p.payload_time", "p.content", F.when(F.col("p.payload_time").isNull(), "header_timeout").alias("code"))


def first_passes(observed: DataFrame, keys=("session_id", "track_id"), time: str = "pass_time", late: str = "10 minutes") -> DataFrame:
    """The first row told of each track in each lane, of a stream of observations inside lanes (lane_id, keys, time).

    What comes again, or late, within the watermark's delay after a track was told isn't told again; its state is given
    up after that, so that a track that is away for longer passes anew.
    """
    return observed.withWatermark(time, late).dropDuplicatesWithinWatermark(["lane_id", *keys])


def pass_rate(observed: DataFrame, keys=("session_id", "track_id"), time: str = "pass_time", window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, lane_id, passes, per_hour of observations inside lanes: each track counts once in a lane."""
    return _rate(first_passes(observed, keys, time, late), time, window, slide)


def sliding_rate(passes: DataFrame, time: str = "pass_time", window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, lane_id, passes, per_hour."""
    return _rate(passes.withWatermark(time, late), time, window, slide)


def _rate(passes: DataFrame, time: str, window: str, slide: str) -> DataFrame:
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    counted = passes.groupBy(F.window(time, window, slide), "lane_id").agg(F.count(F.lit(1)).alias("passes"))
    return counted.withColumn("per_hour", F.col("passes") * 3600.0 / seconds)


def sessions(rows: DataFrame, time: str, gap: str = "300 seconds", keys=("session_id",), late: str = "10 minutes") -> DataFrame:
    """Stretches of rows without a gap: keys, started, ended, rows."""
    grouped = rows.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.select(*keys, F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "rows")
