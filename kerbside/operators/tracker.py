"""Identities for detections: a tracker per session that reads frames in order.

In batch, a session is a group; in streams (kerbside.streaming), its state is kept between micro-batches. The state of
a track is small and bounded, and the frames of a session are read one at a time. In batch, a task reads the first frames
of many sessions together, then their second ones, and so on.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import aabb, aabb_overlap, rotated_ious
from kerbside.shared import work_partitions


@dataclass(frozen=True)
class Settings:
    track_thresh: float = 0.5
    high_thresh: float = 0.6
    match_thresh: float = 0.8
    max_time_lost: int = 30
    min_hits: int = 3


# Fixed values of the motion model: variances of centre and size, and of their changes per frame.
PLACE_NOISE, PACE_NOISE, MEASURE_NOISE = 0.01, np.array([0.1, 0.1, 0.01, 0.01]), 0.1
FIRST_PLACE, FIRST_PACE = 1.0, 1e4
SECOND_STAGE_LIMIT = np.float32(0.5)
LEAST_SIDE = 1.0


class Motion:
    """Filters of values and their changes (centre and size), which share no term: arrays of shape (..., 4)."""

    PARTS = ("x", "v", "pxx", "pxv", "pvv")

    def __init__(self, z: np.ndarray):
        self.x = np.array(z, float)
        self.v, self.pxx, self.pxv, self.pvv = (np.full(self.x.shape, f) for f in (0.0, FIRST_PLACE, 0.0, FIRST_PACE))

    def predict(self, rows=slice(None)) -> np.ndarray:
        self.x[rows] += self.v[rows]
        self.pxx[rows] += 2 * self.pxv[rows] + self.pvv[rows] + PLACE_NOISE
        self.pxv[rows] += self.pvv[rows]
        self.pvv[rows] += PACE_NOISE
        return self.x[rows]

    def correct(self, z: np.ndarray, rows=slice(None)) -> None:
        x, v, pxx, pxv, pvv = (getattr(self, k)[rows] for k in self.PARTS)
        total = pxx + MEASURE_NOISE
        gx, gv, error = pxx / total, pxv / total, z - x
        self.x[rows], self.v[rows] = x + gx * error, v + gv * error
        self.pvv[rows], self.pxv[rows], self.pxx[rows] = pvv - gv * pxv, (1 - gx) * pxv, (1 - gx) * pxx

    def take(self, rows: np.ndarray) -> Motion:
        m = Motion.__new__(Motion)
        for k in self.PARTS:
            setattr(m, k, getattr(self, k)[rows])
        return m


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Rows matched with columns: the cheapest assignment of all of the shorter side, of which pairs under limit count.

    Pairs over the limit take part until the end, so this differs from an assignment of allowed pairs. What the longer
    side has left over costs limit each, whichever it is, and so makes no difference. Among equal choices the lowest wins.
    """
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = (cost.T if turned else cost).astype(np.float64)
    nearest = c.argmin(1)
    if len(set(nearest.tolist())) == len(c):  # each has its best to itself
        pairs = list(enumerate(nearest.tolist()))
    else:
        pairs = _cheapest(c)
    pairs = [(j, i) if turned else (i, j) for i, j in pairs]
    return [(i, j) for i, j in sorted(pairs, key=lambda p: p[1]) if cost[i, j] < np.float32(limit)]


def _cheapest(c: np.ndarray) -> list[tuple[int, int]]:
    """All rows with different columns at the least total, for no more rows than columns.

    Rows come in one by one. A newcomer looks for the cheapest chain of moves that ends in a free column: going to a
    taken column pushes its holder on to another one. Discounts on columns, which grow by what a chain has passed them
    at, keep every move's price from being negative, so that the cheapest chain is found nearest first.
    """
    rows, columns = c.shape
    holder, discount = [-1] * columns, np.zeros(columns)
    for newcomer in range(rows):
        price = c[newcomer] - discount  # of the cheapest chain so far that ends in each column
        came_from = np.full(columns, -1)
        settled = np.zeros(columns, bool)
        while True:
            column = int(np.where(settled, np.inf, price).argmin())
            settled[column] = True
            if holder[column] < 0:
                break
            moves = c[holder[column]] - discount
            onward = price[column] + moves - moves[column]
            cheaper = ~settled & (onward < price)
            price[cheaper], came_from[cheaper] = onward[cheaper], column
        discount[settled] += price[settled] - price[column]
        while came_from[column] >= 0:
            holder[column] = holder[came_from[column]]
            column = int(came_from[column])
        holder[column] = newcomer
    return [(i, j) for j, i in enumerate(holder) if i >= 0]


def costs(tracks: np.ndarray, track_classes: np.ndarray, boxes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One less the overlap where classes are equal and integer spans meet; else 1. tracks, boxes: cx, cy, w, h, degrees."""
    out = np.ones((len(tracks), len(boxes)), np.float32)
    if not out.size:
        return out
    mine, yours = np.asarray(tracks, float), np.asarray(boxes, float)
    fine_t, fine_d = np.isfinite(mine).all(1), np.isfinite(yours).all(1)
    meet = aabb_overlap(aabb(np.where(fine_t[:, None], mine, 0)), aabb(np.where(fine_d[:, None], yours, 0)))
    meet &= fine_t[:, None] & fine_d[None, :] & (np.asarray(track_classes)[:, None] == np.asarray(classes)[None, :])
    i, j = np.nonzero(meet)
    if len(i):
        out[i, j] = 1 - rotated_ious(mine[i], yours[j], LEAST_SIDE)
    return out


@dataclass
class Tracks:
    """Tracks as columns: track_id, box (cx, cy, w, h, degrees), class_id, frame_id, hits, unseen; motion counts where moving."""

    track_id: np.ndarray
    box: np.ndarray
    class_id: np.ndarray
    frame_id: np.ndarray
    hits: np.ndarray
    unseen: np.ndarray
    moving: np.ndarray
    motion: Motion

    @classmethod
    def born(cls, ids: np.ndarray, boxes: np.ndarray, classes: np.ndarray, frame_id: int) -> Tracks:
        n = len(ids)
        moving = np.isfinite(boxes).all(1)
        return cls(np.asarray(ids, np.int64), np.array(boxes, np.float32).reshape(-1, 5), np.array(classes, np.int64), np.full(n, frame_id), np.ones(n, np.int64), np.zeros(n, np.int64), moving, Motion(np.where(moving[:, None], boxes[:, :4], 0).astype(float)))

    def __len__(self) -> int:
        return len(self.track_id)

    def take(self, rows: np.ndarray) -> Tracks:
        return Tracks(*(getattr(self, f.name).take(rows) if f.name == "motion" else getattr(self, f.name)[rows] for f in fields(Tracks)))

    def with_(self, other: Tracks) -> Tracks:
        if not len(other):
            return self
        motion = Motion.__new__(Motion)
        for k in Motion.PARTS:
            setattr(motion, k, np.concatenate([getattr(self.motion, k), getattr(other.motion, k)]))
        return Tracks(*(motion if f.name == "motion" else np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(Tracks)))

    def predict(self) -> None:
        """Moves the tracks by a frame; those that get lost in numbers stand still from now on, and don't age."""
        rows = np.flatnonzero(self.moving)
        if not len(rows):
            return
        x = self.motion.predict(rows)
        fine = np.isfinite(x).all(1)
        if not fine.all():
            self.moving[rows[~fine]] = False
            rows, x = rows[fine], x[fine]
        self.box[rows, :2] = x[:, :2]
        self.box[rows, 2:4] = np.maximum(1.0, x[:, 2:])
        self.unseen[rows] += 1

    def seen(self, rows: np.ndarray, boxes: np.ndarray, frame_id: int) -> None:
        self.box[rows], self.frame_id[rows], self.unseen[rows] = boxes, frame_id, 0
        self.hits[rows] += 1
        fine = np.isfinite(boxes[:, :4]).all(1)
        self.moving[rows] &= fine
        on = self.moving[rows]
        if on.any():
            self.motion.correct(boxes[on, :4].astype(float), rows[on])


def _no_tracks() -> Tracks:
    return Tracks.born(np.zeros(0, np.int64), np.zeros((0, 5), np.float32), np.zeros(0, np.int64), 0)


@dataclass
class Tracker:
    """tracks: the followed ones, active of them, then the lost ones."""

    settings: Settings = field(default_factory=Settings)
    tracks: Tracks = field(default_factory=_no_tracks)
    active: int = 0
    next_id: int = 1

    @property
    def tracked(self) -> Tracks:
        return self.tracks.take(np.arange(self.active))

    @property
    def lost(self) -> Tracks:
        return self.tracks.take(np.arange(self.active, len(self.tracks)))

    def update(self, frame_id: int, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Track ids of a frame's detections, -1 for those without. boxes: cx, cy, w, h, degrees."""
        s, tracks = self.settings, self.tracks
        boxes, classes = np.asarray(boxes, np.float32).reshape(-1, 5), np.asarray(classes)
        scores = np.asarray(scores, np.float32)
        ids = np.full(len(boxes), -1)
        sure = scores >= np.float32(s.track_thresh)
        high, low = np.flatnonzero(sure), np.flatnonzero(~sure)
        tracks.predict()

        def match(rows: np.ndarray, detections: np.ndarray, limit, learn_class: bool):
            """Matches some tracks; gives places of those matched among rows, and the detections left over."""
            if not len(rows) or not len(detections):
                return np.zeros(0, int), detections
            pairs = assign(costs(tracks.box[rows], tracks.class_id[rows], boxes[detections], classes[detections]), limit)
            if not pairs:
                return np.zeros(0, int), detections
            at, found = np.array(pairs).T
            t, d = rows[at], detections[found]
            tracks.seen(t, boxes[d], frame_id)
            if learn_class:
                tracks.class_id[t] = classes[d]
            old = tracks.hits[t] >= s.min_hits
            ids[d[old]] = tracks.track_id[t[old]]
            return at, np.delete(detections, found)

        rows = np.arange(self.active)
        at, high = match(rows, high, s.match_thresh, True)
        left = np.delete(rows, at)
        at, _ = match(left, low, SECOND_STAGE_LIMIT, False)
        gone = np.delete(left, at)
        lost = np.concatenate([np.arange(self.active, len(tracks)), gone])  # the next stage may find them again in the same frame
        at, high = match(lost, high, s.match_thresh, True)
        back, lost = lost[np.sort(at)[::-1]], np.delete(lost, at)

        new = high[scores[high] >= np.float32(s.high_thresh)]
        born = Tracks.born(np.arange(self.next_id, self.next_id + len(new)), boxes[new], classes[new], frame_id)
        self.next_id += len(new)
        if s.min_hits <= 1:
            for t, box in zip(born.track_id, born.box, strict=True):
                near = np.flatnonzero((ids < 0) & (np.abs(boxes[:, :2] - box[:2]) < 1).all(1))
                if len(near):
                    ids[near[0]] = t
        lost = lost[tracks.unseen[lost] <= s.max_time_lost]
        stay = np.setdiff1d(rows, gone, assume_unique=True)
        if len(new) or len(gone) or len(back) or len(stay) + len(lost) < len(tracks):
            self.tracks = tracks.take(stay).with_(born).with_(tracks.take(np.concatenate([back, lost])))
            self.active = len(stay) + len(born) + len(back)
        return ids

    def dump(self) -> dict:
        """As values for JSON."""
        t = self.tracks
        motion = np.concatenate([getattr(t.motion, k) for k in Motion.PARTS], 1)
        pack = lambda i: {"track_id": int(t.track_id[i]), "box": [float(v) for v in t.box[i]], "class_id": int(t.class_id[i]), "frame_id": int(t.frame_id[i]), "motion": motion[i].tolist() if t.moving[i] else None, "hits": int(t.hits[i]), "unseen": int(t.unseen[i])}
        rows = [pack(i) for i in range(len(t))]
        return {"settings": asdict(self.settings), "tracked": rows[: self.active], "lost": rows[self.active :], "next_id": self.next_id}

    @classmethod
    def load(cls, state: dict) -> Tracker:
        rows = [*state["tracked"], *state["lost"]]
        column = lambda k, kind=np.int64: np.array([r[k] for r in rows], kind)
        tracks = Tracks.born(column("track_id"), np.array([r["box"] for r in rows], np.float32).reshape(-1, 5), column("class_id"), 0)
        tracks.frame_id, tracks.hits, tracks.unseen = column("frame_id"), column("hits"), column("unseen")
        tracks.moving = np.array([r["motion"] is not None for r in rows], bool)
        motion = np.array([r["motion"] or [0.0] * 20 for r in rows], float).reshape(-1, 20)
        for k, part in zip(Motion.PARTS, np.split(motion, 5, 1), strict=True):
            setattr(tracks.motion, k, part.copy())
        return cls(Settings(**state["settings"]), tracks, len(state["tracked"]), state["next_id"])


def _pairs(rows: np.ndarray, columns: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of a row and a column of the same group, row by row. rows, columns: each one's group, ascending."""
    n = np.bincount(columns, minlength=groups)
    each, first = n[rows], (np.cumsum(n) - n)[rows]
    i = np.repeat(np.arange(len(rows)), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each - first, each)


def assign_groups(cost: np.ndarray, i: np.ndarray, j: np.ndarray, group: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs assign() matches in each group. cost, i, j, group: of all pairs of a row and a column of a group, row by row."""
    out = np.zeros(len(cost), bool)
    some = np.zeros(int(group.max(initial=-1)) + 1, bool)
    some[group[(cost < np.float32(limit)) | ~np.isfinite(cost)]] = True  # elsewhere no pair counts
    at = np.flatnonzero(some[group])
    if not len(at):
        return out
    cost, i, j, group = cost[at], i[at], j[at], group[at]
    offset = int(i.max()) + 1
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    wide = np.add.reduceat(i == np.repeat(i[starts], sizes), starts)  # how many columns
    turned = np.repeat(sizes > wide * wide, sizes)
    short, long = np.where(turned, j + offset, i), np.where(turned, i, j + offset)
    order = np.lexsort((cost, short))  # among equal costs the first
    nearest = order[np.concatenate([[True], short[order][1:] != short[order][:-1]])]
    clash = np.zeros(len(some), bool)
    clash[group[~np.isfinite(cost)]] = True
    clash[group[nearest][np.bincount(long[nearest])[long[nearest]] > 1]] = True
    nearest = nearest[~clash[group[nearest]]]
    out[at[nearest[cost[nearest] < np.float32(limit)]]] = True
    for k in np.flatnonzero(clash[group[starts]]):
        here = slice(starts[k], starts[k] + sizes[k])
        for a, b in assign(cost[here].reshape(-1, wide[k]), limit):
            out[at[starts[k] + a * wide[k] + b]] = True
    return out


class Trackers:
    """A Tracker for each of several sessions, which take a frame each at a time, with the same results.

    tracks: those of all sessions in turn, of each the followed ones, then the lost ones; owner: the session of each.
    """

    def __init__(self, settings: Settings, sessions: int):
        self.settings, self.tracks = settings, _no_tracks()
        self.owner, self.active = np.zeros(0, np.int64), np.zeros(0, bool)
        self.next_id = np.ones(sessions, np.int64)

    def only(self, sessions: np.ndarray) -> None:
        """Forgets the tracks of sessions that aren't marked."""
        rows = np.flatnonzero(sessions[self.owner])
        if len(rows) < len(self.owner):
            self.tracks, self.owner, self.active = self.tracks.take(rows), self.owner[rows], self.active[rows]

    def taken(self, session: int) -> Trackers:
        """One session's tracker, as the first of its own."""
        rows = np.flatnonzero(self.owner == session)
        one = Trackers(self.settings, 1)
        one.tracks, one.owner, one.active = self.tracks.take(rows), np.zeros(len(rows), np.int64), self.active[rows]
        one.next_id[0] = self.next_id[session]
        return one

    def update(self, frame_id: np.ndarray, session: np.ndarray, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Track ids of the detections of one frame of each session. frame_id: by session; session: of each detection, ascending."""
        s, tracks, owner = self.settings, self.tracks, self.owner
        ids, groups = np.full(len(boxes), -1), len(self.next_id)
        sure = scores >= np.float32(s.track_thresh)
        high, low = np.flatnonzero(sure), np.flatnonzero(~sure)
        tracks.predict()
        found, used = np.zeros(len(tracks), bool), np.zeros(len(boxes), bool)
        fine_b = np.isfinite(boxes).all(1)
        span_b = aabb(np.where(fine_b[:, None], boxes, 0))

        def match(rows: np.ndarray, detections: np.ndarray, limit, learn_class: bool) -> None:
            i, j = _pairs(owner[rows], session[detections], groups)
            if not len(i):
                return
            fine_t = np.isfinite(tracks.box[rows]).all(1)
            span_t = aabb(np.where(fine_t[:, None], tracks.box[rows], 0))
            t, d = rows[i], detections[j]
            at = np.flatnonzero(fine_t[i] & fine_b[d] & (tracks.class_id[t] == classes[d]))
            p, q = span_t[i[at]], span_b[d[at]]
            at = at[(np.minimum(p[:, :2] + p[:, 2:], q[:, :2] + q[:, 2:]) > np.maximum(p[:, :2], q[:, :2])).all(1)]
            cost = np.ones(len(i), np.float32)
            cost[at] = 1 - rotated_ious(tracks.box[t[at]], boxes[d[at]], LEAST_SIDE)
            matched = assign_groups(cost, i, j, owner[t], limit)
            t, d = t[matched], d[matched]
            if not len(t):
                return
            found[t] = used[d] = True
            tracks.seen(t, boxes[d], frame_id[owner[t]])
            if learn_class:
                tracks.class_id[t] = classes[d]
            old = tracks.hits[t] >= s.min_hits
            ids[d[old]] = tracks.track_id[t[old]]

        rows = np.flatnonzero(self.active)
        match(rows, high, s.match_thresh, True)
        match(rows[~found[rows]], low, SECOND_STAGE_LIMIT, False)
        gone = rows[~found[rows]]
        stay = rows[found[rows]]
        lost = np.concatenate([np.flatnonzero(~self.active), gone])
        lost = lost[np.argsort(owner[lost], kind="stable")]
        high = high[~used[high]]
        match(lost, high, s.match_thresh, True)
        back, lost = lost[found[lost]][::-1], lost[~found[lost]]

        new = high[~used[high]]
        new = new[scores[new] >= np.float32(s.high_thresh)]
        mine, n_new = session[new], np.bincount(session[new], minlength=groups)
        born = Tracks.born(self.next_id[mine] + np.arange(len(new)) - (np.cumsum(n_new) - n_new)[mine], boxes[new], classes[new], frame_id[mine])
        self.next_id += n_new
        if s.min_hits <= 1:
            for t, box, k in zip(born.track_id, born.box, mine, strict=True):
                a, b = np.searchsorted(session, [k, k + 1])
                near = np.flatnonzero((ids[a:b] < 0) & (np.abs(boxes[a:b, :2] - box[:2]) < 1).all(1))
                if len(near):
                    ids[a + near[0]] = t
        lost = lost[tracks.unseen[lost] <= s.max_time_lost]
        if len(new) or len(gone) or len(back) or len(stay) + len(lost) < len(tracks):
            after = np.concatenate([back, lost])
            owner = np.concatenate([owner[stay], mine, owner[after]])
            order = np.argsort(owner, kind="stable")
            self.tracks, self.owner = tracks.take(stay).with_(born).with_(tracks.take(after)).take(order), owner[order]
            self.active = (np.arange(len(owner)) < len(owner) - len(lost))[order]
        return ids


#: Rows, and bytes of them, that a task gathers before it reads their frames, about: those of many sessions, or a part of one's.
HELD_ROWS, HELD_BYTES = 1 << 16, 32 << 20

BOX = ["cx", "cy", "w", "h", "angle"]


def track_frame(tracker: Tracker, frame_id: int, frame: pd.DataFrame) -> pd.DataFrame:
    """A frame's rows in the order of det_idx, with track_id; rows without a det_idx say that the frame is empty."""
    frame = frame.sort_values("det_idx", kind="stable")
    real = frame[frame["det_idx"].notna()]
    ids = tracker.update(int(frame_id), real[BOX].to_numpy(np.float32), real["confidence"].to_numpy(), real["class_id"].to_numpy(np.int64))
    return real.assign(track_id=ids.astype(np.int32))


def _ends(batch, columns) -> list[int]:
    """Where values of some columns differ from those of the row before."""
    import pyarrow.compute as pc

    code = [pc.fill_null(pc.dictionary_encode(batch.column(c)).indices, -1).to_numpy(zero_copy_only=False) for c in columns]
    return (np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1).tolist()


def track(detections: DataFrame, settings: Settings = Settings(), key: str = "session_id") -> DataFrame:
    """Detections with track_id: every session's frames are read in order.

    Rows with a null det_idx stand for frames without detections, which age the tracks. A session is one task's work,
    since each frame depends on the one before; its rows come sorted. A task gathers a bounded number of rows, whose
    sessions take a frame each at a time, and holds what the last one, which may go on, has come to.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    columns = [c for c in detections.columns if c != "track_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema if f.name != "track_id") + ", track_id int"

    def numbers(batch, name, kind, none=np.nan):
        return pc.fill_null(batch.column(name), pa.scalar(none, batch.column(name).type)).to_numpy(zero_copy_only=False).astype(kind)

    def run(batches):
        session, last = None, None  # the name and the tracker of the session that may go on

        def followed(batch, ends):
            """Rows of whole frames, which end at given places, with their ids."""
            nonlocal session, last
            real = batch.column("det_idx").is_valid().to_numpy(zero_copy_only=False)
            boxes = np.column_stack([numbers(batch, c, np.float32) for c in BOX])
            scores, classes, frames = numbers(batch, "confidence", np.float32), numbers(batch, "class_id", np.int64, -1), numbers(batch, "frame_id", np.int64, 0)
            starts = np.array([0, *ends[:-1]])
            names = [(name,) for name in batch.column(key).take(pa.array(starts)).to_pylist()]
            owner = np.cumsum([0, *(x != y for x, y in zip(names[1:], names, strict=False))])  # the session of each frame
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            n = np.diff(np.append(first, len(owner)))
            nth = np.arange(len(owner)) - first[owner]
            trackers = Trackers(settings, len(n))
            if names[0] == session:
                trackers.tracks, trackers.owner, trackers.active = last.tracks, last.owner, last.active
                trackers.next_id[0] = last.next_id[0]
            lengths = np.diff([*starts, batch.num_rows])
            rows = np.flatnonzero(real)
            turn = np.repeat(nth, lengths)[rows]
            order = np.argsort(turn, kind="stable")
            rows, bounds = rows[order], np.searchsorted(turn[order], np.arange(n.max() + 1))
            mine, ids = np.repeat(owner, lengths)[rows], np.full(batch.num_rows, -1, np.int32)
            boxes, scores, classes = boxes[rows], scores[rows], classes[rows]
            for k in range(n.max()):
                here = n > k
                frame = np.zeros(len(n), np.int64)
                frame[here] = frames[starts[first[here] + k]]
                part = slice(bounds[k], bounds[k + 1])
                ids[rows[part]] = trackers.update(frame, mine[part], boxes[part], scores[part], classes[part])
                if n[-1] == k + 1:
                    session, last = names[-1], trackers.taken(len(n) - 1)
                if (n == k + 1).any():
                    trackers.only(n > k + 1)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*columns, "track_id"]).filter(pa.array(real))

        held, size = [], [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size = [size[0] + batch.num_rows, size[1] + batch.nbytes]
            if size[0] < HELD_ROWS and size[1] < HELD_BYTES:
                continue
            batch = pa.concat_batches(held)
            ends = _ends(batch, (key, "frame_id"))
            held, size = [batch.slice(ends[-1]) if ends else batch], [0, 0]  # the frame that may go on
            if ends:
                yield followed(batch.slice(0, ends[-1]), ends)
        if held:
            batch = pa.concat_batches(held)
            yield followed(batch, [*_ends(batch, (key, "frame_id")), batch.num_rows])

    ordered = detections.select(*columns).repartition(work_partitions(detections.sparkSession), key).sortWithinPartitions(key, "frame_id", F.col("det_idx").asc_nulls_last())
    return ordered.mapInArrow(run, schema)
