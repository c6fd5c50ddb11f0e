"""Every query against its SQL, at the smallest size."""

import datetime
import math

import duckdb
import numpy as np
import pytest
from kerbside import queries as Q
from kerbside.adapter import boxes, tracks
from kerbside.operators import tracker
from kerbside.queries import QUERIES, SQL
from kerbside.sources import readers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may keep nothing of the smallest size.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())
        flags = [c for c, t in df.dtypes if t == "boolean"]
        for c in flags:  # a test that is always the same tests nothing
            assert len({r[sorted(df.columns).index(c)] for r in got}) > 1


def test_slices_of_a_session_beyond_the_payload_limit(spark, monkeypatch):
    """All rows stay: of a hot session, with text beyond ASCII, null, empty and longer than a payload."""
    monkeypatch.setattr(readers, "MAX_PAYLOAD", 300)
    monkeypatch.setattr(readers.payload_code, "__defaults__", (None, 300))
    monkeypatch.setattr(Q, "BATCH_BYTES", 100)
    monkeypatch.setattr(Q, "BATCH_FRAMES", 7)
    texts = ["view", "été", "", None, "x" * 150, "y" * 400, "z" * 199]
    events = [(u, i * 3, texts[(i + len(u)) % 7]) for u, n in (("hot", 200), ("b", 3)) for i in range(n)] + [(None, 2**40, "w")]
    got = Q._sliced(spark.createDataFrame(events, "session_id string, event_id long, content string").repartition(3)).collect()
    want = []
    for u in ("hot", "b", None):
        start = 0
        for idx, t in enumerate(t for s, _, t in sorted((e for e in events if e[0] == u), key=lambda e: e[1])):
            want.append((u, idx, None if t is None else start, None if t is None else len(t), t))
            start += len(t or "")
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_vehicle_csv_of_every_row(spark):
    t = tracks(spark, DATA).collect()
    got = {(r.track_id, r.frame_id): r for r in QUERIES["vehicle_csv_all"](spark, DATA).collect()}
    assert set(got) == {(r.track_id, r.frame_id) for r in t} and len(got) == len(t) > 900
    for p in t:
        row, w = got[p.track_id, p.frame_id], Q.H[6] * p.px + Q.H[7] * p.py + Q.H[8]
        ground = [(Q.H[i] * p.px + Q.H[i + 1] * p.py + Q.H[i + 2]) / w for i in (0, 3)]
        values = [(row.pixel_x, p.px, 1), (row.pixel_y, p.py, 1), (row.ground_x, ground[0], 3), (row.ground_y, ground[1], 3)]
        for text, v, places in values[: 4 if p.track_id % 2 == 0 else 2]:
            assert len(text.split(".")[1]) == places and abs(float(text) - v) <= 0.5 * 10**-places + 1e-9
        assert p.track_id % 2 == 0 or row.ground_x is row.ground_y is None
        if p.track_id % 2 == 0:  # some 700 metres from the origin at most
            assert len(row.lat.split(".")[1]) == 8 and abs(float(row.lat) - Q.ORIGIN[1]) < 0.02 and abs(float(row.lon) - Q.ORIGIN[0]) < 0.02
        else:
            assert row.lat is row.lon is None


def test_pairs_begin_at_every_point(spark):
    v = {r.frame: r for r in Q._validated(spark, DATA).collect()}
    got = {(r.first, r.second): r for r in QUERIES["pair_distances_all"](spark, DATA).collect()}
    assert set(got) == {(f, f + 7) for f in v if f + 7 in v} and len(got) > 900
    for (a, b), row in got.items():
        for k in ("pred", "true"):
            want = math.hypot(v[a][f"{k}_gx"] - v[b][f"{k}_gx"], v[a][f"{k}_gy"] - v[b][f"{k}_gy"])
            assert abs(row[f"{k}_m"] - want) <= 0.00005 + 1e-9 * want


def plainly_tracked(rows):
    """(session_id, frame_id, det_idx): track_id, by one tracker per session."""
    out, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.frame_id, r.det_idx)):
        at.setdefault((r.session_id, r.frame_id), []).append(r)
    trackers = {}
    for (session, frame), found in at.items():
        t = trackers.setdefault(session, tracker.Tracker())
        ids = t.update(frame, np.array([[r[c] for c in tracker.BOX] for r in found], np.float32), np.array([r.confidence for r in found]), np.array([r.class_id for r in found]))
        out |= {(session, frame, r.det_idx): int(i) for r, i in zip(found, ids)}
    return out


def test_all_events_are_tracked(spark):
    data = DATA.replace("0.001", "0.01")
    got = QUERIES["track_objects"](spark, data).collect()
    want = plainly_tracked(Q._detections(spark, data).collect())
    assert {(r.session_id, r.frame_id, r.det_idx): r.track_id for r in got} == want
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in spark.read.parquet(f"{data}/events.parquet").select("event_id").collect())
    assert len({r.session_id for r in got}) > 5 and len({(r.session_id, r.track_id) for r in got if r.track_id > 0}) > 20


def test_straight_lines_keep_their_tracks(spark):
    """Four boxes of each of three sessions move slowly along their rows."""
    scene = spark.range(2400).select((F.col("id") % 3).cast("string").alias("session_id"), (F.floor(F.col("id") / 12) + 1).cast("int").alias("frame_id"), (F.floor(F.col("id") / 3) % 4).cast("int").alias("det_idx")).withColumns(
        {"cx": F.col("frame_id") * 1.5 + F.col("det_idx") * 3, "cy": F.col("det_idx") * 100.0, "w": F.lit(40.0), "h": F.lit(20.0), "angle": F.lit(0.0), "confidence": F.lit(0.9), "class_id": F.col("det_idx") % 2}
    )
    rows = tracker.track(scene).collect()
    assert len(rows) == 2400 and all(r.track_id == (r.det_idx + 1 if r.frame_id > 2 else -1) for r in rows)


def test_vectors_are_dealt_to_sessions(spark):
    """Sessions hold a bounded range of vectors each, in order."""
    rows = boxes(spark, DATA).select("session_id", "frame_id").collect()
    of = {}
    for r in rows:
        of.setdefault(r.session_id, []).append(r.frame_id)
    assert len(rows) == 500 and len(of) > 1 and all(max(f) - min(f) < 128 for f in of.values())
    assert len({r.session_id for r in QUERIES["planned_pipeline"](spark, DATA).collect()}) == len(of)
