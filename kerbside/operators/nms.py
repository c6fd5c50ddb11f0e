"""Suppression of overlapping boxes within a frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geometry import aabb, aabb_overlap, box_iou, rotated_ious
from kerbside.shared import kept_table, work_partitions

FRAME = ("session_id", "frame_id")
#: Pairs of boxes whose spans are compared at a time.
PAIRS = 1 << 20


def overlaps(a: np.ndarray, b: np.ndarray, rotated: bool = True) -> np.ndarray:
    """Overlap over union of pairs of boxes (n, 5) each: exact, or of their integer spans."""
    if rotated:
        return rotated_ious(a, b)
    p, q = aabb(a), aabb(b)
    sides = np.minimum(p[:, :2] + p[:, 2:], q[:, :2] + q[:, 2:]) - np.maximum(p[:, :2], q[:, :2])
    both = np.maximum(sides, 0).prod(1)
    union = p[:, 2:].prod(1) + q[:, 2:].prod(1) - both
    return np.divide(both, union, out=np.zeros(len(p)), where=union > 0)


def survivors(boxes: np.ndarray, scores: np.ndarray, threshold: float, rotated: bool = True) -> np.ndarray:
    """Indices that stay, best first: greedy, whatever the class. boxes: cx, cy, w, h, degrees; equal scores keep their order.

    Some of the best boxes that are left are compared with all after them at once: exactly where spans overlap. Boxes that
    aren't rotated compare by their integer spans.
    """
    order = np.argsort(-scores, kind="stable")
    b = boxes[order].astype(float)
    spans = aabb(b)
    alive = np.ones(len(b), bool)
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(b), step):
        rows = at + np.flatnonzero(alive[at : at + step])
        later = at + np.flatnonzero(alive[at:])
        meet = aabb_overlap(spans[rows], spans[later]) & (rows[:, None] < later[None, :])
        i, j = np.nonzero(meet)
        i, j = rows[i], later[j]
        over = overlaps(b[i], b[j], rotated) > threshold
        i, j = i[over], j[over]
        for row, p, q in zip(rows.tolist(), np.searchsorted(i, rows).tolist(), np.searchsorted(i, rows, "right").tolist(), strict=True):
            if q > p and alive[row]:
                alive[j[p:q]] = False
    return order[alive]


def suppress(detections: DataFrame, threshold: float = 0.45, rotated: bool = True, keys: Sequence[str] = FRAME, end_to_end: bool = False) -> DataFrame:
    """The detections that stay. end_to_end: all do, as the model has suppressed duplicates itself.

    The choice is sequential within a frame and independent between frames, whose rows come sorted; tasks hold the open
    frame only. keys must not be null.
    """
    if end_to_end:
        return detections

    names = list(keys)

    def stay(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows[names] != rows[names].shift()).any(axis=1).to_numpy()
        bounds = [*np.flatnonzero(new), len(rows)]
        boxes, scores = rows[["cx", "cy", "w", "h", "angle"]].to_numpy(float), rows["confidence"].to_numpy(float)
        kept = [a + np.sort(survivors(boxes[a:b], scores[a:b], threshold, rotated)) for a, b in zip(bounds, bounds[1:], strict=False)]
        return rows.iloc[np.concatenate(kept)] if kept else rows

    def run(batches):
        held = None  # the frame that may go on in the next batch
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[names] == rows[names].iloc[-1]).all(axis=1).to_numpy()
            held, rows = rows[last], rows[~last]
            if len(rows):
                yield stay(rows)
        if held is not None:
            yield stay(held)

    return detections.repartition(work_partitions(detections.sparkSession), *names).sortWithinPartitions(*names, "det_idx").mapInPandas(run, detections.schema)


def suppress_frames(frames: DataFrame, threshold: float = 0.45, rotated: bool = True) -> DataFrame:
    """frames: one row per frame with detections, an array of structs; works in streams too, as nothing is shuffled."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch["detections"]:
                row = [] if row is None else list(row)
                b = np.array([[d[k] for k in ("cx", "cy", "w", "h", "angle")] for d in row], float).reshape(-1, 5)
                stay = survivors(b, np.array([d["confidence"] for d in row], float), threshold, rotated) if row else []
                out.append([row[i] for i in sorted(stay)])
            yield batch.assign(detections=out)

    return frames.mapInPandas(run, frames.schema)


def overlapping_pairs(detections: DataFrame, threshold: float = 0.45, keys: Sequence[str] = FRAME) -> DataFrame:
    """keys, kept_idx, other_idx, iou of boxes of a frame whose integer spans (bbox) overlap by more than threshold, the better first."""
    ranked = detections.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "det_idx")))
    side = lambda name: ranked.select(*keys, F.struct("rank", "det_idx", "bbox").alias(name))
    p, q = F.col("p.bbox"), F.col("q.bbox")
    meet = (p["x"] < q["x"] + q["w"]) & (q["x"] < p["x"] + p["w"]) & (p["y"] < q["y"] + q["h"]) & (q["y"] < p["y"] + p["h"])
    pairs = side("p").join(side("q"), list(keys)).where((F.col("p.rank") < F.col("q.rank")) & meet)
    return pairs.withColumn("iou", box_iou("p.bbox", "q.bbox")).where(F.col("iou") > threshold).select(*keys, F.col("p.det_idx").alias("kept_idx"), F.col("q.det_idx").alias("other_idx"), "iou")


#: Cells that a box's side spans at most, about.
SPANNED = 8


def _meeting(detections: DataFrame, threshold: float, rotated: bool, keys: Sequence[str]) -> DataFrame:
    """keys, better, worse: ranks of boxes of a frame that overlap by more than threshold.

    Boxes meet in the cells of a grid that their spans touch, in the one where their common part begins. Cells are about
    twice as wide as the frame's boxes are on average.
    """
    five = ["cx", "cy", "w", "h", "angle"]

    @F.pandas_udf("struct<x:double,y:double,w:double,h:double>")
    def span(cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series, angle: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(aabb(np.column_stack([cx, cy, w, h, angle]).astype(float)), columns=list("xywh"))

    @F.pandas_udf("double")
    def iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series(overlaps(a[five].to_numpy(float), b[five].to_numpy(float), rotated))

    finite = reduce(lambda x, y: x & y, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")) for c in five))
    spans = detections.where(finite).select(*keys, "rank", *five, span(*five).alias("s"))
    side = F.greatest("s.w", "s.h")
    frame = Window.partitionBy(*keys)
    wide = F.greatest(F.lit(1.0), F.avg(side).over(frame) * 2, F.max(side).over(frame) / SPANNED)
    celled = spans.withColumn("cell", wide)
    along = lambda k, n: F.explode(F.sequence(F.floor(F.col(f"s.{k}") / F.col("cell")), F.floor((F.col(f"s.{k}") + F.col(f"s.{n}")) / F.col("cell"))))
    placed = celled.withColumn("_x", along("x", "w")).withColumn("_y", along("y", "h"))
    half = lambda name: placed.select(*keys, "_x", "_y", F.struct("rank", "cell", "s", *five).alias(name))
    p, q = F.col("p.s"), F.col("q.s")
    begins = {k: F.greatest(p[k], q[k]) for k in "xy"}
    ends = {k: F.least(p[k] + p[n], q[k] + q[n]) for k, n in (("x", "w"), ("y", "h"))}
    meet = (F.col("p.rank") < F.col("q.rank")) & (ends["x"] > begins["x"]) & (ends["y"] > begins["y"])
    here = (F.floor(begins["x"] / F.col("p.cell")) == F.col("_x")) & (F.floor(begins["y"] / F.col("p.cell")) == F.col("_y"))
    pairs = half("p").join(half("q"), [*keys, "_x", "_y"]).where(meet & here)
    return pairs.withColumn("iou", iou("p", "q")).where(F.col("iou") > threshold).select(*keys, F.col("p.rank").alias("better"), F.col("q.rank").alias("worse"))


def suppress_by_rounds(detections: DataFrame, threshold: float = 0.45, rotated: bool = True, keys: Sequence[str] = FRAME) -> DataFrame:
    """What suppress() keeps, for frames of any number of boxes: no task holds a frame.

    In each round a box stays if it overlaps no better one that is undecided, and those that overlap one that stays go.
    There are as many rounds as the longest chain of boxes in which each overlaps the next, worse one. Rows of a frame
    with equal confidence are ranked by det_idx; det_idx must be there, and once in a frame.
    """
    names, ranked = list(keys), score_order(detections, keys)
    edges = kept_table(_meeting(ranked, threshold, rotated, keys), "edges")
    gone = []
    while not edges.isEmpty():
        stay = edges.select(*names, "better").distinct().join(edges.select(*names, F.col("worse").alias("better")).distinct(), [*names, "better"], "left_anti")
        stay = kept_table(stay, "stay")
        out = kept_table(edges.join(stay, [*names, "better"]).select(*names, "worse").distinct(), "out")
        gone.append(out)
        left = edges.join(stay, [*names, "better"], "left_anti").join(out, [*names, "worse"], "left_anti")
        edges = kept_table(left.join(out.withColumnRenamed("worse", "better"), [*names, "better"], "left_anti").select(*names, "better", "worse"), "edges")
    if gone:
        ranked = ranked.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("worse", "rank"), [*names, "rank"], "left_anti")
    return ranked.select(*detections.columns)


def score_order(detections: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Adds rank by falling confidence; equal ones by det_idx."""
    return detections.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "det_idx")))
