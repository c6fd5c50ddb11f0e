"""Lanes: which observations are inside, entries, passes, occupancy, queues and flow.

lanes: lane_id, name, polygon array<struct<x,y>>, visible. Few lanes, of which the size is checked, are sent to all
tasks; more are met through a grid of cells, an equi-join, or, where only figures or entries are asked for, in crowds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.geometry import edges, in_polygon, polygon_literal
from kerbside.operators import crowds
from kerbside.operators.kinematics import KEYS
from kerbside.shared import kept_table

#: So many lanes are sent to all tasks.
FEW = 1000


def lane_table(spark, lanes: Sequence[tuple]) -> DataFrame:
    """From (lane_id, name, points[, visible])."""
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("lane_id"), F.lit(n).alias("name"), polygon_literal(p).alias("polygon"), F.lit(bool(*v or [True])).alias("visible")) for i, n, p, *v in lanes))).alias("lane"))
    return rows.select("lane.*")


def usable(lanes: DataFrame) -> DataFrame:
    return lanes.where(F.coalesce("visible", F.lit(True)) & (F.size("polygon") >= 3))


def lane_observations(tracks: DataFrame, lanes: DataFrame, inclusive: bool = False) -> DataFrame:
    """Each observation with each usable lane, and inside. Without lanes there are no rows."""
    good = usable(lanes).select("lane_id", F.col("name").alias("lane_name"), "polygon")
    if good.limit(FEW + 1).count() > FEW:
        raise ValueError(f"over {FEW} lanes: use inside_only(), which joins by cells")
    # every pair is asked for; the lanes' number has been checked
    return tracks.join(F.broadcast(good), F.lit(True)).withColumn("inside", in_polygon("px", "py", "polygon", inclusive)).drop("polygon")


#: Cells of a lane along its longer side, about.
ACROSS = 8


def grid(lanes: DataFrame, cell: float | None = None) -> DataFrame:
    """lane_id, lane_name, level, _x, _y, whole, polygon: the cells of each usable lane, squares of 2 ** level pixels.

    Every lane has cells of its own size, an eighth of its longer side, about, so that neither a long lane has many nor a
    short one shares its cell with many others. Cells that no edge touches are left out or lie in the lane as a whole,
    where no point is tested any more: polygon is null. cell: the least size of cells, for all lanes alike.
    """
    sides = [(f(F.transform("polygon", lambda p: p[k])), k, n) for k in "xy" for f, n in ((F.array_min, "lo"), (F.array_max, "hi"))]
    out = usable(lanes).select("lane_id", F.col("name").alias("lane_name"), "polygon", *(c.alias(f"_{n}{k}") for c, k, n in sides))
    longer = F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy"), F.lit(2.0**-20))
    size = longer / ACROSS if cell is None else F.lit(float(cell))
    out = out.withColumn("level", F.ceil(F.log2(size)).cast("int")).withColumn("_c", F.pow(F.lit(2.0), "level"))
    for k in "xy":
        out = out.withColumn(f"_{k}", F.explode(F.sequence(F.floor(F.col(f"_lo{k}") / F.col("_c")), F.floor(F.col(f"_hi{k}") / F.col("_c")))))
    out = out.withColumns({f"_{n}{k}": (F.col(f"_{k}") + d) * F.col("_c") for k in "xy" for n, d in (("lo", 0), ("hi", 1))})
    corner = [(F.col(f"_{m}x"), F.col(f"_{n}y")) for m in ("lo", "hi") for n in ("lo", "hi")]

    def touches(e):
        """Whether an edge meets the square: their spans do, and the square's corners aren't all on one side of it."""
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= F.col("_hix")) & (F.greatest(a["x"], b["x"]) >= F.col("_lox")) & (F.least(a["y"], b["y"]) <= F.col("_hiy")) & (F.greatest(a["y"], b["y"]) >= F.col("_loy"))
        side = [F.signum((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])) for x, y in corner]
        return near & (F.abs(reduce(lambda p, q: p + q, side)) < 4)

    out = out.withColumn("_touched", F.exists(edges("polygon"), touches))
    middle = in_polygon((F.col("_lox") + F.col("_hix")) / 2, (F.col("_loy") + F.col("_hiy")) / 2, "polygon")
    out = out.withColumn("whole", ~F.col("_touched")).where(F.col("_touched") | middle)
    return out.select("lane_id", "lane_name", "level", "_x", "_y", "whole", F.when(F.col("_touched"), F.col("polygon")).alias("polygon"))


def inside_only(tracks: DataFrame, lanes: DataFrame, cell: float | None = None, inclusive: bool = False) -> DataFrame:
    """The pairs of observations and lanes that hold them, for any number of lanes: both meet in the cells of grid().

    A point looks up one cell for each size of cells that lanes have; adaptive execution splits what crowded cells hold.
    """
    cells = grid(lanes, cell)
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # powers of two of pixels: some dozens at most
    placed = tracks.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumns({f"_{k}": F.floor(F.col(f"p{k}") / F.pow(F.lit(2.0), "level")) for k in "xy"})
    met = placed.join(cells, ["level", "_x", "_y"]).where(F.col("whole") | in_polygon("px", "py", "polygon", inclusive))
    return met.drop("level", "_x", "_y", "whole", "polygon")


FIGURES = ("pass_count", "flow_count", "queue_count")


def lane_figures(tracks: DataFrame, lanes: DataFrame, keys: Sequence[str] = KEYS, now: int | None = None, max_age: int | None = None) -> DataFrame:
    """lane_id, name, pass_count, flow_count, queue_count of all lanes, as pass_counts() and occupancy() have them, for any number.

    No observation outside of a lane is made: a track is in those lanes that hold its last observation.
    """
    still = F.col("stationary") if "stationary" in tracks.columns else F.lit(False)
    last = tracks.groupBy(*keys).agg(F.max_by(F.struct("px", "py", "frame_id", still.alias("stationary")), "frame_id").alias("r")).select(*keys, "r.*")
    if max_age is not None:
        last = last.where(F.lit(now) - F.col("frame_id") <= max_age)
    # all are looked up at once: the last row of a track is marked
    rows = tracks.select(*keys, "px", "py", F.lit(False).alias("_last"), F.lit(False).alias("_still")).unionByName(last.select(*keys, "px", "py", F.lit(True).alias("_last"), F.col("stationary").alias("_still")))
    named = kept_table(crowds.named_shapes(usable(lanes).where(F.col("lane_id").isNotNull()).select("lane_id", "polygon")), "lanes")
    schema = T.StructType([lanes.schema["lane_id"], *(T.StructField(c, T.LongType()) for c in FIGURES)])
    # each shape goes by its first lane
    found = crowds.searched(rows, named.withColumn("names", F.slice("names", 1, 1)), keys, crowds.passed(keys), schema, keys)
    counts = found.groupBy(F.col("lane_id").alias("_first")).agg(*(F.sum(c).alias(c) for c in FIGURES))
    counts = named.select(F.get("names", 0)["lane_id"].alias("_first"), F.explode("names.lane_id").alias("lane_id")).join(counts, "_first").drop("_first")
    return lanes.select("lane_id", "name").join(counts, "lane_id", "left").select("lane_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in FIGURES))


def entries_inside(tracks: DataFrame, lanes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What entries() tells, for any number of lanes: a track's observation inside a lane enters it if the one before isn't inside it, too.

    Adds lane_id, and lane_name if lanes have a name.
    """
    w = Window.partitionBy(*keys).orderBy("frame_id")
    rows = tracks.withColumns({"_bx": F.lag("px").over(w), "_by": F.lag("py").over(w)})
    name = [F.col("name").alias("lane_name")] if "name" in lanes.columns else []
    named = crowds.named_shapes(usable(lanes).select("lane_id", *name, "polygon"))
    schema = T.StructType([*tracks.schema, *named.schema["names"].dataType.elementType])
    fields = schema.names[len(tracks.columns) :]
    return crowds.searched(rows, named, [], crowds.entered(tracks.columns, fields), schema, [*keys, "frame_id"])


def _lane_window(keys):
    return Window.partitionBy("lane_id", *keys).orderBy("frame_id")


def entries(observed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observations inside of which the track's last one before was not."""
    before = F.coalesce(F.lag("inside").over(_lane_window(keys)), F.lit(False))
    return observed.withColumn("_before", before).where("inside and not _before").drop("_before")


def first_passes(observed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The time of each track's first observation in each lane."""
    return observed.where("inside").groupBy("lane_id", *keys).agg(F.min("frame_time").alias("first_time"))


def pass_counts(observed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tracks ever inside each lane, 0 included."""
    return observed.groupBy("lane_id").agg(F.count_distinct(F.when(F.col("inside"), F.struct(*keys))).alias("pass_count"))


def occupancy(observed: DataFrame, keys: Sequence[str] = KEYS, now: int | None = None, max_age: int | None = None) -> DataFrame:
    """flow_count: tracks whose last observation is inside; queue_count: of these, those that stand (column stationary).

    A track that vanishes inside a lane stays in it, unless max_age frames have passed up to now.
    """
    standing = F.col("stationary") if "stationary" in observed.columns else F.lit(False)
    last = observed.groupBy("lane_id", *keys).agg(F.max_by(F.struct("inside", standing.alias("stationary"), "frame_id"), "frame_id").alias("r"))
    fresh = F.lit(True) if max_age is None else F.lit(now) - F.col("r.frame_id") <= max_age
    return last.groupBy("lane_id").agg(F.count_if(F.col("r.inside") & fresh).alias("flow_count"), F.count_if(F.col("r.inside") & F.col("r.stationary") & fresh).alias("queue_count"))


def flow_rate(passes: DataFrame, window: float = 300.0, closed: bool = False) -> DataFrame:
    """Adds to each first pass the rate per hour of those in the window that ends with it; closed: a pass exactly window old counts.

    Passes are dealt by stretches of time as long as the window, each to its own stretch and to the next, where it counts only.
    """
    width = int(window * 1_000_000)
    timed = passes.withColumn("_us", F.round(F.col("first_time") * 1_000_000).cast("long"))
    dealt = timed.withColumn("_later", F.explode(F.sequence(F.lit(0), F.when(F.col("_us").isNull(), 0).otherwise(1))))
    dealt = dealt.withColumn("_stretch", F.expr(f"_us div {width} - if(_us % {width} < 0, 1, 0) + _later"))
    w = Window.partitionBy("lane_id", "_stretch").orderBy("_us").rangeBetween(-width + (0 if closed else 1), 0)
    return dealt.withColumn("flow_rate", F.count(F.lit(1)).over(w) * (3600.0 / window)).where("_later = 0").drop("_us", "_later", "_stretch")


def flow_rate_at(passes: DataFrame, now: float, window: float = 300.0, closed: bool = False) -> DataFrame:
    """The rate per hour of each lane at one time."""
    age = F.lit(now) - F.col("first_time")
    recent = (age >= 0) & ((age <= window) if closed else (age < window))
    return passes.groupBy("lane_id").agg((F.count_if(recent) * (3600.0 / window)).alias("flow_rate"))


def lane_paths(observed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The names of the lanes that each track entered, in order and without repeats next to each other."""
    entered = entries(observed, keys)
    w = Window.partitionBy(*keys).orderBy("frame_id", "lane_id")
    new = entered.withColumn("_last", F.lag("lane_name").over(w)).where("_last is null or _last <> lane_name")
    steps = F.array_sort(F.collect_list(F.struct("frame_id", "lane_id", "lane_name")))
    return new.groupBy(*keys).agg(F.array_join(F.transform(steps, lambda s: s["lane_name"]), " → ").alias("lane_path"))


def summary(observed: DataFrame, lanes: DataFrame, now: float, keys: Sequence[str] = KEYS, window: float = 300.0) -> DataFrame:
    """lane_id, name, pass_count, current_in_lane, queue_count, flow_rate_veh_h of every lane, from one pass over what is observed.

    The figures are those of pass_counts(), occupancy() and flow_rate_at().
    """
    standing = F.col("stationary") if "stationary" in observed.columns else F.lit(False)
    each = observed.groupBy("lane_id", *keys).agg(
        F.bool_or("inside").alias("passed"), F.min(F.when(F.col("inside"), F.col("frame_time"))).alias("first_time"), F.max_by(F.struct("inside", standing.alias("stationary")), "frame_id").alias("r")
    )
    age = F.lit(now) - F.col("first_time")
    counts = each.groupBy("lane_id").agg(
        F.count_if("passed").alias("pass_count"), F.count_if("r.inside").alias("current_in_lane"), F.count_if(F.col("r.inside") & F.col("r.stationary")).alias("queue_count"),
        (F.count_if((age >= 0) & (age < window)) * (3600.0 / window)).alias("flow_rate_veh_h"),
    )
    figures = ("pass_count", "current_in_lane", "queue_count", "flow_rate_veh_h")
    return lanes.select("lane_id", "name").join(counts, "lane_id", "left").select("lane_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in figures))


def next_free_number(lanes: DataFrame) -> DataFrame:
    """The smallest positive lane_id that isn't taken: one after the first id that has no follower, or 1."""
    ids = lanes.select(F.col("lane_id").cast("long").alias("id")).where("id >= 1")
    gaps = ids.select((F.col("id") + 1).alias("id")).unionByName(lanes.sparkSession.range(1).select(F.lit(1).cast("long").alias("id"))).join(ids, "id", "left_anti")
    return gaps.agg(F.min("id").alias("next_number"))


def next_folder(folders: DataFrame) -> DataFrame:
    """The largest number among folder names, and one."""
    return folders.agg((F.coalesce(F.max(F.expr("try_cast(name as long)")), F.lit(0)) + 1).alias("next_number"))
