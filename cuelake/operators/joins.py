"""Joins that Spark has no name for: priority lookups, intervals, as-of and nearest rows.

Interval joins, and as-of joins that are given a width, deal rows out by key and time band, hence a long key is
split over tasks; no pair of rows meets that cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_join(rows: DataFrame, keys: list[Column], lookup: DataFrame, key: str, value: str, name: str = "hit") -> DataFrame:
    """Adds name, the lookup's value for the first of the keys that it has; lookup keys are unique."""
    out = rows
    for n, k in enumerate(keys):
        side = lookup.select(F.col(key).alias(f"_k{n}"), F.col(value).alias(f"_v{n}"))
        out = out.withColumn(f"_p{n}", k).join(side, F.col(f"_p{n}") == F.col(f"_k{n}"), "left")
    found = F.coalesce(*[F.col(f"_v{n}") for n in range(len(keys))])
    which = F.coalesce(*[F.when(F.col(f"_v{n}").isNotNull(), F.lit(n)) for n in range(len(keys))])
    return out.select(*rows.columns, found.alias(name), which.alias(f"{name}_no"))


def _bands(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str = "start", end: str = "end", width: int = 1024) -> DataFrame:
    """Every point with the intervals of its key that hold it, both ends included.

    Rows meet by key and band of time; an interval stands in each band that it touches, so width should be
    near a usual interval's length.
    """
    held = intervals.where(F.col(start) <= F.col(end)).withColumn("_band", _bands(F.col(start), F.col(end), width))
    asked = points.withColumn("_band", F.floor(F.col(point) / width))
    return asked.join(held, [key, "_band"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_band")


def interval_latest(points: DataFrame, intervals: DataFrame, key: str, point: str, id_: str, start: str = "start", end: str = "end", width: int = 1024) -> DataFrame:
    """Of the intervals that hold a point, the one that started last (then the larger id); null if none."""
    found = interval_join(points, intervals, key, point, start, end, width).groupBy(key, point).agg(F.max_by(id_, F.struct(start, id_)).alias(id_))
    return points.join(found, [key, point], "left")


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of half-open ranges (a_start, a_end) and (b_start, b_end) of a key that overlap, with the clipped range.

    A pair is told in the band where the overlap begins, hence once.
    """
    left = a.where("a_start < a_end").withColumn("_band", _bands(F.col("a_start"), F.col("a_end") - 1, width))
    right = b.where("b_start < b_end").withColumn("_band", _bands(F.col("b_start"), F.col("b_end") - 1, width))
    first, last = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    both = left.join(right, [key, "_band"]).where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.floor(first / width) == F.col("_band")))
    return both.withColumn("clip_start", first).withColumn("clip_end", last).drop("_band")


def asof_forward(points: DataFrame, rows: DataFrame, key: str, point: str, start: str, id_: str, width: int | None = None) -> DataFrame:
    """For each point the row that starts next after it, if some row started at or before it; no pairs."""
    return _asof(points, rows, key, point, start, id_, width, F.when(F.col("_back").isNotNull(), F.col("_ahead")))


def asof_backward(points: DataFrame, rows: DataFrame, key: str, point: str, start: str, id_: str, width: int | None = None) -> DataFrame:
    """The row that started last at or before each point."""
    return _asof(points, rows, key, point, start, id_, width, F.col("_back"))


def asof_next(points: DataFrame, rows: DataFrame, key: str, point: str, start: str, id_: str, width: int | None = None) -> DataFrame:
    """The row that starts next after each point, whatever stands before it."""
    return _asof(points, rows, key, point, start, id_, width, F.col("_ahead"))


def _asof(points: DataFrame, rows: DataFrame, key: str, point: str, start: str, id_: str, width: int | None, told: Column) -> DataFrame:
    """width: a long key is split into bands of so much time; each band's first and last row are carried on to
    the bands around it, so that a key is as many tasks as it has bands. Without it a key is one group."""
    # points sort behind the rows of the same time, so that those count as started
    a = points.select(key, F.col(point).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(rows.dtypes)[id_]).alias("_id"))
    b = rows.select(key, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(id_).alias("_id"))
    both = a.unionByName(b).withColumn("_band", F.floor(F.col("_t") / width) if width else F.lit(0).cast("long"))
    order = Window.partitionBy(key, "_band").orderBy("_t", "_side", "_id")
    back = F.last("_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("_id", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumns({"_back": back, "_ahead": ahead})
    if width:
        at = F.when(F.col("_side") == 0, F.struct("_t", "_id"))
        ends = both.groupBy(key, "_band").agg(F.min(at)["_id"].alias("_first"), F.max(at)["_id"].alias("_last"))
        bands = Window.partitionBy(key).orderBy("_band")
        before = F.last("_last", ignorenulls=True).over(bands.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_first", ignorenulls=True).over(bands.rowsBetween(1, Window.unboundedFollowing))
        around = ends.select(F.col(key).alias("_key"), F.col("_band").alias("_b"), before.alias("_before"), after.alias("_after"))
        both = both.where("_side = 1").join(around, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_band") == F.col("_b")))
        both = both.withColumns({"_back": F.coalesce("_back", "_before"), "_ahead": F.coalesce("_ahead", "_after")})
    return both.where("_side = 1").select(key, F.col("_t").alias(point), told.alias(id_))


def next_active(points: DataFrame, rows: DataFrame, key: str, point: str, id_: str, behind: int, start: str = "start", end: str = "end", width: int = 1024) -> DataFrame:
    """Of the rows that start after `point - behind`, the first that has not ended at the point.

    Those that started by then hold the point, so an interval join finds them; else it is the next to start.
    """
    near = rows.select(key, id_, F.col(start).alias("_s"), F.least(F.col(end), F.col(start) + (behind - 1)).alias("_e"))
    now = interval_join(points, near, key, point, "_s", "_e", width).groupBy(key, point).agg(F.min_by(id_, F.struct("_s", id_)).alias("_now"))
    ahead = asof_next(points, rows, key, point, start, id_, 64 * width).withColumnRenamed(id_, "_next")
    return points.join(now, [key, point], "left").join(ahead, [key, point], "left").select(key, point, F.coalesce("_now", "_next").alias(id_))


def nearest_point(points: DataFrame, areas: DataFrame, id_: str, x: str, y: str, block: int = 1000) -> DataFrame:
    """Points (x, y) with the area (id_, _x, _y) that is nearest; ties to the smaller id.

    Areas meet the points in blocks of so many, each block as one list, and the best of all blocks counts.
    """
    listed = areas.select("_x", "_y", F.col(id_).alias("_id"))
    blocks = max(1, -(-listed.count() // block))
    held = listed.groupBy(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct("_x", "_y", "_id")).alias("_areas"))
    distance = lambda a: F.pow(F.col(x) - a["_x"], 2.0) + F.pow(F.col(y) - a["_y"], 2.0)
    best = F.array_min(F.transform("_areas", lambda a: F.struct(distance(a).alias("d"), a["_id"].alias("id"))))
    met = points.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "_block").withColumn("_best", best)
    if blocks == 1:
        return met.select(*points.columns, F.col("_best.id").alias(id_))
    return met.groupBy(*points.columns).agg(F.min("_best")["id"].alias(id_))


def nearest_join(points: DataFrame, rows: DataFrame, key: str, point: str, at: str, id_: str, width: int, tolerance: int) -> DataFrame:
    """The row in the same or a neighbouring bucket that is nearest, within the tolerance; ties to the smaller id."""
    near = points.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(point) / width) + d for d in (-1, 0, 1)])))
    held = rows.withColumn("_bucket", F.floor(F.col(at) / width)).select(key, "_bucket", F.col(at).alias("_at"), F.col(id_).alias("_id"))
    distance = F.abs(F.col(point) - F.col("_at"))
    found = near.join(held, [key, "_bucket"]).where(distance <= tolerance).groupBy(key, point).agg(F.min_by("_id", F.struct(distance, F.col("_id"))).alias(id_))
    return points.join(found, [key, point], "left")
