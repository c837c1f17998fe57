"""Edits of bound items: rename, hide, take offline, relink, bind, unbind and take apart, each for many items at once.

items: (id, kind, bin, bound, ...) with the columns that an edit names; others are carried along. Each edit returns the
items with a flag `changed`. Ids that are unknown or null change nothing; of several values for one id the greatest
counts; repeated items are edited alike; empty tables give an empty result. An
input column named changed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the name of a stream that has neither a title nor a file
UNTITLED = "字幕流 "


def _no(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def _asked(items: DataFrame, wanted: DataFrame, *values: str) -> DataFrame:
    """items with _asked, and as _told the struct of values that wanted (id, *values) gives for an id."""
    told = F.max(F.struct(*[F.col(v) for v in values])) if values else F.lit(None)
    one = wanted.where("id is not null").groupBy("id").agg(told.alias("_told"), F.lit(True).alias("_hit"))
    return items.join(one, "id", "left").withColumn("_asked", _no("_hit"))


def _edited(rows: DataFrame, items: DataFrame, hit: Column, new: dict[str, Column]) -> DataFrame:
    """The items' own columns, those in new replaced where hit, and whether any of these differs."""
    marked = rows.select("*", F.coalesce(hit, F.lit(False)).alias("_edit"), *[v.alias(f"_new_{c}") for c, v in new.items()])
    differs = F.lit(False)
    for c in new:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    kept = [F.when(F.col("_edit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in items.columns if c != "changed"]
    return marked.select(*kept, (F.col("_edit") & differs).alias("changed"))


def rename(items: DataFrame, names: DataFrame) -> DataFrame:
    """Items (id, name, ...) under the names of names (id, name); a null name renames nothing."""
    rows = _asked(items, names.where("name is not null"), "name")
    return _edited(rows, items, F.col("_asked"), {"name": F.col("_told.name")})


def set_flag(items: DataFrame, chosen: DataFrame, flag: str, value: bool) -> DataFrame:
    """Items with the flag (hidden or offline) of the chosen ids switched; null counts as off. Nothing follows."""
    rows = _asked(items, chosen)
    # a null that stays off isn't touched
    return _edited(rows, items, F.col("_asked") & (_no(flag) != F.lit(value)), {flag: F.lit(value)})


def relink(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items (id, path, offline, ...) at the paths of links (id, path, probed, ...), and online again.

    Where probed is true, the new file was read: the columns that links shares with items describe it and replace the
    old ones, nulls too. Else only path and offline change.
    """
    shared = [c for c in links.columns if c in items.columns and c not in ("id", "path", "offline")]
    rows = _asked(items, links.where("path is not null"), "path", "probed", *shared)
    new = {c: F.when(_no("_told.probed"), F.col(f"_told.{c}")).otherwise(F.col(c)) for c in shared}
    return _edited(rows, items, F.col("_asked"), {"path": F.col("_told.path"), "offline": F.lit(False), **new})


def bind(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items bound to the videos of pairs (id, video) and put into these videos' folders.

    Videos are not bound. An item bound to what is no known video is in no folder.
    """
    videos = items.where("kind = 'video'").groupBy(F.col("id").alias("video")).agg(F.max("bin").alias("_bin"))
    rows = _asked(items, pairs.where("video is not null").join(videos, "video", "left"), "video", "_bin")
    other = ~F.coalesce(F.col("kind") == "video", F.lit(False))
    return _edited(rows, items, F.col("_asked") & other, {"bin": F.col("_told._bin"), "bound": F.col("_told.video")})


def unbind(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen items that are no video, bound to nothing; their folders stay."""
    rows = _asked(items, chosen)
    other = ~F.coalesce(F.col("kind") == "video", F.lit(False))
    return _edited(rows, items, F.col("_asked") & other, {"bound": F.lit(None).cast(dict(items.dtypes)["bound"])})


def demux(items: DataFrame, streams: DataFrame) -> DataFrame:
    """Items and, for each of streams (video, kind, stream, track, title, path) of a known video, an item bound to it.

    Ids are made of kind, video and stream (of a subtitle its track), so taking a video apart again adds nothing. New
    items are enabled, shown, online and in the video's folder; a subtitle without a title is named after its file, else
    by its number. changed marks the new ones; columns that a stream doesn't have are null.
    """
    number = F.when(F.col("kind") == "audio", F.col("stream").cast("string")).otherwise(F.col("track").cast("string"))
    id_ = F.concat(F.lit("demux-"), "kind", F.lit(":"), "video", F.lit(":"), number)
    blank = lambda c: F.nullif(c, F.lit(""))
    file = blank(F.regexp_extract(F.col("path"), r"[^/\\]*$", 0))
    name = F.coalesce(blank(F.col("title")), file, F.concat(F.lit(UNTITLED), F.col("stream").cast("string")), F.lit(""))
    asked = streams.where("kind in ('audio', 'subtitle')").select("video", "kind", id_.alias("id"), F.when(F.col("kind") == "audio", F.coalesce("title", F.lit(""))).otherwise(name).alias("name"))
    asked = asked.where("id is not null").groupBy("id", "video", "kind").agg(F.max("name").alias("name"))
    videos = items.where("kind = 'video'").groupBy(F.col("id").alias("video")).agg(F.max("bin").alias("bin"))
    made = asked.join(videos, "video").join(items.select("id"), "id", "left_anti").withColumnRenamed("video", "bound")
    made = made.withColumns({"enabled": F.lit(True), "hidden": F.lit(False), "offline": F.lit(False), "path": F.lit("")})
    new = made.select(*[F.col(c).cast(t).alias(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in items.dtypes])
    return items.withColumn("changed", F.lit(False)).unionByName(new.withColumn("changed", F.lit(True)))
