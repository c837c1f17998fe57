"""Folders that hold items, and items that are bound to other items: deletes, moves and copies that follow both.

folders: (id, parent, ...), items: (id, kind, bin, bound, ...). Other columns are carried along; a column hidden is
shown again in copies. An item is bound to one other item at most, so what hangs on an item is a tree as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.trees import reached


def _ids(df: DataFrame, name: str = "id") -> DataFrame:
    return df.select(F.col("id").alias(name)).where(F.col(name).isNotNull()).distinct()


def _flagged(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """df with flag: whether column is one of the ids."""
    marks = _ids(ids, "_id").withColumn(flag, F.lit(True))
    return df.join(marks, df[column] == marks["_id"], "left").drop("_id").withColumn(flag, F.coalesce(flag, F.lit(False)))


def within(folders: DataFrame, items: DataFrame, folder_ids: DataFrame, item_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of the folders and of the items that a selection holds: folders with all below them, items in these folders
    or selected, and what is bound to any of these items, however far. Unknown folders hold nothing; an unknown item holds
    what is bound to it."""
    inside = reached(folders.select("id", "parent"), folder_ids.join(_ids(folders), "id", "left_semi"))
    held = items.join(_ids(inside, "bin"), "bin", "left_semi").select("id")
    return inside, reached(items.select("id", F.col("bound").alias("parent")), held.unionByName(item_ids.select("id")))


def delete_entries(folders: DataFrame, items: DataFrame, folder_ids: DataFrame, item_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: the folders and items that are left when a selection goes with all that it holds (see within)."""
    gone_folders, gone_items = within(folders, items, folder_ids, item_ids)
    return folders.join(_ids(gone_folders), "id", "left_anti").select(*folders.columns), items.join(_ids(gone_items), "id", "left_anti").select(*items.columns)


def referenced(projects: DataFrame, items: DataFrame, project: str, source: str) -> DataFrame:
    """M9: the projects that an item has as its id or its source; the others go with the last of these."""
    used = items.select(F.explode(F.array("id", source)).alias(project)).where(F.col(project).isNotNull()).distinct()
    return projects.join(used, project, "left_semi")


def move_entries(folders: DataFrame, items: DataFrame, folder_ids: DataFrame, item_ids: DataFrame, target: str | None) -> tuple[DataFrame, DataFrame]:
    """Folders and items after a selection moved to the target folder, or to the top for None.

    Of the selected folders the topmost move, with all in them. An unknown target, or one inside a folder that would
    move, changes nothing. What is bound to a moved item comes along; a moved item that is no video and whose own
    partner stays behind is unbound.
    """
    asked = folder_ids.select("id").join(_ids(folders), "id", "left_semi").distinct()
    inside = reached(folders.select("id", "parent"), asked)
    if target is not None and (folders.where(F.col("id") == target).isEmpty() or not inside.where(F.col("id") == target).isEmpty()):
        return folders, items
    to = F.lit(target).cast(dict(folders.dtypes)["parent"])
    marked = _flagged(_flagged(folders, "id", asked, "_asked"), "parent", inside, "_inner")
    new_parent = F.when(F.col("_asked") & ~F.col("_inner"), to).otherwise(F.col("parent"))
    moved_folders = marked.withColumn("parent", new_parent).select(*folders.columns)

    led = _flagged(_flagged(items, "id", item_ids, "_moved"), "bound", item_ids, "_leads")
    placed = led.withColumn("_here", F.col("_moved") | F.col("_leads"))
    together = _flagged(placed, "bound", placed.where("_here").select("id"), "_together")
    unbinds = F.col("_moved") & ~F.coalesce(F.col("kind") == "video", F.lit(False)) & F.col("bound").isNotNull() & ~F.col("_together") & ~F.col("_leads")
    bin_ = F.when(F.col("_here"), F.lit(target).cast(dict(items.dtypes)["bin"])).otherwise(F.col("bin"))
    moved_items = together.select("*", bin_.alias("_bin"), F.when(~unbinds, F.col("bound")).alias("_bound"))
    names = {"bin": "_bin", "bound": "_bound"}
    return moved_folders, moved_items.select(*[F.col(names.get(c, c)).alias(c) for c in items.columns])


def copy_entries(folders: DataFrame, items: DataFrame, folder_ids: DataFrame, item_ids: DataFrame, mark: str, target: str | None = None, in_place: bool = False) -> tuple[DataFrame, DataFrame]:
    """Copies of a selection with all that it holds (see within), under ids made of the mark and the old ones.

    Parents, bins and partners that were copied too become their copies. Others become the target folder and no partner,
    or stay as they are with in_place. root: whether neither the copy's folder nor its partner is a copy.
    """
    in_folders, in_items = within(folders, items, folder_ids, item_ids)
    to = F.lit(target).cast("string")

    def new(c: str) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(mark), F.col(c)), 256)

    def mapped(c: str, copied: str, other: Column) -> Column:
        return F.when(F.col(copied), new(c)).otherwise(F.col(c) if in_place else other)

    def shown(df: DataFrame) -> DataFrame:
        return df.withColumn("hidden", F.lit(False)) if "hidden" in df.columns else df

    own = _flagged(folders.join(_ids(in_folders), "id", "left_semi"), "parent", in_folders, "_copied")
    out = own.withColumn("root", ~F.col("_copied")).withColumn("parent", mapped("parent", "_copied", to)).withColumn("id", new("id"))
    held = _flagged(_flagged(items.join(_ids(in_items), "id", "left_semi"), "bin", in_folders, "_copied"), "bound", in_items, "_partner")
    made = held.withColumn("root", ~F.col("_copied") & ~F.col("_partner")).withColumn("bin", mapped("bin", "_copied", to))
    made = made.withColumn("bound", mapped("bound", "_partner", F.lit(None).cast("string"))).withColumn("id", new("id"))
    return shown(out).select(*folders.columns, "root"), shown(made).select(*items.columns, "root")
