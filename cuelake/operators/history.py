"""Changes between snapshots, and states rebuilt from change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """P5: (key, change_type, old, new) with insert, delete and update; unchanged rows are left out."""
    columns = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*columns).alias("old"))
    b = after.select(key, F.struct(*columns).alias("new"))
    both = a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(key, kind.alias("change_type"), "old", "new")


def apply(state: DataFrame, changes: DataFrame, key: str, back: bool = False) -> DataFrame:
    """The state after the changes of diff (or before them)."""
    side = "old" if back else "new"
    kept = state.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(F.col(side).isNotNull()).select(key, f"{side}.*").select(*state.columns))


def as_of(log: DataFrame, key: str, version: str, at: int) -> DataFrame:
    """Of each key the latest entry up to a version, deletions left out; log has an op column."""
    columns = [c for c in log.columns if c != key]
    last = log.where(F.col(version) <= at).groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("_last"))
    return last.select(key, "_last.*").where("op <> 'delete'")


def upsert(state: DataFrame, news: DataFrame, key: str, keep: DataFrame | None = None) -> DataFrame:
    """New rows replace old ones by key; with keep, only its keys stay."""
    out = state.join(news.select(key), key, "left_anti").unionByName(news)
    return out if keep is None else out.join(keep.select(key), key, "left_semi")


def capped(log: DataFrame, by: str, order: str, most: int = 39) -> DataFrame:
    """The latest entries of each log; the newest of the evicted ones gives its base label."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    rows = log.withColumn("_k", rank).where(F.col("_k") <= most + 1)
    return rows.withColumn("role", F.when(F.col("_k") > most, "base").otherwise("entry")).drop("_k")


def grouped_tip(log: DataFrame, by: str, order: str, group: str) -> DataFrame:
    """Neighbouring entries of one group become one entry, with the first and last order and their number."""
    sequence = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(group).over(sequence).eqNullSafe(F.col(group)) & F.col(group).isNotNull(), 0).otherwise(1)
    numbered = log.withColumn("_new", new).withColumn("entry", F.sum("_new").over(sequence.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "entry", group).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def stack_view(rows: DataFrame, stack: str, order: str, start: str, end: str) -> DataFrame:
    """One row for each stack, from its first member's start to its last one's end."""
    return rows.groupBy(stack).agg(F.min(order).alias("first"), F.min_by(start, order).alias(start), F.max_by(end, order).alias(end), F.count("*").alias("n"))
