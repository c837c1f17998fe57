"""Ranks over whole tables without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.session import cut


def competition_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """ascending rank over the whole table, equal values share the lowest place.

    Only the counts of the distinct values are put in order, in ranges; their running sums are made within
    each range and offset by the sums of the ranges before, of which there are as many as partitions.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    # read twice, and a second sample could draw other bounds
    dealt = cut(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    sums = dealt.groupBy("_range").agg(F.sum("_n").alias("_total"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.join(F.broadcast(offsets), "_range")  # a row a partition
    return rows.join(placed.select(value, (F.col("_before") + F.col("_offset") + 1).alias(name)), value)


def positions(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows with their places, from 0 on, in the order of the columns, which should leave no ties.

    Rows are dealt into ranges and numbered within each; a range starts where the ranges before it end.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_range")  # a row a partition
    return placed.select(*rows.columns, (F.col("_place") + F.col("_offset")).cast("long").alias(name))
