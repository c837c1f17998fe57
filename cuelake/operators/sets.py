"""Order-keeping set operations over rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """Of the rows with equal keys the first one. Rows are reduced to one a key before the shuffle."""
    held = rows.select(key.alias("_key"), order.alias("_order"), F.struct(*rows.columns).alias("_row"))
    return held.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def union_distinct(a: Column, b: Column) -> Column:
    """H1: the members of a and then the new ones of b."""
    return F.array_distinct(F.concat(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    """H3: what stands in one of the two only."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def same_set(a: Column, b: Column) -> Column:
    """H4."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def reconcile(old: Column, shared: Column, text: Column, kept: Column) -> Column:
    """H6: old without what was shared and is no longer in text, plus what text has and kept has not."""
    return F.array_distinct(F.concat(F.array_except(old, F.array_except(shared, text)), F.array_except(text, kept)))


def symmetric_difference_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """H3 over rows: one shuffle, no self join."""
    both = a.select(*a.columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*b.columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a <> _b").drop("_a", "_b")


def append_rows(first: DataFrame, second: DataFrame, position: str) -> DataFrame:
    """H8: the second after the first; its positions go on where those of the first end."""
    last = first.agg(F.coalesce(F.max(position) + 1, F.lit(0)).alias("_last"))
    moved = second.crossJoin(F.broadcast(last)).withColumn(position, F.col(position) + F.col("_last")).drop("_last")  # one row
    return first.unionByName(moved)


def latest_flags(tokens: DataFrame, group: list[str], label: str, position: str, flag: str) -> DataFrame:
    """H9: of tokens with the same label in a group, the flag of the last."""
    return tokens.groupBy(*group, label).agg(F.max_by(flag, position).alias(flag))


def window_rank(rows: DataFrame, by: list[str], order: list, name: str = "k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
