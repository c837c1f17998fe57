"""Writers: one output a clip, merged outputs, snapshots of a state, blobs by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.session import cut
from cuelake.sources import commits


def write_clips(clips: DataFrame, rows: DataFrame, folder: str) -> DataFrame:
    """B1: writes the rows of each clip to its own part of the folder, as one version of it, and tells how that went.

    clips: (clip, ord, expected); rows: (clip, ...). The status has (ord, clip, status, n, error) in the clips' order:
    'failed' with 'no rows' or 'rows missing', else 'completed'. Rows of unknown clips are not written.
    """
    known = rows.join(clips.select("clip").distinct(), "clip", "left_semi")
    commits.commit(known.repartition("clip"), folder, by=["clip"])
    written = commits.read(rows.sparkSession, folder).groupBy(F.col("clip")).agg(F.count("*").alias("n"))
    out = clips.join(written, "clip", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    error = F.when(F.col("n") == 0, "no rows").when(F.col("n") < F.col("expected"), "rows missing")
    return out.withColumn("error", error).select("ord", "clip", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "n", "error")


def running_offsets(rows: DataFrame, by: str, order: list[str], size: str, name: str) -> DataFrame:
    """rows with name: the sum of size over the rows of the same `by` that stand before, in the order.

    Rows are dealt out by ranges of (by, order), so a `by` with very many rows takes several tasks; each carries on from the
    sums of the ranges before. A null size counts as 0; equal places in the order fall into one range but need not keep
    their order. The ranges are written to the checkpoint folder, as a second reading might draw them elsewhere.
    """
    range_col, sum_col = f"_range_{name}", f"_sum_{name}"
    dealt = cut(rows.repartitionByRange(by, *order).withColumn(range_col, F.spark_partition_id()))
    amount = F.coalesce(F.col(size), F.lit(0))
    sums = dealt.groupBy(by, range_col).agg(F.sum(amount).alias(sum_col))
    before = Window.partitionBy(by).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(by).alias("_by"), F.col(range_col).alias("_range"), F.coalesce(F.sum(sum_col).over(before), F.lit(0)).alias("_carried"))
    inner = Window.partitionBy(by, range_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn(sum_col, F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    joined = own.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col(range_col) == F.col("_range")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(sum_col) + F.col("_carried")).cast("long").alias(name))


def merged_manifest(clips: DataFrame, by: str) -> DataFrame:
    """B2: (by, total_us, clip, ord, offset_us): where each clip stands in the merged output of its target."""
    placed = running_offsets(clips, by, ["ord", "clip"], "duration_us", "offset_us")
    totals = clips.groupBy(F.col(by).alias("_by")).agg(F.sum("duration_us").alias("total_us"))
    return placed.join(totals, F.col(by).eqNullSafe(F.col("_by"))).select(by, "total_us", "clip", "ord", "offset_us")


def write_merged(clips: DataFrame, rows: DataFrame, by: str, folder: str) -> int:
    """B2: writes the rows of all clips of a target one clip after the other; the version's number.

    clips: (by, clip, ord, duration_us); rows: (clip, at_us, ...), at_us being the time within the clip. The version's
    rows have by, at_us moved to the time in the merged output, and the other columns, in that order in files whose
    names sort like their contents; a large target has several. Rows of unknown clips are not written.
    """
    placed = running_offsets(clips, by, ["ord", "clip"], "duration_us", "_offset").select(by, F.col("clip").alias("_clip"), "ord", "_offset")
    held = rows.join(placed, F.col("clip") == F.col("_clip"))
    others = [c for c in rows.columns if c not in ("at_us", by)]
    moved = held.withColumn("at_us", (F.col("at_us") + F.col("_offset")).cast("long")).select(by, "at_us", *others)
    return commits.commit(moved.repartitionByRange(by, "at_us", "clip").sortWithinPartitions(by, "at_us", "clip"), folder, order=[by, "at_us", "clip"])


def read_merged(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """The rows of a merged output with place: their number within the target as the files hold them, from 0."""
    rows = commits.read(spark, folder)
    told = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    parts = told.groupBy(by, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col("_file").alias("_in"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = told.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_file") == F.col("_in")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long").alias("place"))


def write_snapshot(state: DataFrame, folder: str) -> DataFrame:
    """A new version of the folder when all of state is written, and reads it back.

    Readers see the old state or the new one; state may be made from what the folder holds.
    """
    return commits.read(state.sparkSession, folder, commits.commit(state, folder))


def with_digest(blobs: DataFrame, key: Column) -> DataFrame:
    """Blobs (content) as they are cached: by the hash of their key, with a digest of key and content."""
    name = F.sha2(key.cast("string"), 256)
    return blobs.withColumn("cache_key", name).withColumn("digest", F.sha2(F.concat(name.cast("binary"), F.col("content")), 256))


def readable(cache: DataFrame) -> DataFrame:
    """The cached blobs whose digest still fits; of a key written twice one of the equal rows."""
    fits = cache.where(F.col("digest") == F.sha2(F.concat(F.col("cache_key").cast("binary"), F.col("content")), 256))
    return fits.dropDuplicates(["cache_key"])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    import uuid

    from cuelake.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
