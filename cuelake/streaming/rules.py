"""Stream operators: rate limits, throttles, change filters and windows, over batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from cuelake.functions.mathx import stall_seconds
from cuelake.functions.timecode import progress_us


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null included."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _runs(*columns: pa.Array) -> list[tuple[int, int]]:
    """Runs [i, j) of rows that are equal in all columns."""
    changed = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        codes = _codes(column)
        changed |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(columns[0])]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _windows(limit: int):
    """For mapInArrow over (key, stretch, micros), sorted: (key, start of the window, further events in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, opened, more, kind = None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, times, out = batch.column(0).type, batch.column(2).to_numpy(), []
            for i, j in _runs(batch.column(0), batch.column(1)):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != of:
                    if opened is not None:
                        out.append((of[0], opened, more))
                    of, opened, more, i = key, int(times[i]), 0, i + 1
                while i < j:
                    end = i + int(np.searchsorted(times[i:j], opened + limit))
                    more += end - i
                    if end == j:
                        break
                    out.append((key[0], opened, more))
                    i, opened, more = end + 1, int(times[end]), 0
            yield told(out, kind)
        if opened is not None:
            yield told([(of[0], opened, more)], kind)

    def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["_key", "_opened", "suppressed"])

    return run


def rate_limited(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """O3 over a table: (key, window_no, first_ts, suppressed): a window starts with an event outside the last one.

    After a gap of the limit a window always opens, so each key is cut into stretches there; gaps show in the first
    and last events of frames as long as the limit. A stretch is read in order and only its open window is held.
    """
    limit = seconds * 1_000_000
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("_key"), F.unix_micros(F.col(time)).alias("_t")).where("_t is not null").withColumn("_frame", F.col("_t") - F.pmod("_t", F.lit(max(1, limit))))
    frames = rows.groupBy("_key", "_frame").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    order = Window.partitionBy("_key").orderBy("_frame")
    gap = (F.col("_from") - F.lag("_to").over(order) >= limit).cast("long")
    stretches = frames.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("_stretch", F.sum("_gap").over(order)).select(F.col("_key").alias("_k"), F.col("_frame").alias("_f"), "_stretch")
    placed = rows.join(stretches, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_frame") == F.col("_f"))).select("_key", "_stretch", "_t")
    dealt = placed.repartition("_key", "_stretch").sortWithinPartitions("_key", "_stretch", "_t")
    out = dealt.mapInArrow(_windows(limit), f"_key {kind}, _opened long, suppressed long")
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_opened")) - 1
    return out.select(F.col("_key").alias(key), number.cast("long").alias("window_no"), F.timestamp_micros("_opened").alias("first_ts"), "suppressed")


def rate_limited_stream(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """O3 over a stream: (key, first_ts): the events that are let through. State: the open window's start."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        passed = []
        for t in sorted(x for b in batches for x in b[time].astype("int64") // 1000):
            if opened is None or t >= opened + seconds * 1_000_000:
                opened = int(t)
                passed.append(opened)
        if opened is not None:
            state.update((opened,))
        yield pd.DataFrame({key: [k[0]] * len(passed), "first_ts": pd.to_datetime(passed, unit="us")})

    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col(time).cast("timestamp_ntz").alias(time))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_ts timestamp_ntz", "opened long", "append", GroupStateTimeout.NoTimeout)


def _risen(least: float, apart: float = 0):
    """For mapInArrow over (key, order, value), sorted: the rows that are told; only the last told row is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of, last, place = False, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, kept = batch.column(2).to_pylist(), []
            places = batch.column(1).to_pylist() if apart else None
            for i, j in _runs(batch.column(0)):
                key = batch.column(0)[i].as_py()
                if not begun or key != of:
                    begun, of, last, place = True, key, values[i], places and places[i]
                    kept.append(i)
                    i += 1
                for k in range(i, j):
                    v = values[k]
                    if v is not None and last is not None and (v != v or float(v) >= float(last) + least) and (not apart or places[k] - place >= apart):
                        kept.append(k)
                        last, place = v, places and places[k]
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def throttled(rows: DataFrame, key: str, order: str, value: str, least: float, apart: float = 0) -> DataFrame:
    """Of a rising value the rows that are at least so much above the last one told, and at least so
    many places of the order after it."""
    held = rows.select(key, order, value)
    dealt = held.repartition(key).sortWithinPartitions(key, order, value)
    return dealt.mapInArrow(_risen(least, apart), held.schema)


def folded(rows: DataFrame, key: str, order: str, columns: list[str], init: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """(key, schema): what finish makes of a state that step carries through a key's rows in order.

    Rows are read as a sorted stream and only one state is held, so a key may be as long as it likes; equal
    places in the order are taken by the columns' values. Null keys are one key.
    """
    held = rows.select(key, order, *columns)
    kind = held.schema[key].dataType
    fields = StructType([StructField(key, kind), *_parse(schema)])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of, state = False, None, None

        def told() -> pa.RecordBatch:
            found = [(of, *row) for row in finish(state)]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], f.type) for n, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            values = [batch.column(n).to_pylist() for n in range(2, batch.num_columns)]
            for i, j in _runs(batch.column(0)) if batch.num_rows else []:
                own = batch.column(0)[i].as_py()
                if not begun or own != of:
                    if begun:
                        yield told()
                    begun, of, state = True, own, init()
                for k in range(i, j):
                    step(state, tuple(v[k] for v in values))
        if begun:
            yield told()

    return held.repartition(key).sortWithinPartitions(key, order, *columns).mapInArrow(run, fields)


def snapshots(saves: DataFrame, folder: str, order: str, project: str, digest: str, most: int) -> DataFrame:
    """(folder, place, project, digest): the snapshots left in each folder after all saves, newest first.

    A save is skipped if its project's newest snapshot has the same digest; else it is written, or written
    again under its name, and of all snapshots in the folder the newest `most` stay.
    """

    def step(state: list, row: tuple) -> None:
        newest = next((s for s in state if s[0] == row[0]), None)
        if newest != row:
            state[:] = [row, *(s for s in state if s != row)][: max(1, most)]

    kinds = dict(saves.dtypes)
    out = f"place long, {project} {kinds[project]}, {digest} {kinds[digest]}"
    return folded(saves, folder, order, [project, digest], list, step, lambda state: [(n, *s) for n, s in enumerate(state)], out)


def progress(lines: DataFrame, job: str, order: str, time: str, line: str, duration: str, least: float = 0.001) -> DataFrame:
    """O1: (job, order, kind, progress): what a tool's output lines tell, until it ends or stalls.

    Of the rising share of the duration (us) that is done, the values at least so much above the last one told;
    'end' for a closing line; 'stalled' for the first line that comes a bound after the last rise (twice the
    duration's seconds and 8, within 20 to 60 s; 180 s once all but the last 100 ms is done), where a job ends.
    """
    of = Window.partitionBy(job).orderBy(order)
    so_far = of.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(job, order, F.unix_micros(time).alias("_t"), F.greatest(duration, F.lit(1).cast("long")).alias("_d"), F.col(line).alias("_l"))
    rows = rows.withColumn("_us", F.greatest(F.coalesce(progress_us(F.col("_l")), F.lit(0).cast("long")), F.lit(0).cast("long")))
    rows = rows.withColumn("_top", F.max("_us").over(so_far)).withColumn("_before", F.coalesce(F.max("_us").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    rose = F.when(F.col("_top") > F.col("_before"), F.col("_t"))
    last = F.coalesce(F.last(rose, ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.first("_t").over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bound = F.when(F.col("_before") >= F.col("_d") - 100_000, 180).otherwise(stall_seconds(F.col("_d"))) * 1_000_000
    rows = rows.withColumn("_last", last).withColumn("_over", (F.col("_t") - F.col("_last") >= bound).cast("int")).withColumn("_ends", (F.col("_l") == "progress=end").cast("int"))
    closed = F.coalesce(F.sum(F.col("_over") + F.col("_ends")).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_closed", closed).where("_closed = 0").withColumn("progress", F.least(F.col("_top") / F.col("_d"), F.lit(1.0)))
    told = throttled(rows.where("_over = 0 and _ends = 0").select(job, order, "progress"), job, order, "progress", least).withColumn("kind", F.lit("progress"))
    shut = rows.where("_over + _ends > 0").select(job, order, "progress", F.when(F.col("_over") == 1, "stalled").otherwise("end").alias("kind"))
    return told.unionByName(shut).select(job, order, "kind", "progress")


def retried(attempts: DataFrame, item: str, attempt: str, good: str, rounds: int = 3) -> DataFrame:
    """(item, attempts, done, cpu_only): tries up to the first good one, of at most so many rounds.

    Later rounds take only what has failed so far and leave out special hardware.
    """
    rows = attempts.where(F.col(attempt).between(1, rounds))
    first = F.min(F.when(F.col(good), F.col(attempt)))
    out = rows.groupBy(item).agg(first.alias("_first"), F.max(attempt).alias("_last"))
    used = F.coalesce("_first", "_last")
    return out.select(item, used.cast("long").alias("attempts"), F.col("_first").isNotNull().alias("done"), (used > 1).alias("cpu_only"))


# fixed values: the states of an exported item, and those that end it
QUEUE_ENDS = ("completed", "failed", "cancelled")


def queue_status(log: DataFrame, item: str, order: str, status: str) -> DataFrame:
    """(item, status, started, ended, late): each item's first ending state, else its latest state.

    started and ended are places in the log; late counts what is reported after the end, which changes nothing.
    """
    ends = F.col(status).isin(*QUEUE_ENDS)
    place = F.when(ends, F.col(order))
    first = log.groupBy(item).agg(F.min(place).alias("ended"), F.min(F.when(F.col(status) == "running", F.col(order))).alias("started"), F.min_by(status, place).alias("_end"), F.max_by(status, order).alias("_last"))
    after = log.join(first.select(item, "ended"), item).where(F.col(order) > F.col("ended")).groupBy(item).agg(F.count("*").alias("late"))
    out = first.join(after, item, "left")
    return out.select(item, F.coalesce("_end", "_last").alias(status), "started", "ended", F.coalesce("late", F.lit(0).cast("long")).alias("late"))


def windowed_counts(events: DataFrame, key: str, time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """O12 over a table or a stream: (key, start, n) by tumbling windows, or by windows that start every slide; a stream
    drops what is later than `late` behind the newest event that it has seen, and tells a window when that has passed its
    end. Events without a time are in no window."""
    counted = events.withWatermark(time, late).groupBy(key, F.window(time, width, slide).alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("_w.start").alias("start"), "n")


def running_max(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """O2: progress that never falls."""
    return rows.withColumn("progress", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def changes_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_same", before.eqNullSafe(F.col(value)) & (F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)).where("not _same").drop("_same")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(key, "_l.*")
