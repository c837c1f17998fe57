"""Stream operators that act when time passes, not only when a row comes: state and timers for each key.

Timers run on event time, where the watermark moves them, or on the clock. State is one small value a key; it stands in
the RocksDB store that Spark checkpoints, so a stream that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.functions.mathx import stall_seconds
from cuelake.functions.timecode import progress_us

STORE = "spark.sql.streaming.stateStore.providerClass"


def keep_state(spark: SparkSession) -> None:
    """Choose the state store that timers need; set before a stream starts."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One value state and one timer a key; times are microseconds. Input columns are called in_..., as rows come as
    named tuples, which lose names that begin with a line."""

    def __init__(self, key: str, clock: bool, state: str):
        self.key, self.clock, self.schema = key, clock, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.schema)

    def wake_at(self, micros: int | None) -> None:
        """One timer at a time, or none; it never fires before its microsecond."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))

    def now(self, timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs() * 1000

    def frame(self, key: tuple, rows: list[tuple], names: list[str]) -> pd.DataFrame:
        # plain objects, as pandas' own strings reach Arrow in pieces, which Spark doesn't take
        columns = zip([self.key, *names], [[key[0]] * len(rows), *([r[n] for r in rows] for n in range(len(names)))], strict=True)
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns})

    def close(self) -> None:
        pass


class _RateLimit(_Timed):
    names = ["kind", "at", "suppressed"]

    def __init__(self, key: str, clock: bool, limit: int):
        super().__init__(key, clock, "opened long, suppressed long")
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([r["in_t"].to_numpy() for r in rows]))
        if self.clock:
            times[:] = self.now(timerValues)
        opened, more = self.state.get() if self.state.exists() else (None, 0)
        out, i = [], 0
        while i < len(times):
            if opened is not None:
                end = i + int(np.searchsorted(times[i:], opened + self.limit))
                more, i = more + end - i, end
                if i == len(times):
                    break
                if more:
                    out.append(("flush", opened + self.limit, more))
            opened, more, i = int(times[i]), 0, i + 1
            out.append(("first", opened, 0))
        self.state.update((opened, more))
        self.wake_at(opened + self.limit)
        yield self.frame(key, out, self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, more = self.state.get()
        self.state.clear()
        yield self.frame(key, [("flush", opened + self.limit, more)] if more else [], self.names)


def rate_limited_flushes(events: DataFrame, key: str, time: str, seconds: int, late: str = "0 seconds", clock: bool = False) -> DataFrame:
    """O3: (key, kind, at, suppressed): 'first' for an event outside the last window, which opens one, and 'flush' with
    the number of further events once a window with some is over, whether or not another event comes.

    A stream's windows end as the watermark (newest event time less `late`) passes; with clock=True events count as they
    arrive and windows end by the clock. Null keys are one key, rows without a time are left out. Of a batch's key only the
    times are held.
    """
    keep_state(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(time).isNotNull()).select(F.col(key), F.col(time).cast("timestamp").alias("in_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("in_t"))
    rows = rows if clock else rows.withWatermark("in_time", late)
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_RateLimit(key, clock, seconds * 1_000_000),
        outputStructType=f"`{key}` {kind}, kind string, at long, suppressed long",
        outputMode="append",
        timeMode="processingTime" if clock else "eventTime",
    )
    return out.select(key, "kind", F.timestamp_micros("at").alias("at"), "suppressed")


#: Jobs share a state by the hash of their key: one call a group and batch, however many jobs there are.
GROUPS = 4096


def _watchdog(clock: bool, least: float):
    """The lines of a group of jobs, and the group's state of one small tuple a job: (job, top, told, rose, bound, final, duration, closed)."""

    def due(held: list) -> int:
        _, top, _, rose, bound, final, duration, _ = held
        return rose + (final if top >= duration - 100_000 else bound)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {j[0]: list(j) for j in (state.get[0] if state.exists else [])}
        now = state.getCurrentProcessingTimeMs() if clock else state.getCurrentWatermarkMs()
        parts, out = [] if state.hasTimedOut else list(batches), []
        if parts:
            lines = pd.concat(parts).sort_values(["in_t", "in_blank", "in_order"], kind="stable")
            names = ["in_job", "in_blank", "in_order", "in_t", "in_us", "in_ends", "in_bound", "in_final", "in_d"]
            for job, blank, order, t, us, ends, bound, final, duration in zip(*(lines[n].tolist() for n in names), strict=True):
                # the group of null holds nothing else
                job, order, t = None if key[0] < 0 else job, None if blank else order, now * 1000 if clock else t
                held = jobs.get(job)
                if held is None:
                    held = jobs[job] = [job, 0, -1.0, t, bound, final, duration, False]
                elif held[7]:
                    continue
                length = held[6]
                if t >= due(held):
                    out.append((job, order, "stalled", min(max(held[1], us) / length, 1.0)))
                    held[7] = True
                    continue
                if us > held[1]:
                    held[1], held[3] = us, t
                share = min(held[1] / length, 1.0)
                if ends:
                    out.append((job, order, "end", share))
                    held[7] = True
                elif held[2] < 0 or share >= held[2] + least:
                    out.append((job, order, "progress", share))
                    held[2] = share
        first = None
        for held in jobs.values():
            if not held[7]:
                # a bound never passes before its microsecond
                at = -(-due(held) // 1000)
                if at <= now:
                    out.append((held[0], None, "stalled", min(held[1] / held[6], 1.0)))
                    held[7] = True
                else:
                    first = at if first is None else min(first, at)
        state.update(([tuple(j) for j in jobs.values()],))
        if first is not None and clock:
            state.setTimeoutDuration(first - now)
        elif first is not None:
            # it fires once the watermark is beyond, not at, its time
            state.setTimeoutTimestamp(max(first - 1, 1))
        # plain objects, as pandas' own strings reach Arrow in pieces, which Spark doesn't take
        yield pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object) for k, n in enumerate(("in_job", "order", "kind", "progress"))})

    return step


def watched_progress(lines: DataFrame, job: str, order: str, time: str, line: str, duration: str, least: float = 0.001, late: str = "0 seconds", clock: bool = False, stall: Column | None = None, final: Column | None = None) -> DataFrame:
    """O1: (job, order, kind, progress): a tool's output lines as progress, and a job that falls silent as stalled.

    As progress of rules over a table, but 'stalled' comes when the bound has passed since the last rise, without a
    further line (its order is null then) or with a late one. What follows 'end' or 'stalled' is ignored. The bound passes by the
    watermark (newest event time less `late`), or by the clock with clock=True. stall, final: bounds in seconds other
    than the rule's. Rows without a time are left out; a null duration counts as a microsecond. A group of jobs is handled
    in one call, which holds the group's lines of a batch and a tuple a job; a group wakes at its earliest bound.
    """
    keep_state(lines.sparkSession)
    kinds = dict(lines.dtypes)
    length = F.greatest(F.coalesce(duration, F.lit(1).cast("long")), F.lit(1).cast("long"))
    micros = lambda c: (c * 1_000_000).cast("long")
    number = F.col(order).cast("long")
    rows = lines.where(F.col(time).isNotNull()).select(
        F.when(F.col(job).isNull(), -1).otherwise(F.pmod(F.xxhash64(job), F.lit(GROUPS))).cast("int").alias("in_group"),
        F.col(job).cast("string").alias("in_job"),
        number.isNull().alias("in_blank"),
        F.coalesce(number, F.lit(0).cast("long")).alias("in_order"),
        F.col(time).cast("timestamp").alias("in_time"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("in_t"),
        length.alias("in_d"),
        F.greatest(F.coalesce(progress_us(F.col(line)), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("in_us"),
        F.coalesce(F.col(line) == "progress=end", F.lit(False)).alias("in_ends"),
        micros(stall_seconds(length) if stall is None else stall).alias("in_bound"),
        micros(F.lit(180) if final is None else final).alias("in_final"),
    )
    rows = rows if clock else rows.withWatermark("in_time", late)
    told = rows.groupBy("in_group").applyInPandasWithState(
        _watchdog(clock, least),
        outputStructType="in_job string, `order` long, kind string, progress double",
        stateStructType="jobs array<struct<job: string, top: bigint, told: double, rose: bigint, bound: bigint, final: bigint, duration: bigint, closed: boolean>>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.EventTimeTimeout,
    )
    return told.select(F.col("in_job").cast(kinds[job]).alias(job), F.col("order").alias(order), "kind", "progress")


def read_all(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that its source has now, with its checkpoint and output in a shared folder, and reads
    what came out. What is in the folder already isn't done again."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
