"""Streams with timers: what happens when no further row comes."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cuelake.streaming import delivery, timed

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def test_rate_limit_flushes_once_a_window_is_over(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(1)), ("a", at(29.5)), ("a", at(30)), ("b", at(5)), (None, at(3)), (None, at(4)), ("a", None), ("b", at(100))]
    out = timed.rate_limited_flushes(stream(spark, f"{tmp_path}/in", rows, "k string, ts timestamp"), "k", "ts", 30)
    got = sorted(tuple(r) for r in timed.read_all(out, f"{tmp_path}/out").select(F.coalesce("k", F.lit("-")), "kind", F.unix_seconds("at") - F.unix_seconds(F.lit(T0).cast("timestamp")), "suppressed").collect())
    # the second window of a and the last of b hold nothing more; a's first window and the null key's are flushed
    assert got == [("-", "first", 3, 0), ("-", "flush", 33, 1), ("a", "first", 0, 0), ("a", "first", 30, 0), ("a", "flush", 30, 2), ("b", "first", 5, 0), ("b", "first", 100, 0)]


def test_rate_limit_state_outlives_the_stream(spark, tmp_path):
    schema = "k string, ts timestamp"
    source = stream(spark, f"{tmp_path}/in", [("a", at(0))], schema)
    out = timed.rate_limited_flushes(source, "k", "ts", 30)
    assert timed.read_all(out, f"{tmp_path}/out").count() == 1
    stream(spark, f"{tmp_path}/in", [("a", at(10)), ("a", at(20)), ("z", at(90))], schema)
    got = timed.read_all(out, f"{tmp_path}/out").where("k = 'a'").collect()
    assert sorted((r["kind"], r["suppressed"]) for r in got) == [("first", 0), ("flush", 2)]


def test_silent_job_stalls_by_event_time(spark, tmp_path):
    us = "out_time_us={}".format
    rows = [
        ("quiet", 1, at(0), us(1_000_000)), ("quiet", 2, at(3), us(2_000_000)),
        ("done", 1, at(0), us(5_000_000)), ("done", 2, at(1), "progress=end"), ("done", 3, at(2), us(9_000_000)),
        ("final", 1, at(0), us(9_950_000)), ("late", 1, at(0), "noise"), ("late", 2, at(50), us(1)), ("late", 3, at(51), us(2)),
        ("clock", 1, at(100), us(10)), (None, 1, at(99), None),
    ]
    source = stream(spark, f"{tmp_path}/in", rows, "job string, n long, ts timestamp, line string").withColumn("d", F.lit(10_000_000).cast("long"))
    out = timed.read_all(timed.watched_progress(source, "job", "n", "ts", "line", "d"), f"{tmp_path}/out")
    got = {}
    for r in out.collect():
        got.setdefault(r["job"], []).append((r["n"], r["kind"], round(r["progress"], 3)))
    assert sorted(got["quiet"], key=str) == [(1, "progress", 0.1), (2, "progress", 0.2), (None, "stalled", 0.2)]
    assert sorted(got["done"]) == [(1, "progress", 0.5), (2, "end", 0.5)]
    # all but done: 180 seconds, which have not passed
    assert got["final"] == [(1, "progress", 0.995)]
    assert sorted(got["late"]) == [(1, "progress", 0.0), (2, "stalled", 0.0)]
    assert got["clock"] == [(1, "progress", 0.0)] and got[None] == [(1, "progress", 0.0)]


def test_timers_by_the_clock(spark, tmp_path):
    """No row comes after the first ones; the clock alone ends the window and tells the silent job."""
    schema = "job string, n long, ts timestamp, line string"
    source = stream(spark, f"{tmp_path}/in", [("a", 1, at(0), "out_time_us=5"), ("a", 2, at(0), "out_time_us=7")], schema)
    jobs = timed.watched_progress(source.withColumn("d", F.lit(10).cast("long")), "job", "n", "ts", "line", "d", clock=True, stall=F.lit(2), final=F.lit(2))
    limits = timed.rate_limited_flushes(source, "job", "ts", 2, clock=True)
    runs = [df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(processingTime="500 milliseconds").start() for df, name in ((jobs, "watched"), (limits, "limited"))]
    try:
        end = time.time() + 90
        while time.time() < end and (spark.table("watched").count() < 3 or spark.table("limited").count() < 2):
            assert all(r.exception() is None for r in runs)
            time.sleep(0.5)
    finally:
        for r in runs:
            r.stop()
    assert sorted((r["n"] or 9, r["kind"]) for r in spark.table("watched").collect()) == [(1, "progress"), (2, "progress"), (9, "stalled")]
    assert sorted((r["kind"], r["suppressed"]) for r in spark.table("limited").collect()) == [("first", 0), ("flush", 1)]


def test_empty_stream(spark, tmp_path):
    source = stream(spark, f"{tmp_path}/in", [], "k string, ts timestamp")
    assert timed.read_all(timed.rate_limited_flushes(source, "k", "ts", 30), f"{tmp_path}/out").collect() == []


def test_a_repeated_batch_is_delivered_once(spark, tmp_path):
    """The driver dies after the first subscriber; the batch comes again and only the second one gets it."""
    batch = spark.createDataFrame([(n, "a" if n % 3 else None) for n in range(300)], "n long, kind string")
    calls = []

    def first(events, batch):
        calls.append(("first", batch, events.count()))

    def dies(events, batch):
        calls.append(("second", batch, events.count()))
        if len(calls) == 2:
            raise KeyboardInterrupt

    def fails(events, batch):
        raise ValueError("full " * 2_000)

    people = {"first": delivery.Subscriber(F.lit(True), first), "second": delivery.Subscriber(F.col("kind") == "a", dies), "third": delivery.Subscriber(F.col("n") < 150, fails)}
    with pytest.raises(KeyboardInterrupt):
        delivery.deliver_batch(batch, 0, people, "n", "n", f"{tmp_path}/out")
    delivery.deliver_batch(batch, 0, people, "n", "n", f"{tmp_path}/out")
    assert calls == [("first", 0, 300), ("second", 0, 200), ("second", 0, 200)]
    log = {r["subscriber"]: r for r in spark.read.parquet(f"{tmp_path}/out/log").collect()}
    assert len(log) == 3 and log["third"]["failed"] and len(log["third"]["error"]) == 4096 and not log["second"]["failed"]
    told = {r["event"]: tuple(r)[1:] for r in delivery.journal(spark, f"{tmp_path}/out").collect()}
    assert len(told) == delivery.JOURNAL and min(told) == 100
    assert told[299] == (3, 2 if 299 % 3 else 1, 1 if 299 % 3 else 2, 0) and told[120] == (3, 1, 1, 1)


def test_jobs_share_the_state_of_their_group(spark, tmp_path, monkeypatch):
    """State and calls grow with the groups, not with the jobs; each job goes on where it stopped."""
    monkeypatch.setattr(timed, "GROUPS", 3, raising=False)
    us, schema = "out_time_us={}".format, "job long, n long, ts timestamp, line string"
    source = stream(spark, f"{tmp_path}/in", [(k, k, at(k / 10), us(1_000_000 + k)) for k in range(60)] + [(None, None, at(1), us(1))], schema)
    out = timed.watched_progress(source.withColumn("d", F.lit(10_000_000).cast("long")), "job", "n", "ts", "line", "d")

    def run():
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])

    assert run() <= 4
    # even jobs end, the first ten fall silent, the others are told again; what comes after an end is ignored
    stream(spark, f"{tmp_path}/in", [(k, 100, at(10), "progress=end" if k % 2 == 0 else us(6_000_000)) for k in range(10, 60)] + [(10, 101, at(11), us(9_000_000)), (999, 1, at(32), us(2))], schema)
    assert run() <= 4
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r["job"], []).append((r["n"], r["kind"], round(r["progress"], 2)))
    assert len(got) == 62 and got[999] == [(1, "progress", 0.0)]
    assert sorted(got[None], key=str) == [(None, "progress", 0.0), (None, "stalled", 0.0)]
    for k in range(60):
        want = [(k, "progress", 0.1)] + ([(None, "stalled", 0.1)] if k < 10 else [(100, "end", 0.1)] if k % 2 == 0 else [(100, "progress", 0.6)])
        assert sorted(got[k], key=str) == sorted(want, key=str), k
