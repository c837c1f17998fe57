"""Queries for the time functions (group J of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import timecode as tc
from cuelake.plans.catalog import query
from cuelake.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


_US = "(event_id * 7919123 % 20000000000)"
_RATE = "(CASE event_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 29.97 ELSE 60 END)"


def _us():
    return F.expr(_US)


def _rate():
    return F.expr(f"CAST({_RATE} AS DOUBLE)")


_CLOCK = "concat(lpad(CAST(event_id % 30 AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(event_id * 7 % 60 AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(event_id * 11 % 60 AS VARCHAR(9)), 2, '0'))"
_WHOLE = "((event_id % 30) * 3600 + (event_id * 7 % 60) * 60 + event_id * 11 % 60) * 1000000"


@query("fn_parse_srt_time", f"""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN {_WHOLE} + (event_id % 1000) * 1000 WHEN 1 THEN (event_id % 60) * 60000000 + 2500000 WHEN 2 THEN 0 WHEN 3 THEN {_WHOLE} + 50000 ELSE {_WHOLE} END AS BIGINT) AS us FROM events""")
def fn_parse_srt_time(spark, sf):
    text = F.expr(f"""CASE event_id % 5 WHEN 0 THEN concat({_CLOCK}, ',', lpad(CAST(event_id % 1000 AS STRING), 3, '0')) WHEN 1 THEN concat(CAST(event_id % 60 AS STRING), ':02.5')
        WHEN 2 THEN 'no time' WHEN 3 THEN concat({_CLOCK}, '.05') ELSE concat(' ', {_CLOCK}, ' ') END""")
    return _events(spark, sf).select("event_id", tc.parse_subtitle_time(text).alias("us"))


@query("fn_parse_ass_time", f"SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 0 ELSE {_WHOLE} + (event_id % 100) * 10000 END AS BIGINT) AS us FROM events")
def fn_parse_ass_time(spark, sf):
    text = F.expr(f"CASE event_id % 3 WHEN 0 THEN '12:30.5' ELSE concat({_CLOCK}, '.', lpad(CAST(event_id % 100 AS STRING), 2, '0')) END")
    return _events(spark, sf).select("event_id", tc.parse_ass_time(text).alias("us"))


@query("fn_sec_to_us", """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN -(event_id * 1000000 + 250000) WHEN 2 THEN event_id * 1000000 + 123456 ELSE -9223372036854775808 END AS BIGINT) AS us FROM events""")
def fn_sec_to_us(spark, sf):
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN '9223372036854.775808' WHEN 1 THEN concat('-', CAST(event_id AS STRING), '.25') WHEN 2 THEN concat('+', CAST(event_id AS STRING), '.1234569') ELSE '-999999999999999999999999.0' END""")
    return _events(spark, sf).select("event_id", tc.seconds_to_us(text).alias("us"))


@query("fn_us_frame", f"""SELECT event_id, CAST(floor({_US} / 1e6 * {_RATE} + 0.5) AS BIGINT) AS frame, CAST(floor(event_id / CAST({_RATE} AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS us FROM events""")
def fn_us_frame(spark, sf):
    return _events(spark, sf).select("event_id", tc.us_to_frame(_us(), _rate()).alias("frame"), tc.frame_to_us(F.col("event_id"), _rate()).alias("us"))


@query("fn_frame_us_rs", f"""SELECT event_id, CAST(least(round(event_id / CAST({_RATE} AS DOUBLE) * 1e6), 300000000) AS BIGINT) AS us, CAST(ceil({_US} / 1e6 * CAST({_RATE} AS DOUBLE)) AS BIGINT) AS frames FROM events""")
def fn_frame_us_rs(spark, sf):
    return _events(spark, sf).select("event_id", tc.frame_to_us_within(F.col("event_id"), _rate(), F.lit(300_000_000)).alias("us"), tc.expected_frames(_us(), _rate()).alias("frames"))


_MS = f"CAST(floor({_US} / 1000.0 + 0.5) AS BIGINT)"


@query("fn_fmt_duration", f"""SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS text
FROM (SELECT event_id, {_MS} AS ms FROM events)""")
def fn_fmt_duration(spark, sf):
    return _events(spark, sf).select("event_id", tc.format_duration(_us()).alias("text"))


_CODE = """lpad(CAST(f // fps // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // fps // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // fps % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f % fps AS VARCHAR), 2, '0')"""
_FRAMES = f"(SELECT event_id, CAST(floor({_RATE} + 0.5) AS BIGINT) AS fps, CAST(floor({_US} / 1e6 * CAST({_RATE} AS DOUBLE) + 0.5) AS BIGINT) AS f FROM events)"


@query("fn_fmt_timecode", f"SELECT event_id, {_CODE} AS code FROM {_FRAMES}")
def fn_fmt_timecode(spark, sf):
    return _events(spark, sf).select("event_id", tc.format_time(_us(), _rate()).alias("code"))


@query("fn_parse_timecode", f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE f END AS frame FROM {_FRAMES}")
def fn_parse_timecode(spark, sf):
    code = F.when(F.col("event_id") % 7 == 0, F.lit("00:61:00:00")).otherwise(tc.format_time(_us(), _rate()))
    return _events(spark, sf).select("event_id", tc.parse_frame(code, _rate()).alias("frame"))


@query("fn_frame_rate", """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 23.976 END AS DOUBLE) AS rate,
    CAST(CASE event_id % 5 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25 WHEN 2 THEN 240 WHEN 3 THEN 240 ELSE 23.976 END AS DOUBLE) AS first FROM events""")
def fn_frame_rate(spark, sf):
    text = F.expr("CASE event_id % 5 WHEN 0 THEN '30000/1001' WHEN 1 THEN ' 25 ' WHEN 2 THEN '25/0' WHEN 3 THEN 'x' ELSE '23.976' END")
    return _events(spark, sf).select("event_id", tc.parse_rate(text).alias("rate"), tc.first_rate(text, F.lit("1000")).alias("first"))


@query("fn_time_range", f"SELECT event_id, replace({_CODE}, ':', '') || '-' || replace({_CODE}, ':', '') AS range FROM {_FRAMES}")
def fn_time_range(spark, sf):
    return _events(spark, sf).select("event_id", tc.time_range(_us(), _us(), _rate()).alias("range"))


@query("fn_progress_time", f"""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id * 1000 WHEN 1 THEN event_id WHEN 2 THEN {_WHOLE} + 500000 ELSE NULL END AS BIGINT) AS us FROM events""")
def fn_progress_time(spark, sf):
    line = F.expr(f"CASE event_id % 4 WHEN 0 THEN concat('out_time_us=', CAST(event_id * 1000 AS STRING)) WHEN 1 THEN concat('out_time_ms=', CAST(event_id AS STRING)) WHEN 2 THEN concat('out_time=', {_CLOCK}, '.500000') ELSE 'out_time=N/A' END")
    return _events(spark, sf).select("event_id", tc.progress_us(line).alias("us"))


@query("fn_clamp_range", """WITH r AS (SELECT event_id, CAST(event_id % 1200 - 100 AS BIGINT) AS s, CAST(event_id * 7 % 1300 - 100 AS BIGINT) AS e FROM events),
c AS (SELECT event_id, least(greatest(s, 0), 1000) AS a, CASE WHEN e <= 0 THEN 1000 ELSE least(e, 1000) END AS b FROM r) SELECT event_id, CAST(a AS BIGINT) AS range_start, CAST(greatest(a, b) AS BIGINT) AS range_end FROM c""")
def fn_clamp_range(spark, sf):
    start, end = tc.clamp_range(F.expr("event_id % 1200 - 100"), F.expr("event_id * 7 % 1300 - 100"), F.lit(1000).cast("long"))
    return _events(spark, sf).select("event_id", start.alias("range_start"), end.alias("range_end"))


@query("fn_snap", f"""SELECT event_id, CAST(floor(f / r * 1e6 + 0.5) AS BIGINT) AS us FROM (SELECT event_id, CAST({_RATE} AS DOUBLE) AS r, floor({_US} / 1e6 * CAST({_RATE} AS DOUBLE) + 0.5) AS f FROM events)""")
def fn_snap(spark, sf):
    return _events(spark, sf).select("event_id", tc.snap_us(_us(), _rate()).alias("us"))


@query("fn_time_bucket", f"""SELECT event_id, CAST((least({_US}, 8999999000) + 50000) // 100000 AS BIGINT) AS bucket, CAST(least(((least({_US}, 8999999000) + 50000) // 100000) * 100000, 8999999000) AS BIGINT) AS us FROM events""")
def fn_time_bucket(spark, sf):
    whole = F.lit(9_000_000_000)
    number = tc.bucket(_us(), whole)
    return _events(spark, sf).select("event_id", number.alias("bucket"), tc.bucket_us(number, whole).alias("us"))
