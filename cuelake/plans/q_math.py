"""Queries for the number functions (group K of the survey) and for arrays, maps and JSON (group L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import mathx as mx
from cuelake.plans.catalog import query
from cuelake.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


_P = "least(value / 200, 1.0)"


@query("fn_logit_sigmoid", f"""SELECT event_id, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sigmoid FROM (SELECT event_id, value, least(greatest({_P}, 1e-6), 1 - 1e-6) AS q FROM events)""")
def fn_logit_sigmoid(spark, sf):
    return _events(spark, sf).select("event_id", F.round(mx.logit(F.least(F.col("value") / 200, F.lit(1.0))), 6).alias("logit"), F.round(mx.sigmoid((F.col("value") - 50) / 10), 6).alias("sigmoid"))


@query("fn_median", "SELECT user_id, round(median(value), 6) AS median FROM events GROUP BY user_id")
def fn_median(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.round(F.median("value"), 6).alias("median"))


@query("fn_logreg", "SELECT event_id, round(1 / (1 + exp(-(-1 + 0.02 * value - 0.5 * (event_id % 3)))), 6) AS p FROM events")
def fn_logreg(spark, sf):
    return _events(spark, sf).select("event_id", F.round(mx.linear_score(F.array(F.col("value"), (F.col("event_id") % 3).cast("double")), [0.02, -0.5], -1.0), 6).alias("p"))


@query("fn_beta_cal", f"SELECT event_id, round(1 / (1 + exp(-(1.2 * ln({_P} + 1e-6) - 0.8 * ln(1 - {_P} + 1e-6) - 0.1))), 6) AS p FROM events")
def fn_beta_cal(spark, sf):
    return _events(spark, sf).select("event_id", F.round(mx.beta_calibrate(F.least(F.col("value") / 200, F.lit(1.0)), 1.2, 0.8, 0.1), 6).alias("p"))


@query("fn_threshold", "SELECT event_id, round((event_id % 9 + 1.0) / (event_id % 9 + event_id % 4 + 2.0), 6) AS threshold FROM events")
def fn_threshold(spark, sf):
    return _events(spark, sf).select("event_id", F.round(mx.decision_threshold((F.col("event_id") % 9 + 1).cast("double"), (F.col("event_id") % 4 + 1).cast("double")), 6).alias("threshold"))


@query("fn_rating", "SELECT event_id, CAST(least(greatest(floor(value / 10 - 2 + 0.5), 0), 5) AS INT) AS rating FROM events")
def fn_rating(spark, sf):
    return _events(spark, sf).select("event_id", mx.rating(F.col("value") / 10 - 2).alias("rating"))


@query("fn_sample_times", """WITH d AS (SELECT event_id, CAST((event_id % 50) * 1000000 AS BIGINT) AS dur FROM events),
n AS (SELECT event_id, greatest(dur - 1000, 0) AS latest, CAST(least(greatest(ceil(dur / 1e6 * 2), 2), 240) AS BIGINT) AS n FROM d)
SELECT event_id, n AS n_times, CAST(CASE WHEN latest = 0 THEN 0 ELSE list_sum(list_transform(range(n), lambda i: CAST(latest * i // (n - 1) AS BIGINT))) END AS BIGINT) AS total FROM (SELECT event_id, latest, CASE WHEN latest = 0 THEN 1 ELSE n END AS n FROM n)""")
def fn_sample_times(spark, sf):
    times = mx.sample_times((F.col("event_id") % 50 * 1_000_000).cast("long"))
    return _events(spark, sf).select("event_id", F.size(times).cast("long").alias("n_times"), F.aggregate(times, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("fn_ruler", """SELECT event_id, CAST(CASE WHEN 800.0 / s >= 4 THEN 1 WHEN 3200.0 / s >= 4 THEN 4 WHEN 12800.0 / s >= 4 THEN 16 WHEN 51200.0 / s >= 4 THEN 64 WHEN 204800.0 / s >= 4 THEN 256 ELSE 1024 END AS BIGINT) AS step FROM (SELECT event_id, event_id % 10000 + 1 AS s FROM events)""")
def fn_ruler(spark, sf):
    return _events(spark, sf).select("event_id", mx.tick_step((F.col("event_id") % 10000 + 1).cast("double"), F.lit(800.0)).alias("step"))


@query("fn_clamp_span", """SELECT event_id, CAST(least(greatest(event_id % 500 - 50, 0), 300) AS BIGINT) AS start, CAST(CASE WHEN d > 0 THEN least(d, greatest(1, ceil(greatest(event_id % 900, 1) / 16.0))) ELSE greatest(1, ceil(greatest(event_id % 900, 1) / 16.0)) END AS BIGINT) AS span FROM (SELECT event_id, event_id % 40 AS d FROM events)""")
def fn_clamp_span(spark, sf):
    start = mx.clamp(F.col("event_id") % 500 - 50, F.lit(0).cast("long"), F.lit(300).cast("long"))
    return _events(spark, sf).select("event_id", start.alias("start"), mx.least_span((F.col("event_id") % 900).cast("double"), F.col("event_id") % 40).alias("span"))


@query("fn_log_scale", """SELECT event_id, round(0.1 + ln(least(greatest(x, 0.01), 1) / 0.01) / ln(100.0) * 0.9, 6) AS visual, round(0.01 * exp(least(greatest((x - 0.1) / 0.9, 0), 1) * ln(100.0)), 6) AS logical FROM (SELECT event_id, value / 100 AS x FROM events)""")
def fn_log_scale(spark, sf):
    x = F.col("value") / 100
    return _events(spark, sf).select("event_id", F.round(mx.to_visual(x, 0.01, 0.1), 6).alias("visual"), F.round(mx.to_logical(x, 0.01, 0.1), 6).alias("logical"))


@query("fn_size_estimate", """WITH s AS (SELECT event_id, ['mp4_h264', 'webm', 'mov_prores'][CAST(event_id % 3 + 1 AS INT)] AS c, CAST(event_id // 3 % 4 + 1 AS INT) AS q, (event_id % 100) * 1e6 AS dur FROM events)
SELECT event_id, round(CASE WHEN dur > 0 THEN (CASE c WHEN 'mov_prores' THEN [45.0, 147, 220, 220][q] WHEN 'mp4_h264' THEN [5.0, 9, 14, 24][q] ELSE [5.0, 9, 14, 24][q] * 0.6 END * (1280.0 * 720 * 25 / (1920.0 * 1080 * 30)) + 0.192) * 1e6 * (dur / 1e6) / 8 END, 2) AS bytes FROM s""")
def fn_size_estimate(spark, sf):
    container = F.element_at(F.array(*map(F.lit, ("mp4_h264", "webm", "mov_prores"))), (F.col("event_id") % 3 + 1).cast("int"))
    quality = F.element_at(F.array(*map(F.lit, mx.H264_MBPS)), F.expr("CAST(event_id div 3 % 4 + 1 AS INT)"))
    size = mx.file_size(container, quality, F.lit(1280.0), F.lit(720.0), F.lit(25.0), F.lit(192.0), F.col("event_id") % 100 * 1_000_000)
    return _events(spark, sf).select("event_id", F.round(size, 2).alias("bytes"))


@query("fn_even_dim", "SELECT event_id, greatest(event_id, 2) - greatest(event_id, 2) % 2 AS dim FROM events")
def fn_even_dim(spark, sf):
    return _events(spark, sf).select("event_id", mx.even_dimension(F.col("event_id")).alias("dim"))


@query("fn_ladder", """WITH s AS (SELECT event_id, [-16, -8, -4, -2, -1, 1, 2, 4, 8, 16] AS l, CAST(event_id % 11 AS INT) AS i, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events)
SELECT event_id, CAST(CASE WHEN i = 0 THEN d ELSE l[greatest(1, least(10, i + d))] END AS INT) AS speed FROM s""")
def fn_ladder(spark, sf):
    rate = F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.get(F.array(*map(F.lit, mx.SHUTTLE)), (F.col("event_id") % 11 - 1).cast("int")))
    return _events(spark, sf).select("event_id", mx.next_speed(rate, F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("speed"))


@query("top_ceiling", "SELECT event_id, CASE WHEN event_id % 700 <= 80 THEN 80 WHEN event_id % 700 <= 160 THEN 160 WHEN event_id % 700 <= 320 THEN 320 ELSE 640 END AS width FROM events")
def top_ceiling(spark, sf):
    return _events(spark, sf).select("event_id", mx.least_at_least(F.col("event_id") % 700, [80, 160, 320, 640]).alias("width"))


@query("top_nearest", "SELECT event_id, (SELECT arg_min(s, abs(s - event_id % 400) * 10 + i) FROM (VALUES (128, 0), (160, 1), (192, 2), (224, 3), (256, 4), (320, 5)) v(s, i)) AS rate FROM events")
def top_nearest(spark, sf):
    return _events(spark, sf).select("event_id", mx.nearest_of(F.col("event_id") % 400, mx.MP3_RATES).alias("rate"))


@query("fn_aspect", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round((event_id % 20 + 1) / 9.0, 6) END AS ratio FROM events")
def fn_aspect(spark, sf):
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN 'wide' ELSE concat(CAST(event_id % 20 + 1 AS STRING), ':9') END")
    return _events(spark, sf).select("event_id", F.round(mx.aspect_ratio(text), 6).alias("ratio"))


@query("fn_budget", "SELECT event_id, CAST(least(greatest(2 * ceil(event_id * 9973 / 1e6) + 8, 20), 60) AS BIGINT) AS stall, CAST(least(greatest(ceil((event_id % 64) / 3.0), 1), 16) AS BIGINT) AS threads FROM events")
def fn_budget(spark, sf):
    return _events(spark, sf).select("event_id", mx.stall_seconds(F.col("event_id") * 9973).alias("stall"), mx.thread_budget(F.col("event_id") % 64, F.lit(3)).alias("threads"))


@query("fn_fit_within", """SELECT event_id, CASE WHEN w >= h THEN 256 ELSE greatest(w * 256 // h, 1) END AS width, CASE WHEN w >= h THEN greatest(h * 256 // w, 1) ELSE 256 END AS height FROM (SELECT event_id, event_id % 1900 + 20 AS w, event_id * 7 % 1100 + 10 AS h FROM events)""")
def fn_fit_within(spark, sf):
    w, h = mx.fit_within(F.col("event_id") % 1900 + 20, F.col("event_id") * 7 % 1100 + 10, F.lit(256).cast("long"))
    return _events(spark, sf).select("event_id", w.alias("width"), h.alias("height"))


@query("fn_ladders", "SELECT r_regionkey, array_to_string([16, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512], ',') AS rates FROM region")
def fn_ladders(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.array_join(mx.bitrate_ladder().cast("array<string>"), ",").alias("rates"))


# ---- arrays, maps, JSON ----------------------------------------------------------------------

@query("map_ops", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'b2' ELSE event_type END AS b, CASE WHEN event_id % 2 = 0 THEN CAST(2 AS INT) ELSE 1 END AS n FROM events""")
def map_ops(spark, sf):
    first = F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.col("event_type"))
    second = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("c"), F.lit("b2"))).otherwise(F.create_map(F.lit("d"), F.lit("")))
    both = F.map_filter(F.map_concat(first, second), lambda k, v: v != "")
    return _events(spark, sf).select("event_id", F.coalesce(F.try_element_at(both, F.lit("c")), F.try_element_at(both, F.lit("b"))).alias("b"), F.size(both).alias("n"))


@query("map_entries", "SELECT event_type, user_id % 3 AS k, count(*) AS n FROM events GROUP BY ALL")
def map_entries(spark, sf):
    counts = _events(spark, sf).groupBy("event_type", (F.col("user_id") % 3).alias("k")).count().groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"))
    return counts.select("event_type", F.explode("m").alias("k", "n"))


@query("arr_slice", """WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS e FROM events GROUP BY user_id)
SELECT user_id, CAST(list_sum(e[1:3]) AS BIGINT) AS head, e[len(e)] AS last, CAST(coalesce(list_position(e, user_id * 3), 0) AS BIGINT) AS place, CAST(list_sum(list_concat(e[1:1], e[3:])) AS BIGINT) AS spliced FROM l""")
def arr_slice(spark, sf):
    rows = _events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    spliced = F.concat(F.slice("e", 1, 1), F.slice(F.col("e"), F.lit(3), F.greatest(F.size("e") - 2, F.lit(0))))
    return rows.select("user_id", total(F.slice("e", 1, 3)).alias("head"), F.element_at(F.reverse("e"), 1).alias("last"), F.array_position("e", F.col("user_id") * 3).alias("place"), total(spliced).alias("spliced"))


@query("arr_hof", """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, CAST(len(list_filter(v, lambda x: x > 100)) AS INT) AS n, len(list_filter(v, lambda x: x > 150)) > 0 AS some, len(list_filter(v, lambda x: x <= 0)) = 0 AS every, list_filter(v, lambda x: x > 50)[1] AS first FROM l""")
def arr_hof(spark, sf):
    rows = _events(spark, sf).groupBy("user_id").agg(F.expr("transform(array_sort(collect_list(struct(event_id, value))), x -> x.value)").alias("v"))
    return rows.select("user_id", F.size(F.filter("v", lambda x: x > 100)).alias("n"), F.exists("v", lambda x: x > 150).alias("some"), F.forall("v", lambda x: x > 0).alias("every"), F.get(F.filter("v", lambda x: x > 50), F.lit(0)).alias("first"))


@query("json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS doc FROM events")
def json_roundtrip(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return _events(spark, sf).select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), k.alias("k"))).alias("doc"))


@query("json_strict", "SELECT event_id, event_id % 5 <> 0 AS accepted FROM events")
def json_strict(spark, sf):
    doc = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"x":1,'), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    unknown = F.size(F.array_except(F.json_object_keys(doc), F.array(F.lit("k"))))
    return _events(spark, sf).select("event_id", (unknown == 0).alias("accepted"))


@query("map_canonical", "SELECT event_id, CASE WHEN event_type < user_id::VARCHAR THEN event_type || '=1,' || user_id || '=2' ELSE user_id || '=2,' || event_type || '=1' END AS text FROM events")
def map_canonical(spark, sf):
    m = F.create_map(F.col("event_type"), F.lit(1), F.col("user_id").cast("string"), F.lit(2))
    ordered = F.array_sort(F.map_entries(m))
    return _events(spark, sf).select("event_id", F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("text"))


@query("fn_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
