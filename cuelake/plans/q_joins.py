"""Queries for joins (group D of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import joins
from cuelake.plans.catalog import query
from cuelake.session import table


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """(track, sequence, speaker, text, start, end): turns as cues that overlap now and then; times in ms."""
    start = (F.col("turn") * 2000).cast("long")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("sequence"), F.col("role").alias("speaker"), "text", start.alias("start"), (start + F.least(F.length("text"), F.lit(400)) * 10).alias("end"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """(track, frame): five points of time for every turn."""
    return cues(spark, sf).select("track", F.explode(F.sequence(F.col("start") - 700, F.col("start") + 1700, F.lit(600))).alias("frame")).distinct()


_CUES = "cues AS (SELECT DISTINCT conv_id AS track, turn AS sequence, turn * 2000 AS start, turn * 2000 + least(length(text), 400) * 10 AS \"end\" FROM conversations)"
_PROBES = "probes AS (SELECT DISTINCT track, unnest([start - 700, start - 100, start + 500, start + 1100, start + 1700]) AS frame FROM cues)"
_CURRENT = 'current AS (SELECT p.track, p.frame, arg_max(c.sequence, c.start * 100000 + c.sequence) AS cue FROM probes p LEFT JOIN cues c ON c.track = p.track AND c.start <= p.frame AND p.frame <= c."end" GROUP BY ALL)'
_NEXT = "following AS (SELECT p.track, p.frame, (SELECT min(start) FROM cues c WHERE c.track = p.track AND c.start > p.frame) AS s, (SELECT count(*) FROM cues c WHERE c.track = p.track AND c.start <= p.frame) AS n FROM probes p)"
_WITH = f"WITH {_CUES}, {_PROBES}"


@query("join_left_annotations", """SELECT doc_id, CAST(coalesce(quality, 0) * (doc_id % 5 + 1) AS BIGINT) AS rating, coalesce(quality = 1, FALSE) AS retained, coalesce(toxic = 1, FALSE) AS excluded FROM documents LEFT JOIN labels USING (doc_id)""")
def join_left_annotations(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", (F.coalesce("quality", F.lit(0)) * (F.col("doc_id") % 5 + 1)).cast("long").alias("rating"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("retained"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("excluded"))


@query("join_priority_lookup", """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN s.s_name IS NOT NULL THEN 0 WHEN t.s_name IS NOT NULL THEN 1 ELSE 2 END AS hit_kind, coalesce(s.s_name, t.s_name, '') AS hit, count(*) AS n
FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_partkey LEFT JOIN supplier t ON t.s_suppkey = l_suppkey * 2 GROUP BY ALL""")
def join_priority_lookup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    out = joins.priority_join(rows, [F.col("l_partkey"), F.col("l_suppkey") * 2], table(spark, sf, "supplier"), "s_suppkey", "s_name")
    return out.groupBy("l_orderkey", "l_partkey", "l_suppkey", F.coalesce("hit_no", F.lit(2)).alias("hit_kind"), F.coalesce("hit", F.lit("")).alias("hit")).agg(F.count("*").alias("n"))


@query("join_interval_latest", f"{_WITH}, {_CURRENT} SELECT track AS track_id, frame, cue AS cue_sequence FROM current")
def join_interval_latest(spark, sf):
    out = joins.interval_latest(probes(spark, sf), cues(spark, sf).select("track", "sequence", "start", "end").distinct(), "track", "frame", "sequence", width=4096)
    return out.select(F.col("track").alias("track_id"), "frame", F.col("sequence").alias("cue_sequence"))


@query("join_point_in_interval", f"{_WITH} SELECT p.track, p.frame, c.sequence FROM probes p JOIN cues c ON c.track = p.track AND p.frame BETWEEN c.start AND c.\"end\"")
def join_point_in_interval(spark, sf):
    return joins.interval_join(probes(spark, sf), cues(spark, sf).select("track", "sequence", "start", "end").distinct(), "track", "frame", width=4096).select("track", "frame", "sequence")


@query("join_asof_forward", f"{_WITH}, {_NEXT} SELECT track AS track_id, frame, CASE WHEN n > 0 THEN s // 2000 END AS next_sequence FROM following")
def join_asof_forward(spark, sf):
    out = joins.asof_forward(probes(spark, sf), cues(spark, sf).select("track", "start", "sequence").distinct(), "track", "frame", "start", "sequence", width=1 << 20)
    return out.select(F.col("track").alias("track_id"), "frame", F.col("sequence").alias("next_sequence"))


@query("join_next_active", f"""{_WITH}
SELECT p.track, p.frame, min(c.sequence) AS sequence FROM probes p JOIN cues c ON c.track = p.track AND c.start > p.frame - 2000 AND c."end" >= p.frame GROUP BY ALL""")
def join_next_active(spark, sf):
    rows = cues(spark, sf).select("track", "sequence", "start", "end").distinct()
    return joins.next_active(probes(spark, sf), rows, "track", "frame", "sequence", behind=2000, width=4096).where("sequence is not null")


@query("join_follow", f"{_WITH}, {_CURRENT}, {_NEXT} SELECT track, frame, coalesce(cue, CASE WHEN n > 0 THEN s // 2000 END) AS sequence FROM current JOIN following USING (track, frame)")
def join_follow(spark, sf):
    rows, asked = cues(spark, sf).select("track", "sequence", "start", "end").distinct(), probes(spark, sf)
    now = joins.interval_latest(asked, rows, "track", "frame", "sequence", width=4096).withColumnRenamed("sequence", "now")
    ahead = joins.asof_forward(asked, rows, "track", "frame", "start", "sequence", width=1 << 20)
    return now.join(ahead, ["track", "frame"]).select("track", "frame", F.coalesce("now", "sequence").alias("sequence"))


@query("join_interval_overlap", f"""{_WITH} SELECT a.track, a.sequence, b.sequence AS other, greatest(a.start, b.start) AS clip_start, least(a."end", b."end") AS clip_end FROM cues a JOIN cues b ON a.track = b.track AND a.sequence < b.sequence AND a.start < b."end" AND a."end" > b.start""")
def join_interval_overlap(spark, sf):
    rows = cues(spark, sf).select("track", "sequence", "start", "end").distinct()
    a = rows.select("track", "sequence", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = rows.select("track", F.col("sequence").alias("other"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return joins.overlap_join(a, b, "track", width=4096).where("sequence < other").select("track", "sequence", "other", "clip_start", "clip_end")


@query("join_asof_nearest", f"""{_WITH} SELECT p.track, p.frame, arg_min(c.sequence, abs(c.start - p.frame) * 100000 + c.sequence) AS sequence FROM probes p LEFT JOIN cues c ON c.track = p.track AND abs(c.start - p.frame) <= 900 GROUP BY ALL""")
def join_asof_nearest(spark, sf):
    return joins.nearest_join(probes(spark, sf), cues(spark, sf).select("track", "sequence", "start").distinct(), "track", "frame", "start", "sequence", 1000, 900)


@query("join_stack_members", """WITH s AS (SELECT o_custkey AS stack, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey), m AS (SELECT unnest(ids) AS shot, stack FROM s)
SELECT o_orderkey AS shot, m.stack FROM orders LEFT JOIN (SELECT shot, max(stack) AS stack FROM m GROUP BY shot) m ON m.shot = o_orderkey""")
def join_stack_members(spark, sf):
    orders = table(spark, sf, "orders")
    stacks = orders.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("stack")).agg(F.collect_list("o_orderkey").alias("ids"))
    members = stacks.select(F.explode("ids").alias("shot"), "stack").groupBy("shot").agg(F.max("stack").alias("stack"))  # the last write wins
    return orders.select(F.col("o_orderkey").alias("shot")).join(members, "shot", "left")


@query("join_export_source", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def join_export_source(spark, sf):
    chosen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf, "orders").join(chosen, "o_orderkey", "left_semi")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return orders.join(customer, "o_custkey").join(table(spark, sf, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("join_refresh", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'kept' ELSE o_orderstatus END AS status, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 100000
WHERE l_returnflag = 'N' OR o_orderkey IS NOT NULL GROUP BY ALL""")
def join_refresh(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    kept = rows.where("l_returnflag = 'N'").withColumn("status", F.lit("kept"))
    online = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    bound = rows.where("l_returnflag <> 'N'").join(online, "l_orderkey").select(*kept.columns)
    return kept.unionByName(bound).groupBy("l_orderkey", "l_linenumber", "l_partkey", "status").agg(F.count("*").alias("n"))


@query("join_existing_targets", "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size < 10)")
def join_existing_targets(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", "p_name").join(part.where("p_size < 10").select("p_name"), "p_name", "left_semi")


@query("join_anti_conflicts", "SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3)")
def join_anti_conflicts(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", "p_name").join(part.where("p_size < 3").select("p_name"), "p_name", "left_anti")


@query("join_relink", """SELECT a.p_partkey, min(b.p_partkey) AS found FROM part a JOIN part b ON b.p_type = a.p_type AND lower(b.p_name) = lower(a.p_name) AND b.p_size >= 25 WHERE a.p_size < 25 GROUP BY ALL""")
def join_relink(spark, sf):
    part = table(spark, sf, "part").withColumn("name", F.lower("p_name"))
    there = part.where("p_size >= 25").groupBy("p_type", "name").agg(F.min("p_partkey").alias("found"))
    return part.where("p_size < 25").join(there, ["p_type", "name"]).select("p_partkey", "found")


@query("join_input_index", """WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber * 1000000 + l_suppkey) AS first FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) - 1 AS BIGINT) AS input FROM f""")
def join_input_index(spark, sf):
    from pyspark.sql import Window

    first = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("first"))
    return first.select("l_orderkey", "l_partkey", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("first", "l_partkey")) - 1).cast("long").alias("input"))


@query("join_reconcile", """SELECT c.c_custkey, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.total > 2 * c.c_acctbal THEN 'changed' ELSE 'same' END AS status FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def join_reconcile(spark, sf):
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("total"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("total") > 2 * F.col("c_acctbal"), "changed").otherwise("same")
    return table(spark, sf, "customer").join(seen, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("join_nearest_point", """SELECT c_custkey, arg_min(r_regionkey, pow(c_acctbal / 1000 - r_regionkey * 2, 2) + pow(c_nationkey - r_regionkey * 5, 2) + r_regionkey / 1e6) AS region FROM customer, region GROUP BY c_custkey""")
def join_nearest_point(spark, sf):
    areas = table(spark, sf, "region").select(F.col("r_regionkey").alias("region"), (F.col("r_regionkey") * 2).alias("_x"), (F.col("r_regionkey") * 5).alias("_y"))
    points = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").alias("y"))
    return joins.nearest_point(points, areas, "region", "x", "y").select("c_custkey", "region")


@query("join_anti_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")
def join_anti_orphans(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_stream_ordinal", """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, s.o_orderkey AS stream, CASE WHEN s.o_orderkey IS NULL THEN 'no such stream' ELSE '' END AS warning FROM customer LEFT JOIN s ON s.o_custkey = c_custkey AND s.ordinal = c_custkey % 3""")
def join_stream_ordinal(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    streams = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), (F.row_number().over(order) - 1).alias("ordinal"), F.col("o_orderkey").alias("stream"))
    asked = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("ordinal"))
    return asked.join(streams, ["c_custkey", "ordinal"], "left").select("c_custkey", "stream", F.when(F.col("stream").isNull(), "no such stream").otherwise("").alias("warning"))


@query("join_rect_overlap", f"""{_WITH} SELECT a.track, a.sequence, b.sequence AS other FROM cues a JOIN cues b ON a.track = b.track AND a.sequence < b.sequence AND a.start < b."end" AND a."end" > b.start AND abs(a.sequence % 4 - b.sequence % 4) <= 1""")
def join_rect_overlap(spark, sf):
    rows = cues(spark, sf).select("track", "sequence", "start", "end").distinct()
    a = rows.select("track", "sequence", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = rows.select("track", F.col("sequence").alias("other"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = joins.overlap_join(a, b, "track", width=4096)
    return both.where((F.col("sequence") < F.col("other")) & (F.abs(F.col("sequence") % 4 - F.col("other") % 4) <= 1)).select("track", "sequence", "other")


@query("join_visible_tracks", """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A') OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def join_visible_tracks(spark, sf):
    state = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_returnflag") == "A").alias("on"))
    return table(spark, sf, "orders").select("o_orderkey").join(state, "o_orderkey", "left").where("coalesce(on, true)").select("o_orderkey")


@query("join_audio_binding", """WITH b AS (SELECT DISTINCT l_orderkey AS video, l_partkey AS source FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT o_orderkey AS video, -1 AS source, 0 AS k FROM orders UNION ALL SELECT video, source, 1 FROM b)
SELECT video, source, CAST(row_number() OVER (PARTITION BY video ORDER BY k, source) - 1 AS BIGINT) AS ordinal FROM a WHERE video IN (SELECT o_orderkey FROM orders)""")
def join_audio_binding(spark, sf):
    from pyspark.sql import Window

    videos = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video"))
    bound = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("video"), F.col("l_partkey").alias("source")).distinct().join(videos, "video", "left_semi")
    both = videos.select("video", F.lit(-1).cast("long").alias("source"), F.lit(0).alias("k")).unionByName(bound.withColumn("k", F.lit(1)))
    return both.select("video", "source", (F.row_number().over(Window.partitionBy("video").orderBy("k", "source")) - 1).cast("long").alias("ordinal"))


@query("join_track_cues", f"WITH {_CUES}, o AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS bound FROM orders) SELECT item, c.track, count(*) AS n FROM o JOIN cues c ON c.track = coalesce(bound, item) GROUP BY ALL")
def join_track_cues(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")), F.col("o_orderkey")).alias("track"))
    counts = cues(spark, sf).select("track", "sequence", "start", "end").distinct().groupBy("track").count()
    return items.join(counts, "track").groupBy("item", "track").agg(F.sum("count").alias("n"))


@query("join_rule_matrix", "SELECT p_partkey, r.rule FROM part JOIN (VALUES ('individual', 'label'), ('individual', 'time'), ('merge', 'custom')) r(mode, rule) ON r.mode = CASE WHEN p_size % 2 = 0 THEN 'merge' ELSE 'individual' END")
def join_rule_matrix(spark, sf):
    rules = spark.createDataFrame([("individual", "label"), ("individual", "time"), ("merge", "custom")], "mode string, rule string")
    mode = F.when(F.col("p_size") % 2 == 0, "merge").otherwise("individual")
    return table(spark, sf, "part").select("p_partkey", mode.alias("mode")).join(F.broadcast(rules), "mode").select("p_partkey", "rule")  # three rows
