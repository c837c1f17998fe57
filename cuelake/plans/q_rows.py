"""Queries for filters and projections (group C), aggregations (E), windows (F), sorts (G) and sets (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as fx
from cuelake.operators import predicates, sets
from cuelake.plans.catalog import query
from cuelake.session import table


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as cues with annotations: (doc_id, text, speaker, style, rating, retained, excluded, color, custom)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("speaker"), F.col("lang").alias("style"))
    both = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return both.select(
        "doc_id", "text", "speaker", "style", (F.coalesce("quality", F.lit(0)) * (F.col("doc_id") % 5 + 1)).cast("long").alias("rating"), (F.col("quality") == 1).alias("retained"), (F.col("toxic") == 1).alias("excluded"),
        F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 3 == 0), "red").alias("color"), F.when(F.col("doc_id") % 10 == 0, F.lit(" mine ")).alias("custom"),
    )


_NOTES = """notes AS (SELECT doc_id, text, source AS speaker, lang AS style, CAST(coalesce(quality, 0) * (doc_id % 5 + 1) AS BIGINT) AS rating, coalesce(quality = 1, FALSE) AS retained, coalesce(toxic = 1, FALSE) AS excluded,
    CASE WHEN quality IS NOT NULL AND doc_id % 3 = 0 THEN 'red' ELSE '' END AS color, CASE WHEN doc_id % 10 = 0 THEN 'mine' ELSE '' END AS custom FROM documents LEFT JOIN labels USING (doc_id)),
cues AS (SELECT *, CASE WHEN custom <> '' THEN custom ELSE color END AS label, CASE WHEN retained THEN 'retained' WHEN excluded THEN 'excluded' ELSE 'none' END AS flag, rating > 0 OR retained OR excluded OR color <> '' OR custom <> '' AS edited FROM notes)"""


@query("flt_cue_search_all", f"""WITH {_NOTES} SELECT doc_id, rating, flag, edited FROM cues WHERE contains(lower(concat_ws(' ', text, speaker, style, label)), 'the') AND contains(lower(concat_ws(' ', text, speaker, style, label)), 'ing') AND (rating >= 2 OR NOT edited) AND flag <> 'excluded'""")
def flt_cue_search_all(spark, sf):
    rows = predicates.with_annotation_columns(annotated(spark, sf))
    hay = F.concat_ws(" ", "text", "speaker", "style", "label")
    return rows.where(predicates.matches_all(hay, "The  ING") & ((F.col("rating") >= 2) | ~F.col("edited")) & (F.col("flag") != "excluded")).select("doc_id", "rating", "flag", "edited")


@query("flt_cue_attributes", f"WITH {_NOTES} SELECT doc_id FROM cues WHERE rating <= 3 AND flag IN ('retained', 'none') AND edited AND (color = 'red' OR custom <> '')")
def flt_cue_attributes(spark, sf):
    rows = predicates.with_annotation_columns(annotated(spark, sf))
    return rows.where(predicates.attributes(rating=("lte", 3), flags=["retained", "none"], edited=[True], colors=["red", "custom"])).select("doc_id")


@query("flt_shot_attributes", f"WITH {_NOTES} SELECT doc_id FROM cues WHERE rating = 4 AND flag = 'retained'")
def flt_shot_attributes(spark, sf):
    rows = predicates.with_annotation_columns(annotated(spark, sf))
    return rows.where(predicates.attributes(rating=("eq", 4), flags=["retained"])).select("doc_id")


_VALUES = "concat(p_name, ' ', p_type)"


def _rule(spark, sf, rule, text):
    values = F.filter(F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" "))), lambda x: F.trim(x) != "")
    return table(spark, sf, "part").where(predicates.text_rule(values, rule, text)).select("p_partkey")


_JOINED = "lower(CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name END)"


@query("flt_contains_any", f"SELECT p_partkey FROM part WHERE contains({_JOINED}, 'red') OR contains({_JOINED}, 'promo')")
def flt_contains_any(spark, sf):
    return _rule(spark, sf, "contains", "Red, promo")


@query("flt_contains_all", f"SELECT p_partkey FROM part WHERE contains({_JOINED}, 're') AND contains({_JOINED}, 'a')")
def flt_contains_all(spark, sf):
    return _rule(spark, sf, "containsAll", "re a")


@query("flt_whole_words", rf"SELECT p_partkey FROM part WHERE regexp_matches({_JOINED}, '(^|[^\p{{L}}\p{{N}}_])red($|[^\p{{L}}\p{{N}}_])')")
def flt_whole_words(spark, sf):
    return _rule(spark, sf, "containsWords", "RED")


@query("flt_not_contains", f"SELECT p_partkey FROM part WHERE NOT contains({_JOINED}, 'red') AND NOT contains({_JOINED}, 'small')")
def flt_not_contains(spark, sf):
    return _rule(spark, sf, "doesNotContain", "red small")


@query("flt_prefix_suffix", "SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 're') OR (p_size % 2 = 0 AND starts_with(lower(p_type), 're'))")
def flt_prefix_suffix(spark, sf):
    return _rule(spark, sf, "startsWith", "Re")


@query("flt_is_empty", "SELECT p_partkey, p_size % 2 = 1 AS blank FROM part")
def flt_is_empty(spark, sf):
    values = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" "))), lambda x: F.trim(x) != "")
    return table(spark, sf, "part").select("p_partkey", predicates.text_rule(values, "isEmpty", "").alias("blank"))


@query("flt_scope", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN contains(lower(p_name), 'red') WHEN 1 THEN contains(lower(p_type), 'promo') ELSE contains(lower(p_name || ' ' || p_type), 'red') OR contains(lower(p_name || ' ' || p_type), 'promo') END AS hit FROM part")
def flt_scope(spark, sf):
    size = F.col("p_size") % 3
    values = F.when(size == 0, F.array("p_name")).when(size == 1, F.array("p_type")).otherwise(F.array("p_name", "p_type"))
    term = F.when(size == 0, predicates.text_rule(values, "contains", "red")).when(size == 1, predicates.text_rule(values, "contains", "promo")).otherwise(predicates.text_rule(values, "contains", "red promo"))
    return table(spark, sf, "part").select("p_partkey", term.alias("hit"))


@query("flt_media_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def flt_media_search(spark, sf):
    return table(spark, sf, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("brand#1"))).select("p_partkey")


@query("flt_selected", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_selected(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("flt_drift", "SELECT event_id FROM events WHERE event_id % 50 = 0 OR abs(value / 100 - 0.5) > 0.16")
def flt_drift(spark, sf):
    return table(spark, sf, "events").where((F.col("event_id") % 50 == 0) | (F.abs(F.col("value") / 100 - 0.5) > 0.16)).select("event_id")


@query("flt_reject_reasons", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'no duration' WHEN l_discount > 0.08 THEN 'no video' WHEN l_returnflag = 'R' THEN 'no audio' ELSE '' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL")
def flt_reject_reasons(spark, sf):
    reason = predicates.first_reason([("no duration", F.col("l_quantity") < 5), ("no video", F.col("l_discount") > 0.08), ("no audio", F.col("l_returnflag") == "R")])
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("prj_flag", f"WITH {_NOTES} SELECT doc_id, flag FROM cues")
def prj_flag(spark, sf):
    return predicates.with_annotation_columns(annotated(spark, sf)).select("doc_id", "flag")


@query("prj_edited", f"WITH {_NOTES} SELECT doc_id, edited FROM cues")
def prj_edited(spark, sf):
    return predicates.with_annotation_columns(annotated(spark, sf)).select("doc_id", "edited")


@query("prj_label", f"WITH {_NOTES} SELECT doc_id, label, CASE WHEN custom <> '' THEN 'custom' WHEN color <> '' THEN color ELSE 'none' END AS visual FROM cues")
def prj_label(spark, sf):
    return predicates.with_annotation_columns(annotated(spark, sf)).select("doc_id", "label", "visual")


@query("prj_default_title", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE 'Shot ' || lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY p_brand) AS VARCHAR)) AS INT), '0') END AS title FROM part")
def prj_default_title(spark, sf):
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("string")
    digits = F.length(F.count("*").over(Window.partitionBy("p_brand")).cast("string"))
    title = F.concat(F.lit("Shot "), F.lpad(number, digits, F.lit("0")))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(title).alias("title"))


@query("prj_clip", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE greatest(o_orderkey % 500 - o_custkey % 300, 0) END AS duration FROM orders")
def prj_clip(spark, sf):
    end = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 500 + 1)
    start = F.col("o_custkey") % 300 + 1
    return table(spark, sf, "orders").select("o_orderkey", F.when(end <= 0, F.lit(1000)).otherwise(F.greatest(end - start, F.lit(0))).cast("long").alias("duration"))


@query("prj_media_info", "SELECT p_partkey, CAST(p_size * 16 AS VARCHAR) || 'x' || CAST(p_size * 9 AS VARCHAR) || CASE WHEN p_size % 5 = 0 THEN ' (4:3)' ELSE '' END AS video, CAST(p_size * 1000 AS VARCHAR) || ' Hz - ' || CASE WHEN regexp_matches(lower(p_type), '^(s|p)') THEN 'Uncompressed' ELSE 'Compressed' END || ' - ' || CASE p_size % 3 WHEN 0 THEN 'Mono' WHEN 1 THEN 'Stereo' ELSE CAST(p_size % 8 AS VARCHAR) || ' channels' END AS audio FROM part")
def prj_media_info(spark, sf):
    size = F.col("p_size")
    video = F.concat((size * 16).cast("string"), F.lit("x"), (size * 9).cast("string"), F.when(size % 5 == 0, " (4:3)").otherwise(""))
    kind = F.when(F.regexp_like(F.lower("p_type"), F.lit("^(s|p)")), "Uncompressed").otherwise("Compressed")
    channels = F.when(size % 3 == 0, "Mono").when(size % 3 == 1, "Stereo").otherwise(F.concat((size % 8).cast("string"), F.lit(" channels")))
    return table(spark, sf, "part").select("p_partkey", video.alias("video"), F.concat_ws(" - ", F.concat((size * 1000).cast("string"), F.lit(" Hz")), kind, channels).alias("audio"))


@query("chk_ranges", "SELECT p_partkey, p_size BETWEEN 1 AND 40 AS fine, least(greatest(p_size, 5), 20) AS held FROM part")
def chk_ranges(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").between(1, 40).alias("fine"), F.least(F.greatest(F.col("p_size"), F.lit(5)), F.lit(20)).alias("held"))


# ---- aggregations ----------------------------------------------------------------------------

@query("agg_merge_cues", """WITH c AS (SELECT conv_id AS track_id, turn, role, (turn // 2) * 2000000 AS start_us FROM conversations),
g AS (SELECT track_id, start_us, count(*) AS n_merged, min(turn) AS first FROM c GROUP BY ALL),
s AS (SELECT track_id, start_us, string_agg(role, ' / ' ORDER BY seen, role) AS speaker FROM (SELECT track_id, start_us, role, min(turn) AS seen FROM c GROUP BY ALL) GROUP BY ALL)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_us) - 1 AS sequence, start_us, n_merged, speaker FROM g JOIN s USING (track_id, start_us)""")
def agg_merge_cues(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("track_id"), "turn", "role", (F.expr("turn div 2") * 2_000_000).alias("start_us"))
    merged = rows.groupBy("track_id", "start_us").agg(F.count("*").alias("n_merged"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("start_us")) - 1
    return merged.select("track_id", number.cast("long").alias("sequence"), "start_us", "n_merged", fx.merge_distinct(F.col("t.role")).alias("speaker"))


@query("agg_keyword_direct", "SELECT o_custkey AS keyword, count(DISTINCT o_orderkey) AS n_shots FROM orders GROUP BY 1")
def agg_keyword_direct(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("keyword")).agg(F.count_distinct("o_orderkey").alias("n_shots"))


@query("agg_coverage", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = count(*) THEN 'all' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'some' ELSE 'none' END AS coverage FROM orders GROUP BY 1")
def agg_coverage(spark, sf):
    n = F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(n == F.count("*"), "all").when(n > 0, "some").otherwise("none").alias("coverage"))


@query("agg_sum_duration", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def agg_sum_duration(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("agg_weighted_avg", "SELECT l_orderkey, sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(greatest(l_quantity, 1) AS BIGINT)) / greatest(sum(CAST(greatest(l_quantity, 1) AS BIGINT)), 1) AS progress FROM lineitem GROUP BY 1")
def agg_weighted_avg(spark, sf):
    w = F.greatest(F.col("l_quantity"), F.lit(1.0)).cast("long")
    percent = F.round(F.col("l_discount") * 100).cast("long")  # whole numbers add up alike in any order
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(percent * w) / F.greatest(F.sum(w), F.lit(1).cast("long"))).alias("progress"))


@query("agg_interval_coverage", """SELECT user_id, min(greatest(value, 20)) - 20 AS first, max(least(value + 5, 80)) - 20 AS last FROM events WHERE value < 80 AND value + 5 > 20 GROUP BY user_id HAVING max(least(value + 5, 80)) - min(greatest(value, 20)) >= 1""")
def agg_interval_coverage(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").where((v < 80) & (v + 5 > 20)).groupBy("user_id").agg(F.min(F.greatest(v, F.lit(20.0))).alias("a"), F.max(F.least(v + 5, F.lit(80.0))).alias("b"))
    return rows.where("b - a >= 1").select("user_id", (F.col("a") - 20).alias("first"), (F.col("b") - 20).alias("last"))


@query("agg_laplacian_var", """WITH g AS (SELECT vec_id, CAST(e[r * 8 + c + 1] AS DOUBLE) * 4 - e[(r - 1) * 8 + c + 1] - e[(r + 1) * 8 + c + 1] - e[r * 8 + c] - e[r * 8 + c + 2] AS l FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64), range(1, 7) a(r), range(1, 7) b(c))
SELECT vec_id, round(v / (v + 1000), 6) AS detail FROM (SELECT vec_id, greatest(avg(l * l) - avg(l) * avg(l), 0) AS v FROM g GROUP BY 1)""")
def agg_laplacian_var(spark, sf):
    e = F.col("e")
    at = lambda r, c: F.get(e, r * 8 + c)
    cells = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda c: at(r, c) * 4 - at(r - 1, c) - at(r + 1, c) - at(r, c - 1) - at(r, c + 1))))
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", cells.alias("l"))
    mean = lambda f: F.aggregate("l", F.lit(0.0), f) / F.size("l")
    v = F.greatest(mean(lambda s, x: s + x * x) - F.pow(mean(lambda s, x: s + x), 2.0), F.lit(0.0))
    return rows.select("vec_id", F.round(v / (v + 1000), 6).alias("detail"))


@query("agg_trailing_gap", "SELECT l_orderkey, 50 - greatest(least(max(l_quantity), 50), 0) AS silence FROM lineitem GROUP BY 1")
def agg_trailing_gap(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((50 - F.greatest(F.least(F.max("l_quantity"), F.lit(50.0)), F.lit(0.0))).alias("silence"))


@query("agg_first_known", "SELECT o_custkey, coalesce(arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS first FROM orders GROUP BY 1")
def agg_first_known(spark, sf):
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("o_orderkey"))), F.lit(-1)).alias("first"))


@query("agg_max_suffix", r"SELECT p_type, max(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT)) AS most FROM part GROUP BY 1")
def agg_max_suffix(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.max(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")).alias("most"))


@query("agg_progress", "SELECT event_type, round(sum(top), 4) AS total FROM (SELECT event_type, user_id, max(value) AS top FROM events GROUP BY ALL) GROUP BY 1")
def agg_progress(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("top")).groupBy("event_type").agg(F.round(F.sum("top"), 4).alias("total"))


@query("agg_kind_counts", "SELECT c_mktsegment, count(*) FILTER (c_nationkey < 10) AS low, count(*) FILTER (c_nationkey >= 10) AS high FROM customer GROUP BY 1")
def agg_kind_counts(spark, sf):
    kind = F.when(F.col("c_nationkey") < 10, "low").otherwise("high")
    return table(spark, sf, "customer").withColumn("kind", kind).groupBy("c_mktsegment").pivot("kind", ["low", "high"]).count().na.fill(0)


@query("agg_union_sets", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS priorities FROM orders GROUP BY 1")
def agg_union_sets(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("agg_preferred", "SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) * 1000000000 + o_orderkey) AS preferred FROM orders GROUP BY 1")
def agg_preferred(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "O", F.col("o_orderkey"))).alias("preferred"))


# ---- windows, sorts, top-k -------------------------------------------------------------------

@query("win_running_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS most FROM events")
def win_running_max(spark, sf):
    return table(spark, sf, "events").select("event_id", F.max("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("most"))


@query("win_rank", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INT) AS place FROM customer")
def win_rank(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.rank().over(Window.partitionBy("c_mktsegment").orderBy("c_nationkey")).alias("place"))


@query("win_unique_names", "SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '-' || CAST(k - 1 AS VARCHAR) ELSE '' END || '.mp4' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)")
def win_unique_names(spark, sf):
    k = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("k", k).select("p_partkey", F.concat("p_name", F.when(F.col("k") > 1, F.concat(F.lit("-"), (F.col("k") - 1).cast("string"))).otherwise(""), F.lit(".mp4")).alias("file_name"))


@query("win_sequence", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS sequence FROM conversations")
def win_sequence(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).cast("long").alias("sequence"))


@query("win_islands", "SELECT user_id, count(*) AS n, max(event_id) - min(event_id) + 1 = count(*) AND count(*) >= 2 AS adjacent FROM events GROUP BY 1")
def win_islands(spark, sf):
    island = F.col("event_id") - F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf, "events").withColumn("island", island)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), ((F.count_distinct("island") == 1) & (F.count("*") >= 2)).alias("adjacent"))


@query("win_stream_ordinal", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def win_stream_ordinal(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")) - 1).cast("long").alias("ordinal"))


@query("win_range_select", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) SELECT p_partkey FROM r WHERE k BETWEEN 3 AND 7")
def win_range_select(spark, sf):
    return table(spark, sf, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))).where("k between 3 and 7").select("p_partkey")


@query("win_secretary", """WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT user_id, max(value) AS bar, arg_min(event_id, -value * 1e9 + event_id) AS best FROM r WHERE k <= least(greatest(ceil(0.37 * n), 1), n) GROUP BY 1)
SELECT p.user_id, coalesce(min(r.event_id) FILTER (r.k > least(greatest(ceil(0.37 * n), 1), n) AND r.value > p.bar), any_value(p.best)) AS chosen FROM p JOIN r USING (user_id) GROUP BY p.user_id""")
def win_secretary(spark, sf):
    by = Window.partitionBy("user_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", F.row_number().over(by.orderBy("event_id")).alias("k"), F.count("*").over(by).alias("n"))
    early = F.col("k") <= F.least(F.greatest(F.ceil(F.col("n") * 0.37), F.lit(1)), F.col("n"))
    rows = rows.withColumn("bar", F.max(F.when(early, F.col("value"))).over(by))
    best = F.min_by("event_id", F.when(early, F.struct(-F.col("value"), F.col("event_id"))))
    return rows.groupBy("user_id").agg(F.coalesce(F.min(F.when(~early & (F.col("value") > F.col("bar")), F.col("event_id"))), best).alias("chosen"))


@query("win_retention", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def win_retention(spark, sf):
    return sets.window_rank(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).where("k <= 3").select("o_orderkey")


@query("top_recent", "SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) ORDER BY d DESC, o_custkey LIMIT 10")
def top_recent(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d")).orderBy(F.desc("d"), "o_custkey").limit(10).select("o_custkey")


@query("top_recent_keywords", "SELECT o_custkey FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) ORDER BY k DESC LIMIT 18")
def top_recent_keywords(spark, sf):
    return table(spark, sf, "orders").where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).orderBy(F.desc("k")).limit(18).select("o_custkey")


@query("top_suggested", """WITH u AS (SELECT o_custkey AS id, count(*) AS usage, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-05-01') AS counter FROM orders GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY counter) AS rc, rank() OVER (ORDER BY usage) AS ru FROM u)
SELECT 'c:' || id AS keyword_id, 2 * rc + ru AS score, row_number() OVER (ORDER BY 2 * rc + ru DESC, counter DESC, usage DESC, id) AS position FROM r ORDER BY position LIMIT 18""")
def top_suggested(spark, sf):
    from cuelake.operators.ordering import competition_rank

    uses = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("usage"), F.count_if(F.col("o_orderdate") >= "2001-05-01").alias("counter"))
    ranked = competition_rank(competition_rank(uses, "counter", "rc"), "usage", "ru").withColumn("score", 2 * F.col("rc") + F.col("ru"))
    top = ranked.orderBy(F.desc("score"), F.desc("counter"), F.desc("usage"), "id").limit(18)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("counter"), F.desc("usage"), "id"))  # 18 rows
    return top.select(F.concat(F.lit("c:"), "id").alias("keyword_id"), "score", place.cast("long").alias("position"))


@query("top_bounded_history", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)")
def top_bounded_history(spark, sf):
    orders = table(spark, sf, "orders")
    done = orders.where("o_orderstatus <> 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)
    return orders.where("o_orderstatus = 'O'").select("o_orderkey").unionByName(done.select("o_orderkey"))


@query("top_history", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 39")
def top_history(spark, sf):
    return table(spark, sf, "events").select("event_id").orderBy(F.desc("event_id")).limit(39)


@query("top_mru", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1")
def top_mru(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))


@query("top_authority", "SELECT event_type, arg_max(event_id, (CASE WHEN value > 50 THEN 1 ELSE 0 END) * 1e12 + event_id) AS holder FROM events GROUP BY 1")
def top_authority(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct(F.col("value") > 50, F.col("event_id"))).alias("holder"))


# ---- sets ------------------------------------------------------------------------------------

def _pairs(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))).alias("b"))


_SETS = "s AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O')), []) AS a, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')), []) AS b FROM orders GROUP BY 1)"


def _text(c):
    return F.array_join(F.array_sort(c), "|")


@query("set_union", f"WITH {_SETS} SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS members FROM s")
def set_union(spark, sf):
    return _pairs(spark, sf).select("o_custkey", _text(sets.union_distinct(F.col("a"), F.col("b"))).alias("members"))


@query("set_except", f"WITH {_SETS} SELECT o_custkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS members FROM s")
def set_except(spark, sf):
    return _pairs(spark, sf).select("o_custkey", _text(F.array_except("a", "b")).alias("members"))


@query("set_symdiff", f"WITH {_SETS} SELECT o_custkey, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), '|') AS members FROM s")
def set_symdiff(spark, sf):
    return _pairs(spark, sf).select("o_custkey", _text(sets.symmetric_difference(F.col("a"), F.col("b"))).alias("members"))


@query("set_equal", f"WITH {_SETS} SELECT o_custkey, a = b AS equal FROM s")
def set_equal(spark, sf):
    return _pairs(spark, sf).select("o_custkey", sets.same_set(F.col("a"), F.col("b")).alias("equal"))


@query("set_intersect", f"WITH {_SETS} SELECT o_custkey, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), '|') AS members FROM s")
def set_intersect(spark, sf):
    return _pairs(spark, sf).select("o_custkey", _text(F.array_intersect("a", "b")).alias("members"))


@query("set_distinct", "SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1")
def set_distinct(spark, sf):
    rows = table(spark, sf, "part").select("p_name", "p_partkey")
    return sets.first_by_key(rows, F.col("p_name"), F.col("p_partkey")).select("p_name", F.col("p_partkey").alias("first"))


@query("set_union_all", "SELECT c_custkey AS id, c_custkey AS position FROM customer UNION ALL SELECT s_suppkey, s_suppkey + (SELECT max(c_custkey) + 1 FROM customer) FROM supplier")
def set_union_all(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("position"))
    return sets.append_rows(a, b, "position")


@query("set_editor_commit", "SELECT user_id, event_type, arg_max(value > 50, event_id) AS forced FROM events GROUP BY ALL")
def set_editor_commit(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.col("value") > 50).alias("forced"))
    return sets.latest_flags(rows, ["user_id"], "event_type", "event_id", "forced")
