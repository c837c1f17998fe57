"""Queries for edits (P), versions and documents (A12, A15, P10), names (I13, I15), checks (C), orders (G) and streams (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as fx
from cuelake.operators import documents, edits, ordering, predicates, sets
from cuelake.plans.catalog import query
from cuelake.session import stream_table, table
from cuelake.sources import sinks
from cuelake.streaming import rules, timed

# ---- keywords, stacks, items -----------------------------------------------------------------


@query("dml_keywords", """WITH a AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN [] WHEN o_orderkey % 3 = 1 THEN ['k' || (o_custkey % 4)] ELSE list_sort(list_distinct(['k' || (o_custkey % 4), 'k' || (o_custkey % 5)])) END AS k FROM orders),
c AS (SELECT *, 'k' || (item % 4) AS g FROM a WHERE item % 2 = 0)
SELECT item, 'append' AS mode, array_to_string(list_sort(list_distinct(list_append(k, g))), '|') AS keywords, NOT list_contains(k, g) AS changed FROM c
UNION ALL SELECT item, 'off', array_to_string(list_filter(k, lambda x: x <> g), '|'), list_contains(k, g) FROM c
UNION ALL SELECT item, 'set', g, k <> [g] FROM c
UNION ALL SELECT item, m, array_to_string(k, '|'), FALSE FROM a, (VALUES ('append'), ('off'), ('set')) v(m) WHERE item % 2 = 1""")
def dml_keywords(spark, sf):
    first, second = (F.concat(F.lit("k"), (F.col("o_custkey") % n).cast("string")) for n in (4, 5))
    held = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(first)).otherwise(F.array_sort(F.array_distinct(F.array(first, second))))
    annotations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), held.alias("keywords"))
    chosen = annotations.where("item % 2 = 0").select("item", F.array(F.concat(F.lit("k"), (F.col("item") % 4).cast("string"))).alias("given"))
    done = [edits.assign_keywords(annotations, chosen, mode).select("item", F.lit(mode).alias("mode"), F.array_join("keywords", "|").alias("keywords"), "changed") for mode in ("append", "off", "set")]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("agg_decay_counter", """WITH RECURSIVE e AS (SELECT event_type, 'k' || (user_id % 4) AS keyword, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
w AS (SELECT event_type, CAST(0 AS BIGINT) AS k, [0, 0, 0, 0]::BIGINT[] AS c FROM e GROUP BY 1
    UNION ALL SELECT w.event_type, e.k, CASE WHEN list_sum(w.c) + 1 >= 100 THEN list_transform(w.c, lambda x, i: (x + CASE WHEN 'k' || (i - 1) = e.keyword THEN 1 ELSE 0 END) // 2) ELSE list_transform(w.c, lambda x, i: x + CASE WHEN 'k' || (i - 1) = e.keyword THEN 1 ELSE 0 END) END
    FROM w JOIN e ON e.event_type = w.event_type AND e.k = w.k + 1),
f AS (SELECT event_type, arg_max(c, k) AS c FROM w GROUP BY 1)
SELECT event_type, 'k' || (i - 1) AS keyword, c[i] AS counter FROM f, range(1, 5) r(i) WHERE c[i] > 0""")
def agg_decay_counter(spark, sf):
    uses = table(spark, sf, "events").select("event_type", "event_id", F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")).alias("keyword"))
    return edits.decayed_counters(uses, "event_type", "event_id", "keyword")


def _stacks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(board, ord, item) of all orders, and stacks of each customer's finished ones on its board."""
    items = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("board"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("i"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("item"), "o_custkey", "o_orderstatus")
    members = items.where("o_orderstatus = 'F'")
    many = members.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("item").alias("stack")).where("n > 1")
    return items.select("board", "ord", "item"), members.join(many, "o_custkey").select("board", "stack", "ord", "item")


_STACKS = """i AS (SELECT o_custkey % 40 AS board, o_orderkey AS ord, 'i' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS item, o_custkey, o_orderstatus FROM orders),
s AS (SELECT board, min(item) OVER (PARTITION BY o_custkey) AS stack, ord, item, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM i WHERE o_orderstatus = 'F'),
st AS (SELECT * FROM s WHERE n > 1)"""


@query("dml_stacks", f"""WITH {_STACKS},
touched AS (SELECT DISTINCT board, stack FROM st WHERE ord % 97 = 0), inside AS (SELECT board, item FROM i WHERE ord % 97 = 0 UNION SELECT board, item FROM st JOIN touched USING (board, stack)),
boards AS (SELECT board, min(item) AS made FROM inside GROUP BY 1 HAVING count(*) > 1),
created AS (SELECT board, made AS stack, item FROM inside JOIN boards USING (board) UNION ALL SELECT board, stack, item FROM st WHERE (board, stack) NOT IN (SELECT (t.board, t.stack) FROM touched t JOIN boards USING (board))),
cut AS (SELECT board, stack, min(k) AS c FROM st WHERE ord % 5 = 0 GROUP BY ALL),
parts AS (SELECT st.*, coalesce(c, 1000000) AS c, CASE WHEN k >= c THEN 1 ELSE 0 END AS part FROM st LEFT JOIN cut USING (board, stack)),
split AS (SELECT board, min(item) OVER g AS stack, item, count(*) OVER g AS n FROM parts WINDOW g AS (PARTITION BY board, stack, part)),
taken AS (SELECT board, min(item) OVER g AS stack, item, count(*) OVER g AS n FROM parts WHERE k <> c WINDOW g AS (PARTITION BY board, stack, part)),
cancelled AS (SELECT board, stack, item FROM st WHERE (board, stack) NOT IN (SELECT (board, stack) FROM touched))
SELECT 'create' AS edit, * FROM created UNION ALL SELECT 'cancel', * FROM cancelled UNION ALL SELECT 'split', board, stack, item FROM split WHERE n > 1 UNION ALL SELECT 'remove', board, stack, item FROM taken WHERE n > 1""")
def dml_stacks(spark, sf):
    items, stacks = _stacks(spark, sf)
    chosen, at = items.where("ord % 97 = 0"), items.where("ord % 5 = 0")
    # of a stack's chosen items the first is where it is split
    done = {"create": edits.create_stack(stacks, items, chosen), "cancel": edits.cancel_stacks(stacks, chosen), "split": edits.split_stacks(stacks, at), "remove": edits.split_stacks(stacks, at, drop=True)}
    parts = [rows.select(F.lit(name).alias("edit"), "board", "stack", "item") for name, rows in done.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("dml_items", """WITH v AS (SELECT 'v' || o_orderkey AS id, 'video' AS kind, CAST(NULL AS VARCHAR) AS bound_to, o_orderstatus <> 'P' AS enabled FROM orders),
c AS (SELECT DISTINCT 'c' || l_orderkey || '-' || l_partkey AS id, 'audio' AS kind, 'v' || l_orderkey AS bound_to FROM lineitem), x AS (SELECT * FROM v UNION ALL SELECT *, TRUE FROM c),
m AS (SELECT *, id LIKE '%7' OR coalesce(bound_to LIKE '%7' AND bound_to IN (SELECT id FROM v), FALSE) AS off, id LIKE '%7' AS chosen FROM x)
SELECT FALSE AS switched_to, id, kind, CASE WHEN off THEN FALSE ELSE enabled END AS enabled, off AND enabled AS changed FROM m UNION ALL SELECT TRUE, id, kind, CASE WHEN chosen THEN TRUE ELSE enabled END, chosen AND NOT enabled FROM m""")
def dml_items(spark, sf):
    videos = table(spark, sf, "orders").select(F.concat(F.lit("v"), "o_orderkey").alias("id"), F.lit("video").alias("kind"), F.lit(None).cast("string").alias("bound_to"), (F.col("o_orderstatus") != "P").alias("enabled"))
    bound = table(spark, sf, "lineitem").select(F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_partkey").alias("id"), F.lit("audio").alias("kind"), F.concat(F.lit("v"), "l_orderkey").alias("bound_to"), F.lit(True).alias("enabled")).distinct()
    items = videos.unionByName(bound)
    chosen = items.where("id like '%7'")
    switch = lambda on: edits.set_enabled(items, chosen, on).select(F.lit(on).alias("switched_to"), "id", "kind", "enabled", "changed")
    return switch(False).unionByName(switch(True))


@query("set_reconcile", """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS old, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')), []) AS shared, ['1-URGENT', '2-HIGH'] AS typed, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P')), []) AS kept FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(old, lambda x: NOT (list_contains(shared, x) AND NOT list_contains(typed, x))), list_filter(typed, lambda x: NOT list_contains(kept, x))))), '|') AS members FROM s""")
def set_reconcile(spark, sf):
    of = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("old"), of("F").alias("shared"), of("P").alias("kept"))
    typed = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return rows.select("o_custkey", F.array_join(F.array_sort(sets.reconcile(F.col("old"), F.col("shared"), typed, F.col("kept"))), "|").alias("members"))


# ---- names -----------------------------------------------------------------------------------

_CLEAN = r"""regexp_replace(trim(regexp_replace(b, '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g')), '[. ]+$', '')"""


@query("fn_export_names", rf"""WITH b AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE repeat(p_name || ':', 12) END AS b FROM part),
c AS (SELECT *, left({_CLEAN}, 116) AS base FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(base) ORDER BY p_partkey) - 1 AS k FROM c),
u AS (SELECT *, CASE WHEN k > 0 THEN '-' || k ELSE '' END AS tail FROM n)
SELECT p_partkey, left(base, least(length(base), CAST(116 - length(tail) AS BIGINT))) || tail || CASE WHEN p_brand < 'Brand#3' THEN '.MP4' ELSE '.mp4' END AS file_name FROM u""")
def fn_export_names(spark, sf):
    base = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE repeat(concat(p_name, ':'), 12) END")
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    return edits.export_names(rows, ["p_brand"], "p_partkey", base, F.lit("mp4"), F.col("p_brand") < "Brand#3").select("p_partkey", "file_name")


@query("fn_next_free", """WITH taken AS (SELECT DISTINCT p_name || '-' || (p_partkey % 4) || '.mp4' AS name FROM part), asked AS (SELECT DISTINCT p_name || '.mp4' AS name, p_name AS stem FROM part UNION SELECT DISTINCT p_type, p_type FROM part)
SELECT a.name, min(CASE WHEN a.name LIKE '%.mp4' THEN a.stem || '-' || n || '.mp4' ELSE a.name || '-' || n END) AS free FROM asked a, range(1, 8) r(n)
WHERE CASE WHEN a.name LIKE '%.mp4' THEN a.stem || '-' || n || '.mp4' ELSE a.name || '-' || n END NOT IN (SELECT name FROM taken) GROUP BY 1""")
def fn_next_free(spark, sf):
    part = table(spark, sf, "part")
    taken = part.select(F.concat("p_name", F.lit("-"), F.col("p_partkey") % 4, F.lit(".mp4")).alias("name"))
    asked = part.select(F.concat("p_name", F.lit(".mp4")).alias("name")).unionByName(part.select(F.col("p_type").alias("name"))).distinct()
    return edits.next_free_names(asked, taken, start=1)


# ---- settings, checks, codes -----------------------------------------------------------------


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings made of parts, with nulls and impossible mixes."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", pick(6, "mp4_h264", "mp4_hevc", "mov_prores", "webm_vp9", "mp3_audio", "aac_audio").alias("container"), pick(4, True, False, None).alias("include_video"), pick(5, True, False, None).alias("include_audio"),
        pick(7, "aac", "mp2", "mp3", "opus").alias("audio_codec"), pick(3, "ask", None).alias("existing_file_mode"), pick(8, 1, None, 7).alias("start_number"),
        pick(9, " ", "/out").alias("output_dir"), pick(11, "", "clip").alias("output_stem"), pick(2, "custom", "source").alias("resolution"), (k % 13).cast("int").alias("custom_width"), (k % 5).cast("int").alias("custom_height"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise((k % 150).cast("double")).alias("frame_rate"), pick(6, None, 48000, 7999, 192000, 192001).alias("sample_rate"),
    )


_SETTINGS = """s AS (SELECT p_partkey, ['mp4_h264', 'mp4_hevc', 'mov_prores', 'webm_vp9', 'mp3_audio', 'aac_audio'][p_partkey % 6 + 1] AS container, [TRUE, FALSE, NULL][p_partkey % 4 + 1] AS include_video, [TRUE, FALSE, NULL][p_partkey % 5 + 1] AS include_audio,
    ['aac', 'mp2', 'mp3', 'opus'][p_partkey % 7 + 1] AS audio_codec, ['ask', NULL][p_partkey % 3 + 1] AS existing_file_mode, [1, NULL, 7][p_partkey % 8 + 1] AS start_number, [' ', '/out'][p_partkey % 9 + 1] AS output_dir, ['', 'clip'][p_partkey % 11 + 1] AS output_stem,
    ['custom', 'source'][p_partkey % 2 + 1] AS resolution, p_partkey % 13 AS custom_width, p_partkey % 5 AS custom_height, CASE WHEN p_partkey % 7 = 0 THEN 'nan'::DOUBLE ELSE p_partkey % 150 END AS frame_rate, [NULL, 48000, 7999, 192000, 192001][p_partkey % 6 + 1] AS sample_rate FROM part)"""


@query("prj_settings_repair", f"""WITH {_SETTINGS}, r AS (SELECT *, container IN ('mp3_audio', 'aac_audio') AS mono FROM s), q AS (SELECT *, CASE WHEN mono THEN TRUE ELSE coalesce(include_audio, TRUE) END AS a, CASE WHEN mono THEN FALSE ELSE coalesce(include_video, TRUE) END AS v FROM r)
SELECT p_partkey, v OR NOT a AS include_video, a AS include_audio, CASE container WHEN 'mp3_audio' THEN 'mp3' WHEN 'aac_audio' THEN 'aac' ELSE audio_codec END AS audio_codec, coalesce(existing_file_mode, 'ask') AS existing_file_mode, coalesce(start_number, 1) AS start_number FROM q""")
def prj_settings_repair(spark, sf):
    return edits.repaired_settings(_settings(spark, sf)).select("p_partkey", "include_video", "include_audio", "audio_codec", "existing_file_mode", "start_number")


@query("chk_options", f"""WITH {_SETTINGS}, d AS (SELECT *, coalesce(include_video, TRUE) AS v, coalesce(include_audio, TRUE) AS a FROM s)
SELECT p_partkey, rule FROM d, (VALUES ('directory'), ('stem'), ('streams'), ('container'), ('dimensions'), ('frame rate'), ('codec'), ('sample rate')) x(rule) WHERE CASE rule WHEN 'directory' THEN trim(coalesce(output_dir, '')) = '' WHEN 'stem' THEN trim(coalesce(output_stem, '')) = '' WHEN 'streams' THEN NOT v AND NOT a
    WHEN 'container' THEN container IN ('mp3_audio', 'aac_audio') AND v WHEN 'dimensions' THEN v AND resolution = 'custom' AND (custom_width < 2 OR custom_height < 2) WHEN 'frame rate' THEN v AND (isnan(frame_rate) OR NOT frame_rate BETWEEN 1 AND 120)
    WHEN 'codec' THEN a AND NOT CASE container WHEN 'webm_vp9' THEN coalesce(audio_codec = 'opus', FALSE) WHEN 'mp3_audio' THEN coalesce(audio_codec = 'mp3', FALSE) WHEN 'aac_audio' THEN coalesce(audio_codec = 'aac', FALSE) ELSE coalesce(audio_codec IN ('aac', 'mp2', 'mp3'), FALSE) END
    ELSE coalesce(NOT sample_rate BETWEEN 8000 AND 192000, FALSE) END""")
def chk_options(spark, sf):
    rows = _settings(spark, sf).withColumns({"include_video": F.coalesce("include_video", F.lit(True)), "include_audio": F.coalesce("include_audio", F.lit(True))})
    return predicates.violations(rows, predicates.export_rules()).select("p_partkey", "rule")


@query("chk_output_tolerance", """WITH o AS (SELECT event_id, user_id % 3 <> 0 AS want_video, user_id % 2 = 0 AS want_audio, event_type <> 'click' AS has_video, value > 50 AS has_audio, CAST(event_id % 40 AS BIGINT) * 20000 - 20000 AS duration_us, 400000 AS expected_us FROM events)
SELECT event_id, CASE WHEN want_video <> has_video OR want_audio <> has_audio THEN 'streams' WHEN duration_us <= 0 THEN 'no duration' WHEN abs(duration_us - expected_us) > 200000 THEN 'duration' ELSE '' END AS reason FROM o""")
def chk_output_tolerance(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3 != 0).alias("want_video"), (F.col("user_id") % 2 == 0).alias("want_audio"), (F.col("event_type") != "click").alias("has_video"), (F.col("value") > 50).alias("has_audio"), (F.col("event_id") % 40 * 20000 - 20000).alias("duration_us"))
    return e.select("event_id", predicates.output_fault(F.lit(400_000)).alias("reason"))


@query("join_codec_matrix", """WITH m(container, quality, code) AS (VALUES ('mp4_h264', 'low', 28), ('mp4_h264', 'medium', 23), ('mp4_h264', 'high', 20), ('mp4_h264', 'very_high', 17), ('mp4_hevc', 'low', 28), ('mp4_hevc', 'medium', 23), ('mp4_hevc', 'high', 20), ('mp4_hevc', 'very_high', 17),
    ('webm_vp9', 'low', 40), ('webm_vp9', 'medium', 34), ('webm_vp9', 'high', 28), ('webm_vp9', 'very_high', 24)), p(quality, profile) AS (VALUES ('low', 0), ('medium', 2), ('high', 3), ('very_high', 3)),
s(container, speed, args) AS (VALUES ('mp4', 'fast', '-preset veryfast'), ('mp4', 'balanced', '-preset medium'), ('mp4', 'quality', '-preset slow'), ('webm', 'fast', '-deadline good -cpu-used 8'), ('webm', 'balanced', '-deadline good -cpu-used 4'), ('webm', 'quality', '-deadline best -cpu-used 2')),
r AS (SELECT p_partkey, ['mp4_h264', 'mp4_hevc', 'mov_prores', 'webm_vp9', 'mp3_audio'][p_partkey % 5 + 1] AS container, ['low', 'medium', 'high', 'very_high'][p_size % 4 + 1] AS quality, ['fast', 'balanced', 'quality'][p_size % 3 + 1] AS speed FROM part)
SELECT p_partkey, coalesce(code, 0) AS crf, CASE WHEN r.container = 'mov_prores' THEN profile END AS profile, coalesce(args, '') AS speed_args FROM r LEFT JOIN m USING (container, quality) JOIN p USING (quality) LEFT JOIN s ON s.container = split_part(r.container, '_', 1) AND s.speed = r.speed""")
def join_codec_matrix(spark, sf):
    pick = lambda c, *values: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", pick("p_partkey", "mp4_h264", "mp4_hevc", "mov_prores", "webm_vp9", "mp3_audio").alias("container"), pick("p_size", "low", "medium", "high", "very_high").alias("quality"), pick("p_size", "fast", "balanced", "quality").alias("speed"))
    return predicates.encoder_codes(rows).select("p_partkey", "crf", "profile", "speed_args")


@query("agg_frame_score", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x + 1) * 127), 0), 255) AS INT)) AS v FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT vec_id, i, v[i + 1] AS red, v[(i + 21) % 64 + 1] AS green, v[(i + 42) % 64 + 1] AS blue FROM e, range(64) t(i)), g AS (SELECT *, (77 * red + 150 * green + 29 * blue) >> 8 AS y, ((red >> 4) << 8) | ((green >> 4) << 4) | (blue >> 4) AS bin FROM p),
l AS (SELECT c.vec_id, a.y + b.y + d.y + f.y - 4 * c.y AS l FROM g c JOIN g a ON a.vec_id = c.vec_id AND a.i = c.i - 8 JOIN g b ON b.vec_id = c.vec_id AND b.i = c.i - 1 JOIN g d ON d.vec_id = c.vec_id AND d.i = c.i + 1 JOIN g f ON f.vec_id = c.vec_id AND f.i = c.i + 8 WHERE c.i // 8 BETWEEN 1 AND 6 AND c.i % 8 BETWEEN 1 AND 6),
d AS (SELECT vec_id, greatest(sum(l * l) / 36.0 - pow(sum(l) / 36.0, 2), 0) AS v FROM l GROUP BY 1), h AS (SELECT vec_id, bin, count(*) / 64.0 AS q FROM g GROUP BY ALL), c AS (SELECT vec_id, -sum(q * log2(q)) AS h FROM h GROUP BY 1)
SELECT vec_id, round(0.6 * v / (v + 1000) + 0.4 * least(greatest(h / 12, 0), 1), 6) AS score FROM d JOIN c USING (vec_id)""")
def agg_frame_score(spark, sf):
    from cuelake.functions import mathx as mx

    v = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x + 1) * 127), F.lit(0)), F.lit(255)).cast("int"))
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", v.alias("v"))
    turned = lambda n: F.concat(F.slice("v", n + 1, 64 - n), F.slice("v", 1, n)) if n else F.col("v")
    frames = rows.select("vec_id", turned(0).alias("red"), turned(21).alias("green"), turned(42).alias("blue"))
    return frames.select("vec_id", F.round(mx.frame_score(F.col("red"), F.col("green"), F.col("blue"), 8, 8), 6).alias("score"))


# ---- orders ----------------------------------------------------------------------------------


@query("srt_cues", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS position FROM documents")
def srt_cues(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return ordering.positions(rows, F.col("lang"), F.col("doc_id")).select("doc_id", "position")


@query("srt_shots", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS position FROM part")
def srt_shots(spark, sf):
    # numbers inside names sort by value: the shown name is 'Shot 7 of N'
    rows = table(spark, sf, "part").select("p_partkey", fx.natural_key(F.concat(F.lit("Shot "), "p_size", F.lit(" of "), F.lit("N"))).alias("key"))
    return ordering.positions(rows, F.col("key").desc(), F.col("p_partkey")).select("p_partkey", "position")


@query("srt_priority", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'P', o_orderpriority, o_orderkey) - 1 AS position FROM orders")
def srt_priority(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ordering.positions(rows, F.col("o_orderstatus") == "P", F.col("o_orderpriority"), F.col("o_orderkey")).select("o_orderkey", "position")


@query("srt_locale", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_brand), p_brand DESC, p_partkey) - 1 AS position FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS p_brand FROM part)")
def srt_locale(spark, sf):
    # a locale puts small letters before capitals of the same word, and both before the next word
    label = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", F.collate(label, "UNICODE").alias("label"))
    return ordering.positions(rows, F.col("label"), F.col("p_partkey")).select("p_partkey", "position")


@query("srt_tree", """WITH n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, n_nationkey AS ord, n_name AS name, TRUE AS folder, CAST(NULL AS DOUBLE) AS v FROM nation UNION ALL SELECT 'c' || c_custkey, 'r' || (c_custkey % 5), 1000 + c_custkey, c_name, FALSE, c_acctbal FROM customer)
SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY v IS NOT NULL, v DESC, CASE WHEN v IS NULL THEN CAST(regexp_extract(name, '([0-9]+)$', 1) AS INT) END, ord) - 1 AS place FROM n""")
def srt_tree(spark, sf):
    folders = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.lit(True).alias("is_folder"), F.lit(None).cast("double").alias("value"))
    files = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("r"), F.col("c_custkey") % 5).alias("parent"), (F.col("c_custkey") + 1000).alias("ord"), F.col("c_name").alias("name"), F.lit(False).alias("is_folder"), F.col("c_acctbal").alias("value"))
    return edits.sorted_siblings(folders.unionByName(files), "value", ascending=False)


# ---- documents and versions ------------------------------------------------------------------


@query("ver_upgrade", """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 BETWEEN 1 AND 4 THEN 4 ELSE c_custkey % 7 END AS version, CASE WHEN c_custkey % 7 BETWEEN 2 AND 6 THEN 'bin' || c_nationkey WHEN c_custkey % 7 = 0 THEN 'bin' || c_nationkey END AS bin,
CASE WHEN c_custkey % 7 BETWEEN 1 AND 2 THEN '{}' ELSE c_mktsegment END AS boards, CASE WHEN c_custkey % 7 BETWEEN 1 AND 3 THEN sha256(CAST(c_custkey AS VARCHAR)) WHEN c_custkey % 7 >= 4 THEN c_name END AS project_id,
CASE WHEN c_custkey % 7 > 4 THEN 'newer than supported' WHEN c_custkey % 7 = 0 THEN 'no complete migration chain' END AS error, c_custkey % 7 BETWEEN 1 AND 3 AS migrated FROM customer""")
def ver_upgrade(spark, sf):
    c = table(spark, sf, "customer").withColumn("version", (F.col("c_custkey") % 7).cast("int"))
    rows = c.select(F.col("c_custkey").alias("id"), "version", F.concat(F.lit("bin"), "c_nationkey").alias("bin"), F.col("c_mktsegment").alias("boards"), F.when(F.col("version") >= 4, F.col("c_name")).alias("project_id"))
    steps = {1: {"bin": F.lit(None)}, 2: {"boards": F.lit("{}")}, 3: {"project_id": F.sha2(F.col("id").cast("string"), 256)}}
    return documents.upgraded(rows, steps, 4).select("id", F.col("version").cast("long").alias("version"), "bin", "boards", "project_id", "error", "migrated")


@query("src_workspace_json", """WITH d AS (SELECT event_id, event_id % 6 AS v FROM events)
SELECT 'e' || event_id AS path, CASE WHEN v IN (0, 1, 2, 3, 4) THEN 4 ELSE 5 END AS version, CASE WHEN v = 4 THEN 'p' || event_id WHEN v < 4 AND v <> 0 THEN sha256('e' || event_id) END AS project_id, v BETWEEN 1 AND 3 AS migrated, CASE v WHEN 0 THEN 'malformed' WHEN 5 THEN 'newer than supported' END AS error FROM d""")
def src_workspace_json(spark, sf):
    v, id_ = F.col("event_id") % 6, F.col("event_id").cast("string")
    content = F.when(v == 0, "not json").when(v == 1, '{"workspace":{}}').when(v == 4, F.concat(F.lit('{"version":4,"project_id":"p'), id_, F.lit('","workspace":{}}'))).otherwise(F.concat(F.lit('{"version":'), v.cast("string"), F.lit(',"workspace":{}}')))
    files = table(spark, sf, "events").select(F.concat(F.lit("e"), id_).alias("path"), content.alias("content"))
    return documents.read_workspaces(files).select("path", F.col("version").cast("long").alias("version"), "project_id", "migrated", "error")


@query("cfg_event_model", "SELECT event_id, ['', 'malformed', 'unknown key', 'missing key', 'epsilon', 'features', 'coefficients', 'cost', 'softness', 'version'][event_id % 10 + 1] AS error FROM events")
def cfg_event_model(spark, sf):
    import json

    good = {
        "model_version": 1, "model_origin": "x", "epsilon": 1e-6, "robust_window_radius": 50, "candidate_probability_threshold": 0.1, "peak_radius": 2, "candidate_robust_threshold": 2.5, "event_probability_floor": 0.03, "event_relative_floor": 0.15,
        "event_robust_floor": 1.5, "event_boundary_patience": 2, "neighbor_radius": 2, "classifier": {"feature_order": documents.FEATURE_ORDER, "intercept": -2.5, "coefficients": [0.5] * 10}, "calibration": None,
        "false_positive_cost": 1.0, "false_negative_cost": 2.0, "minimum_event_distance": 3, "short_shot_midpoint": 2.0, "short_shot_softness": 2.0,
    }
    classifier = good["classifier"]
    files = [json.dumps(good), "{", json.dumps(good | {"more": 1}), json.dumps({k: v for k, v in good.items() if k != "epsilon"}), json.dumps(good | {"epsilon": 0.5}), json.dumps(good | {"classifier": classifier | {"feature_order": documents.FEATURE_ORDER[::-1]}})]
    files += [json.dumps(good | {"classifier": classifier | {"coefficients": [1.0]}}), json.dumps(good | {"false_negative_cost": 0}), json.dumps(good | {"short_shot_softness": -1}), json.dumps(good | {"model_version": 2})]
    rows = table(spark, sf, "events").select("event_id", F.get(F.array(*map(F.lit, files)), (F.col("event_id") % 10).cast("int")).alias("json"))
    return documents.model_errors(rows).select("event_id", F.coalesce("error", F.lit("")).alias("error"))


@query("fn_fingerprint", "SELECT doc_id, length(text) > 1000 AS long, sha256(CAST(doc_id AS VARCHAR) || ':' || left(text, 1000) || CASE WHEN length(text) > 1000 THEN right(text, 1000) ELSE '' END) AS shown FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM documents)")
def fn_fingerprint(spark, sf):
    from cuelake.sources import files as sources

    # the window is a parameter, so that short texts have a tail too; the times are the ids
    content = F.regexp_replace("text", "[^ -~]", "").cast("binary")
    rows = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    head = F.concat(F.col("doc_id").cast("string"), F.lit(":")).cast("binary")
    return rows.select("doc_id", (F.octet_length("content") > 1000).alias("long"), F.sha2(sources.fingerprinted(F.col("content"), head, 1000), 256).alias("shown"))


@query("src_frame_csv", """WITH f AS (SELECT user_id, event_id % 400 / 100.0 AS pts, 0.02 AS d, event_id % 9 = 0 AS bad FROM events)
SELECT user_id, count(*) AS frames, CAST(round(min(pts) * 1e6) AS BIGINT) AS first_us, CAST(round(max(pts + d) * 1e6) AS BIGINT) AS last_us FROM f WHERE NOT bad AND pts + d > 1.0 - 0.25 AND pts < 2.0 + 0.25 GROUP BY 1""")
def src_frame_csv(spark, sf):
    from cuelake.sources import files as sources

    pts = F.format_string("%.2f", F.col("event_id") % 400 / F.lit(100.0))
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("frame,N/A,"), pts)).otherwise(F.concat(F.lit("frame,"), pts, F.lit(",0.020000")))
    rows = sources.parse_frames(table(spark, sf, "events").select("user_id", line.alias("line")), 1_000_000, 2_000_000)
    return rows.groupBy("user_id").agg(F.count("*").alias("frames"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


# ---- cue files -------------------------------------------------------------------------------


def _cue_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content as bytes): a file for each conversation: SubRip, ASS, or one without cues."""
    plain = F.trim(F.regexp_replace("text", r"[\s{}<>\\-]+", " "))
    kind = F.col("conv_id") % 3
    at = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    srt = F.concat(F.lit("00:00:"), at, F.lit(",000 --> 00:00:"), at, F.lit(",500\n"), plain, F.lit("\n\n"))
    ass = F.concat(F.lit("Dialogue: 1,0:00:"), at, F.lit(".00,0:00:"), at, F.lit(".50,Main,"), "role", F.lit(",0,0,0,,"), plain, F.lit("\n"))
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "text", F.when(kind == 0, srt).otherwise(ass).alias("l")).alias("r"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["l"]), "").alias("body"))
    kind = F.col("conv_id") % 3
    body = F.when(kind == 0, F.col("body")).when(kind == 1, F.concat(F.lit("[Script Info]\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"), "body")).otherwise(F.lit("nothing here"))
    path = F.concat("conv_id", F.when(kind == 0, ".srt").when(kind == 1, ".ASS").otherwise(".vtt"))
    return files.select(path.alias("path"), body.cast("binary").alias("content"))


_TURNS = r"t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\s{}<>\\-]+', ' ', 'g')) AS plain FROM conversations)"


@query("src_subtitle_scan", f"""WITH {_TURNS} SELECT conv_id || ['.srt', '.ASS', '.vtt'][conv_id % 3 + 1] AS path, ['subrip', 'ass', 'webvtt'][conv_id % 3 + 1] AS codec, CASE WHEN conv_id % 3 = 2 THEN 0 ELSE count(*) FILTER (plain <> '') END AS n_cues,
CASE WHEN conv_id % 3 = 2 OR count(*) FILTER (plain <> '') = 0 THEN 'no cues' ELSE '' END AS notice FROM t GROUP BY conv_id""")
def src_subtitle_scan(spark, sf):
    from cuelake.sources.subtitles import scan

    cues, tracks = scan(_cue_files(spark, sf))
    return tracks.select("path", "codec", "n_cues", F.coalesce("notice", F.lit("")).alias("notice"))


@query("src_parse_ass", f"""WITH {_TURNS} SELECT conv_id || '.ASS' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, plain) - 1 AS sequence, turn % 60 * 1000000 AS start_us, turn % 60 * 1000000 + 500000 AS end_us, 1 AS layer, 'Main' AS style, role AS speaker FROM t WHERE plain <> '' AND conv_id % 3 = 1""")
def src_parse_ass(spark, sf):
    from cuelake.sources.subtitles import decode_text, parse_ass

    files = _cue_files(spark, sf).where("path like '%.ASS'").select("path", decode_text(F.col("content")).alias("content"))
    return parse_ass(files).select("path", "sequence", "start_us", "end_us", "layer", "style", "speaker")


@query("fn_decode_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[^ -~]', '', 'g') || 'ÿ' ELSE text END AS decoded FROM documents")
def fn_decode_text(spark, sf):
    from cuelake.sources.subtitles import decode_text

    # a byte 0xFF at the end is no UTF-8 and no multi-byte code either
    legacy = F.concat(F.regexp_replace("text", "[^ -~]", "").cast("binary"), F.unhex(F.lit("FF")))
    content = F.when(F.col("doc_id") % 3 == 0, legacy).otherwise(F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", decode_text(content).alias("decoded"))


# ---- streams ---------------------------------------------------------------------------------


@query("sink_autosave", """WITH RECURSIVE e AS (SELECT user_id, event_type AS p, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS s FROM e GROUP BY 1
    UNION ALL SELECT w.user_id, e.k, CASE WHEN coalesce(list_filter(w.s, lambda x: starts_with(x, e.p || ':'))[1] = e.p || ':' || e.h, FALSE) THEN w.s ELSE list_concat([e.p || ':' || e.h], list_filter(w.s, lambda x: x <> e.p || ':' || e.h))[1:3] END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1),
f AS (SELECT user_id, arg_max(s, k) AS s FROM w GROUP BY 1)
SELECT user_id, i - 1 AS place, s[i] AS snapshot FROM f, range(1, 4) r(i) WHERE i <= len(s)""")
def sink_autosave(spark, sf):
    saves = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("project"), (F.floor("value") % 3).cast("string").alias("digest"))
    out = rules.snapshots(saves, "user_id", "event_id", "project", "digest", 3)
    return out.select("user_id", "place", F.concat("project", F.lit(":"), "digest").alias("snapshot"))


_LINES = """e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 41 = 0 THEN 'progress=end' WHEN event_id % 5 = 0 THEN 'fps=3' ELSE 'u' END AS l, CASE WHEN event_id % 41 = 0 OR event_id % 5 = 0 THEN 0 ELSE CAST(floor(value * 100000) AS BIGINT) END AS us FROM events)"""


_PROGRESS = f"""{_LINES},
a AS (SELECT *, greatest(max(us) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS top, coalesce(max(us) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
b AS (SELECT *, coalesce(max(CASE WHEN top > before THEN t END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(t) OVER (PARTITION BY user_id ORDER BY k)) AS last FROM a),
c AS (SELECT *, t - last >= CASE WHEN before >= 9900000 THEN 180000000 ELSE 28000000 END AS over, l = 'progress=end' AS ends FROM b),
d AS (SELECT *, coalesce(sum(CASE WHEN over OR ends THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, least(top / 10000000.0, 1) AS p FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM d WHERE closed = 0 AND NOT over AND NOT ends),
w AS (SELECT user_id, n, p AS told, TRUE AS kept FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, CASE WHEN o.p >= w.told + 0.05 THEN o.p ELSE w.told END, o.p >= w.told + 0.05 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)"""
_TOLD = """SELECT user_id, event_id, 'progress' AS kind, round(p, 6) AS progress FROM w JOIN o USING (user_id, n) WHERE kept UNION ALL SELECT user_id, event_id, CASE WHEN over THEN 'stalled' ELSE 'end' END, round(p, 6) FROM d WHERE closed = 0 AND (over OR ends)"""


def _tool_lines(events):
    # the tables' events are hours apart, so a millisecond stands for a second
    events = events.withColumn("ts", F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000")))
    n = F.col("event_id")
    line = F.when(n % 41 == 0, "progress=end").when(n % 5 == 0, "fps=3").otherwise(F.concat(F.lit("out_time_us="), F.floor(F.col("value") * 100000).cast("string")))
    return events.select("user_id", "event_id", "ts", line.alias("line"), F.lit(10_000_000).cast("long").alias("duration"))


@query("str_progress", f"WITH RECURSIVE {_PROGRESS} {_TOLD}")
def str_progress(spark, sf):
    rows = rules.progress(_tool_lines(table(spark, sf, "events")), "user_id", "event_id", "ts", "line", "duration", least=0.05)
    return rows.select("user_id", "event_id", "kind", F.round("progress", 6).alias("progress"))


_DAILY = "(SELECT * REPLACE (user_id * 1000 + dayofyear(ts) AS user_id) FROM events))"


@query("str_progress_stream", f"""WITH RECURSIVE {_PROGRESS.replace("events)", _DAILY)},
l AS (SELECT user_id, max(top) AS top, coalesce(max(CASE WHEN top > before THEN t END), min(t)) AS rose, sum(CASE WHEN over OR ends THEN 1 ELSE 0 END) AS shut FROM c GROUP BY 1)
{_TOLD} UNION ALL SELECT user_id, NULL, 'stalled', round(least(top / 10000000.0, 1), 6) FROM l WHERE shut = 0 AND (rose + CASE WHEN top >= 9900000 THEN 180000000 ELSE 28000000 END + 999) // 1000 <= (SELECT max(t) // 1000 FROM e)""")
def str_progress_stream(spark, sf):
    """Each user's lines of a day as a job, read as a stream: timers also tell the jobs that fall silent."""
    events = stream_table(spark, sf, "events").withColumn("user_id", F.col("user_id") * 1000 + F.dayofyear("ts"))
    rows = timed.watched_progress(_tool_lines(events), "user_id", "event_id", "ts", "line", "duration", least=0.05)
    out = timed.read_all(rows, sinks.shared_folder(spark, "progress"))
    return out.select("user_id", "event_id", "kind", F.round("progress", 6).alias("progress"))


@query("str_retry", """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value > 60 AS good FROM events), t AS (SELECT * FROM a WHERE k <= 3), f AS (SELECT user_id, min(k) FILTER (good) AS first, max(k) AS last FROM t GROUP BY 1)
SELECT user_id, coalesce(first, last) AS attempts, first IS NOT NULL AS done, coalesce(first, last) > 1 AS cpu_only FROM f""")
def str_retry(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    attempts = table(spark, sf, "events").select("user_id", k.alias("attempt"), (F.col("value") > 60).alias("good"))
    return rules.retried(attempts, "user_id", "attempt", "good")


@query("str_throttle_frames", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM events),
w AS (SELECT user_id, k, p AS told, k AS place, TRUE AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.p >= w.told + 0.25 AND e.k - w.place >= 25 THEN e.p ELSE w.told END, CASE WHEN e.p >= w.told + 0.25 AND e.k - w.place >= 25 THEN e.k ELSE w.place END, e.p >= w.told + 0.25 AND e.k - w.place >= 25 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, k FROM w WHERE kept""")
def str_throttle_frames(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = rules.running_max(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", k.alias("k"), "progress")
    return rules.throttled(rows, "user_id", "k", "progress", 0.25, apart=25).select("user_id", "k")
