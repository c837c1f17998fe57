"""Queries for byte sources and sinks (A, B), layouts (C20, M14) and states of items and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import mathx as mx
from cuelake.operators import documents, layouts, predicates
from cuelake.plans.catalog import query
from cuelake.session import table
from cuelake.sources import commits, files, sinks
from cuelake.streaming import rules

_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


def _ascii(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): each document's printable ASCII characters as bytes."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.regexp_replace("text", "[^ -~]", "").cast("binary").alias("content"))


@query("src_fixed_frames", f"""SELECT doc_id AS path, CAST(k AS BIGINT) AS record, substr(t, CAST(k * 97 + 1 AS INT), 97) AS bytes, length(t) >= (k + 1) * 97 AS complete FROM (SELECT doc_id, {_ASCII} AS t FROM documents), LATERAL (SELECT unnest(range(CAST(ceil(length(t) / 97.0) AS INT))) AS k)""")
def src_fixed_frames(spark, sf):
    return files.fixed_records(_ascii(spark, sf), 97).withColumn("bytes", F.col("bytes").cast("string"))


@query("src_pcm_window", r"""WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 7999 ELSE 48000 END AS rate, CASE WHEN event_id % 5 = 0 THEN 19999 ELSE 20000 END AS d, (event_id % 4) * 4 AS size, event_id * 1000 - 5000 AS start FROM events),
h AS (SELECT *, lpad(hex(CAST(greatest(start, 0) AS UBIGINT)), 16, '0') AS s FROM r)
SELECT event_id, CASE WHEN rate = 7999 THEN 'rate' WHEN d < 20000 THEN 'duration' WHEN size % 8 <> 0 THEN 'unaligned' ELSE '' END AS error,
CASE WHEN rate = 48000 AND d = 20000 AND size % 8 = 0 THEN '4C50434D' || '80BB0000' || '02000000' || substr(s, 15, 2) || substr(s, 13, 2) || substr(s, 11, 2) || substr(s, 9, 2) || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2) || CASE WHEN size = 0 THEN '00000000' ELSE '01000000' END || repeat('00', CAST(size AS INT)) ELSE '' END AS payload FROM h""")
def src_pcm_window(spark, sf):
    n = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(n % 7 == 0, 7999).otherwise(48000).alias("rate"), F.when(n % 5 == 0, 19999).otherwise(20000).alias("duration_us"), (n * 1000 - 5000).alias("start_us"),
        F.unhex(F.repeat(F.lit("00"), (n % 4 * 4).cast("int"))).alias("samples"),
    )
    return files.pcm_windows(rows).select("event_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.hex("payload"), F.lit("")).alias("payload"))


@query("src_probe_json", """WITH f AS (SELECT o_orderkey AS path, CAST(o_orderkey % 900 AS DOUBLE) + 0.5 AS duration FROM orders WHERE o_orderkey % 4 <> 3)
SELECT path, duration, k AS index, ['video', 'audio'][k + 1] AS codec_type, ['h264', 'aac'][k + 1] AS codec_name, CASE WHEN k = 1 THEN path % 6 + 1 END AS channels, CASE WHEN k = 0 THEN 1920 END AS width, CASE WHEN k = 1 AND path % 2 = 0 THEN 'de' END AS language, k = 1 AND path % 3 = 0 AS is_default FROM f, range(2) t(k)""")
def src_probe_json(spark, sf):
    n = F.col("o_orderkey")
    video = F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(None).cast("long").alias("channels"), F.lit(1920).cast("long").alias("width"), F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("map<string,int>").alias("disposition"))
    tags = F.when(n % 2 == 0, F.create_map(F.when(n % 4 == 0, "LANGUAGE").otherwise("language"), F.lit("de")))
    audio = F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), (n % 6 + 1).alias("channels"), F.lit(None).cast("long").alias("width"), tags.alias("tags"), F.create_map(F.lit("default"), F.when(n % 3 == 0, 1).otherwise(0)).alias("disposition"))
    doc = F.to_json(F.struct(F.struct((n % 900 + F.lit(0.5)).cast("string").alias("duration")).alias("format"), F.array(video, audio).alias("streams")))
    rows = table(spark, sf, "orders").select(n.alias("path"), F.when(n % 4 == 3, "no json").otherwise(doc).alias("json"))
    return files.parse_probe(rows).select("path", "duration", "index", "codec_type", "codec_name", "channels", "width", "language", "is_default")


@query("fn_kv_overlay", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '7' WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE '5' END AS interval, CASE WHEN p_partkey % 3 = 1 THEN '9' ELSE '20' END AS snapshots FROM part")
def fn_kv_overlay(spark, sf):
    k = F.col("p_partkey") % 3
    lines = F.concat(F.lit("interval=1\nsnapshots = 9\r\nbroken\ninterval="), F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", F.when(k == 0, '{"interval": 7, "other": 1}').when(k == 1, "{").alias("json"), F.when(k < 2, lines).alias("lines"))
    return documents.preferences(rows, {"interval": "5", "snapshots": "20"}).select("p_partkey", "interval", "snapshots")


# ---- layouts ---------------------------------------------------------------------------------


def _layouts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, xml): a root split with two areas for each customer; each kind of fault in some of them."""
    k = F.col("c_custkey") % 9
    ratio = F.when(k == 1, 0.96).otherwise(0.5)
    node = lambda id_, parent, kind, axis, r, tabs: F.struct(id_.alias("_id"), parent.alias("_parent"), F.lit(kind).alias("_kind"), axis.alias("_axis"), r.alias("_ratio"), tabs.alias("_tabs"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    root = node(F.lit("s"), F.when(k == 2, "gone"), "split", F.when(k == 3, "z").otherwise("x"), ratio, none)
    left = node(F.lit("a"), F.lit("s"), "area", none, number, F.when(k == 4, "p q").otherwise("p"))
    right = node(F.when(k == 5, "a").otherwise("b"), F.lit("s"), "area", none, number, F.when(k == 6, "q r").when(k == 7, "").otherwise("q"))
    panel = lambda id_, kind: F.struct(id_.alias("_id"), kind.alias("_type"))
    panels = F.array(panel(F.lit("p"), F.when(k == 8, "").otherwise("list")), panel(F.lit("q"), F.lit("view")))
    docs = layouts.dealt(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), "c_custkey"))
    return docs.select("doc", layouts.layout_xml(panels, F.array(root, left, right), F.lit("p")).alias("xml"))


@query("src_layout_xml", "SELECT c_custkey AS doc, CASE WHEN c_custkey % 9 = 5 THEN 'a,a,s' ELSE 'a,b,s' END AS nodes, 'p,q' AS panels, CASE c_custkey % 9 WHEN 4 THEN 'p,q,q' WHEN 6 THEN 'p,q,r' WHEN 7 THEN 'p' ELSE 'p,q' END AS tabs, CASE WHEN c_custkey % 9 = 1 THEN 0.96 ELSE 0.5 END AS ratio FROM customer")
def src_layout_xml(spark, sf):
    nodes, panels, tabs = layouts.parse_layouts(_layouts(spark, sf), deal=False)
    joined = lambda rows, column, name: rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))
    ratio = nodes.where("kind = 'split'").select("doc", "ratio")
    return joined(nodes, "id", "nodes").join(joined(panels, "id", "panels"), "doc").join(joined(tabs, "panel", "tabs"), "doc").join(ratio, "doc")


@query("sink_layout_xml", "SELECT c_custkey AS doc, 'a b s' AS nodes, 2 AS panels, 'p' AS focused, c_custkey % 18 = 0 AS rewritten FROM customer WHERE c_custkey % 9 = 0")
def sink_layout_xml(spark, sf):
    """Written as a version and read back; layouts with a fault never get there."""
    folder, files = sinks.shared_folder(spark, "layouts"), _layouts(spark, sf)
    commits.commit(layouts.valid(files, deal=False), folder)
    held = commits.read(spark, folder)
    changed = held.withColumn("xml", F.when(F.col("doc") % 2 == 0, F.replace("xml", F.lit("0.5"), F.lit("0.25"))).otherwise(F.col("xml")))
    commits.commit(changed, folder, expect=0)
    back = commits.read(spark, folder).select("doc", F.from_xml(F.col("xml"), F.lit(layouts.LAYOUT_XML)).alias("x"))
    ratio = F.exists("x.nodes.node", lambda n: n["_ratio"] == 0.25)
    return back.select("doc", F.array_join(F.array_sort("x.nodes.node._id"), " ").alias("nodes"), F.size("x.panels.panel").alias("panels"), F.col("x.focused").alias("focused"), F.coalesce(ratio, F.lit(False)).alias("rewritten"))


@query("chk_referential", """SELECT c_custkey AS doc, problem FROM customer, (VALUES (1, 'split'), (2, 'root'), (3, 'split'), (4, 'docked'), (5, 'node'), (6, 'unknown'), (7, 'docked'), (8, 'panel')) v(k, problem) WHERE c_custkey % 9 = k""")
def chk_referential(spark, sf):
    found = layouts.problems(*layouts.parse_layouts(_layouts(spark, sf), deal=False))
    # a missing root is told of once
    return found


@query("tree_layout", """WITH RECURSIVE d AS (SELECT c_custkey AS doc, c_custkey % 9 AS k, CASE WHEN c_custkey % 9 = 5 AND c_custkey // 9 % 6 < 4 AND c_custkey // 108 % 2 = 1 THEN 5 ELSE c_custkey // 9 % 6 END AS turn, CASE WHEN c_custkey // 54 % 2 = 0 THEN 'q' ELSE 'p' END AS moved, CASE WHEN c_custkey // 108 % 2 = 0 THEN 'a' ELSE 'b' END AS target FROM customer),
a AS (SELECT doc, turn, target, i AS id, i = 2 AS second, CASE WHEN i = 1 OR k = 5 THEN 'a' ELSE 'b' END AS name, CASE WHEN i = 1 THEN CASE WHEN k = 4 THEN ['p', 'q'] ELSE ['p'] END WHEN k = 6 THEN ['q', 'r'] WHEN k = 7 THEN [] ELSE ['q'] END AS tabs FROM d, range(1, 3) r(i)),
t AS (SELECT DISTINCT a.doc, a.name, p FROM (SELECT doc, name, unnest(tabs) AS p FROM a) a JOIN d USING (doc) WHERE NOT (turn < 4 AND p = moved) AND NOT (turn = 4 AND p IN ('p', 'q'))),
n AS (SELECT doc, 0 AS id, NULL AS parent, FALSE AS second, TRUE AS split, '' AS name, CASE WHEN k = 3 THEN 'z' ELSE 'x' END AS axis, CASE WHEN doc % 3 > 0 THEN least(greatest(doc % 11 / 10.0, 0.05), 0.95) WHEN k = 1 THEN 0.96 ELSE 0.5 END AS ratio, FALSE AS filled FROM d
    UNION ALL SELECT doc, id, 0, second, FALSE, name, NULL, NULL, (doc, name) IN (SELECT (doc, name) FROM t) FROM a WHERE turn > 3 OR name <> target
    UNION ALL SELECT doc, 10 + id, 0, second, TRUE, '', CASE WHEN turn < 2 THEN 'x' ELSE 'y' END, 0.5, FALSE FROM a WHERE turn < 4 AND name = target
    UNION ALL SELECT doc, 20 + id, 10 + id, turn % 2 = 1, FALSE, 'n', NULL, NULL, TRUE FROM a WHERE turn < 4 AND name = target
    UNION ALL SELECT doc, id, 10 + id, turn % 2 = 0, FALSE, name, NULL, NULL, (doc, name) IN (SELECT (doc, name) FROM t) FROM a WHERE turn < 4 AND name = target),
k AS (SELECT doc, id FROM n WHERE filled UNION SELECT n.doc, n.parent FROM k JOIN n ON n.doc = k.doc AND n.id = k.id WHERE n.parent IS NOT NULL),
c AS (SELECT n.doc, n.parent AS id, count(*) = 2 AS two FROM n JOIN k USING (doc, id) WHERE parent IS NOT NULL GROUP BY 1, 2),
r AS (SELECT n.doc, n.id, [0] AS way, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h FROM n JOIN k USING (doc, id) WHERE parent IS NULL
    UNION ALL SELECT n.doc, n.id, r.way || [CAST(n.second AS INT)], CASE WHEN two AND p.axis = 'x' AND n.second THEN r.x + r.w * p.ratio ELSE r.x END, CASE WHEN two AND p.axis <> 'x' AND n.second THEN r.y + r.h * p.ratio ELSE r.y END,
        CASE WHEN two AND p.axis = 'x' THEN r.w * CASE WHEN n.second THEN 1 - p.ratio ELSE p.ratio END ELSE r.w END, CASE WHEN two AND p.axis <> 'x' THEN r.h * CASE WHEN n.second THEN 1 - p.ratio ELSE p.ratio END ELSE r.h END
    FROM r JOIN n ON n.doc = r.doc AND n.parent = r.id JOIN k ON k.doc = n.doc AND k.id = n.id JOIN n p ON p.doc = r.doc AND p.id = r.id JOIN c ON c.doc = r.doc AND c.id = r.id),
e AS (SELECT doc, name, way, CAST(round((x + w / 2) * 1000000) AS BIGINT) AS x, CAST(round((y + h / 2) * 1000000) AS BIGINT) AS y FROM r JOIN n USING (doc, id) WHERE NOT split UNION ALL SELECT doc, 'a', [0], 500000, 500000 FROM d WHERE doc NOT IN (SELECT doc FROM k)),
g AS (SELECT doc, string_agg(name, ',' ORDER BY way) AS edited, string_agg(x || ' ' || y, ',' ORDER BY way) AS centers FROM e GROUP BY 1)
SELECT doc, 2 AS areas, 1 AS splits, 1 AS depth, CASE WHEN k = 5 THEN 'a,a' ELSE 'a,b' END AS leaves, edited, centers FROM d JOIN g USING (doc)""")
def tree_layout(spark, sf):
    """Each document as it is read, then the areas and their centres after a split is resized, a panel moved or closed, and empty areas pruned."""
    nodes, _, tabs = layouts.parse_layouts(_layouts(spark, sf), deal=False)
    tree, docked = layouts.numbered(nodes, tabs)
    doc, turn = F.col("doc"), F.expr("doc div 9 % 6")
    closed = (turn == 4) & F.col("panel").isin("p", "q")
    moves = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc")).where(turn < 4).select("doc", F.when(F.expr("doc div 54 % 2 = 0"), "q").otherwise("p").alias("panel"), F.when(F.expr("doc div 108 % 2 = 0"), "a").otherwise("b").alias("name"), F.when(turn < 2, "x").otherwise("y").alias("axis"), (turn % 2 == 0).alias("leads"))
    low, high = map(F.lit, layouts.RATIO)
    ratios = tree.where((F.col("name") == "s") & (doc % 3 > 0)).select("doc", F.col("id").alias("split"), F.least(F.greatest(doc % 11 / 10, low), high).alias("ratio"))
    changed, docked = layouts.docked_beside(layouts.with_ratios(tree, ratios), docked.where(~closed), moves)
    # a layout without panels is the area a, which gets an id that no other has; new areas have no name yet
    left = layouts.pruned(changed, docked, -1).withColumn("name", F.when(F.col("id") == -1, "a").otherwise(F.coalesce("name", F.lit("n"))))
    both = [rows.withColumn("doc", F.struct("doc", F.lit(edited).alias("edited"))) for rows, edited in ((tree, False), (left, True))]
    found = layouts.rectangles(both[0].unionByName(both[1]), turns=True).select("doc.*", "id", "kind", "name", "turns", "x", "y", "width", "height")

    was, area = ~F.col("edited") & F.col("name").isNotNull(), F.col("kind") == "area"
    listed = lambda rows, value: F.array_join(F.sort_array(F.collect_list(F.when(rows & area, F.struct("turns", "id", value.alias("v")))))["v"], ",")
    middle = lambda start, size: F.round((F.col(start) + F.col(size) / 2) * 1000000).cast("long").cast("string")
    center = F.concat_ws(" ", middle("x", "width"), middle("y", "height"))
    return found.groupBy("doc").agg(
        F.count_if(was & area).alias("areas"), F.count_if(was & (F.col("kind") == "split")).alias("splits"), F.max(F.when(was, F.size("turns").cast("long"))).alias("depth"),
        listed(was, F.col("name")).alias("leaves"), listed(F.col("edited"), F.col("name")).alias("edited"), listed(F.col("edited"), center).alias("centers"),
    )


@query("tree_layout_rects", """WITH RECURSIVE d AS (SELECT c_custkey AS doc FROM customer),
n AS (SELECT doc, i AS id, CASE WHEN i > 1 THEN i // 2 END AS parent, i % 2 = 0 AS first, i < 4 AS split, CASE WHEN (doc + i) % 2 = 0 THEN 'x' ELSE 'y' END AS axis, CASE WHEN i = 3 AND doc % 5 = 0 THEN 0.25 ELSE 0.1 + (doc * i % 8) / 10.0 END AS ratio FROM d, range(1, 8) r(i) WHERE NOT (doc % 4 = 0 AND i = 4)
    UNION ALL SELECT doc, 8, 2, TRUE, TRUE, 'y', 0.3 FROM d WHERE doc % 4 = 0 UNION ALL SELECT doc, 9, 8, TRUE, FALSE, NULL, NULL FROM d WHERE doc % 4 = 0 UNION ALL SELECT doc, 4, 8, FALSE, FALSE, NULL, NULL FROM d WHERE doc % 4 = 0),
t AS (SELECT doc, id FROM n WHERE NOT split AND doc % 7 > 0 AND (id = 9 OR (doc + id) % 3 > 0)),
k AS (SELECT doc, id FROM t UNION SELECT n.doc, n.parent FROM k JOIN n ON n.doc = k.doc AND n.id = k.id WHERE n.parent IS NOT NULL),
c AS (SELECT n.doc, n.parent AS id, count(*) AS kids FROM n JOIN k USING (doc, id) WHERE parent IS NOT NULL GROUP BY 1, 2),
r AS (SELECT n.doc, n.id, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h FROM n JOIN k USING (doc, id) WHERE parent IS NULL
    UNION ALL SELECT n.doc, n.id, CASE WHEN kids = 2 AND p.axis = 'x' AND NOT n.first THEN r.x + r.w * p.ratio ELSE r.x END, CASE WHEN kids = 2 AND p.axis = 'y' AND NOT n.first THEN r.y + r.h * p.ratio ELSE r.y END,
        CASE WHEN kids = 2 AND p.axis = 'x' THEN r.w * CASE WHEN n.first THEN p.ratio ELSE 1 - p.ratio END ELSE r.w END, CASE WHEN kids = 2 AND p.axis = 'y' THEN r.h * CASE WHEN n.first THEN p.ratio ELSE 1 - p.ratio END ELSE r.h END
    FROM r JOIN n ON n.doc = r.doc AND n.parent = r.id JOIN k ON k.doc = n.doc AND k.id = n.id JOIN n p ON p.doc = r.doc AND p.id = r.id JOIN c ON c.doc = r.doc AND c.id = r.id)
SELECT doc, id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height FROM r JOIN n USING (doc, id) WHERE NOT split UNION ALL SELECT doc, 0, 0, 0, 1, 1 FROM d WHERE doc % 7 = 0""")
def tree_layout_rects(spark, sf):
    """Three levels of splits for each customer; some areas are split, some ratios set, empty areas pruned."""
    i, doc = F.col("id"), F.col("doc")
    ids = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc")).select("doc", ids.alias("id"))
    split = i < 4
    nodes = rows.select("doc", "id", F.when(i > 1, F.floor(i / 2)).alias("parent"), F.when(split, "split").otherwise("area").alias("kind"), F.when(split, F.when((doc + i) % 2 == 0, "x").otherwise("y")).alias("axis"), F.when(split, 0.1 + (doc * i % 8) / 10).alias("ratio"), i.alias("place"))
    more = rows.where("id = 4 and doc % 4 = 0").select("doc", i.alias("area"), F.lit(8).alias("split"), F.lit("y").alias("axis"), F.lit(0.3).alias("ratio"), F.lit(9).alias("added"), F.lit(True).alias("leads"))
    nodes = layouts.with_areas(nodes, more)
    nodes = layouts.with_ratios(nodes, rows.where("id = 3 and doc % 5 = 0").select("doc", i.alias("split"), F.lit(0.25).alias("ratio")))
    tabs = nodes.where("kind = 'area' and doc % 7 > 0 and (id = 9 or (doc + id) % 3 > 0)").select("doc", i.alias("area"), F.lit("p").alias("panel"))
    out = layouts.rectangles(layouts.pruned(nodes, tabs, 0)).where("kind = 'area'")
    return out.select("doc", "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


# ---- sinks -----------------------------------------------------------------------------------


@query("sink_individual", """WITH c AS (SELECT o_custkey % 60 AS clip, min(o_orderkey) AS ord, count(*) + CASE WHEN o_custkey % 60 = 5 THEN 1 ELSE 0 END AS expected, count(*) AS n FROM orders GROUP BY o_custkey % 60 UNION ALL SELECT 1000, 0, 1, 0)
SELECT ord, clip, CASE WHEN n < expected THEN 'failed' ELSE 'completed' END AS status, n, CASE WHEN n = 0 THEN 'no rows' WHEN n < expected THEN 'rows missing' END AS error FROM c""")
def sink_individual(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("clip"), "o_orderkey")
    more = F.when(F.col("clip") == 5, 1).otherwise(0)
    clips = rows.groupBy("clip").agg(F.min("o_orderkey").alias("ord"), F.count("*").alias("expected")).withColumn("expected", F.col("expected") + more)
    clips = clips.unionByName(spark.createDataFrame([(1000, 0, 1)], "clip long, ord long, expected long"))
    return sinks.write_clips(clips, rows, sinks.shared_folder(spark, "clips"))


@query("sink_merge", """SELECT o_custkey, sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey) AS total_us, o_orderkey AS clip, coalesce(sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_us FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def sink_merge(spark, sf):
    clips = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("clip"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").alias("duration_us"))
    return sinks.merged_manifest(clips, "o_custkey").select("o_custkey", "total_us", "clip", "offset_us")


@query("sink_merge_rows", """WITH c AS (SELECT o_custkey % 5 AS target, o_orderkey, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT target, l_orderkey AS clip, l_linenumber, before + l_linenumber AS at_us, row_number() OVER (PARTITION BY target ORDER BY before + l_linenumber, l_orderkey) - 1 AS place FROM lineitem JOIN c ON l_orderkey = o_orderkey""")
def sink_merge_rows(spark, sf):
    """Lines as rows of clips, written in order into five targets and read back by their place in the files."""
    folder = sinks.shared_folder(spark, "merged")
    clips = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("target"), F.col("o_orderkey").alias("clip"), F.col("o_orderdate").alias("ord"), F.floor("o_totalprice").alias("duration_us"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("at_us"), "l_linenumber")
    sinks.write_merged(clips, rows, "target", folder)
    return sinks.read_merged(spark, folder, "target")


@query("sink_snapshot", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 > 0")
def sink_snapshot(spark, sf):
    """Each state is made from the one that the folder holds; rows of a write that failed never show."""
    folder = sinks.shared_folder(spark, "snapshot")
    state = sinks.write_snapshot(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), folder)
    state = sinks.write_snapshot(state.where("c_custkey % 2 = 1"), folder)
    state.write.parquet(f"{folder}/{commits.DATA}failed")
    return sinks.write_snapshot(state.where("c_custkey % 3 > 0"), folder)


@query("sink_blob_cache", f"SELECT sha256(doc_id || ':' || doc_id % 7) AS cache_key, sha256({_ASCII}) AS content FROM documents WHERE doc_id % 10 <> 0")
def sink_blob_cache(spark, sf):
    key = F.concat("path", F.lit(":"), F.col("path") % 7)
    cache = sinks.with_digest(_ascii(spark, sf), key)
    # every tenth is damaged after it was written
    damaged = cache.withColumn("content", F.when(F.col("path") % 10 == 0, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content")))
    return sinks.readable(damaged).select("cache_key", F.sha2("content", 256).alias("content"))


# ---- states ----------------------------------------------------------------------------------


@query("flt_item_state", """WITH i AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag <> 'R' AS enabled, CASE WHEN l_linestatus = 'F' THEN l_partkey % 5 = 0 END AS hidden, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 = 1 END AS there, CASE WHEN l_suppkey % 2 = 0 THEN 'audio' ELSE 'video' END AS kind, CASE WHEN l_orderkey % 2 = 0 THEN 'v' END AS bound FROM lineitem),
f AS (SELECT *, bound IS NOT NULL AND kind <> 'video' AS virtual FROM i), g AS (SELECT *, NOT virtual AND NOT coalesce(there, TRUE) AS offline FROM f)
SELECT l_orderkey, count(*) FILTER (enabled AND NOT offline) AS usable, count(*) FILTER (NOT coalesce(hidden, FALSE)) AS shown, count(*) FILTER (offline) AS offline, count(*) FILTER (virtual) AS virtual FROM g GROUP BY 1""")
def flt_item_state(spark, sf):
    part = F.col("l_partkey")
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_returnflag") != "R").alias("enabled"), F.when(F.col("l_linestatus") == "F", part % 5 == 0).alias("hidden"), F.when(part % 3 > 0, part % 3 == 1).alias("path_exists"),
        F.when(F.col("l_suppkey") % 2 == 0, "audio").otherwise("video").alias("kind"), F.when(F.col("l_orderkey") % 2 == 0, "v").alias("bound_to"),
    )
    return predicates.with_item_state(items).groupBy("l_orderkey").agg(*[F.count_if(F.col(c)).alias(c) for c in ("usable", "shown", "offline", "virtual")])


@query("str_queue_status", """WITH l AS (SELECT user_id, event_id, ['queued', 'running', 'running', 'running', 'completed', 'failed', 'running'][event_id % 7 + 1] AS status FROM events),
e AS (SELECT user_id, min(event_id) FILTER (status IN ('completed', 'failed')) AS ended, min(event_id) FILTER (status = 'running') AS started, arg_max(status, event_id) AS latest FROM l GROUP BY 1)
SELECT e.user_id, coalesce((SELECT status FROM l WHERE l.event_id = ended), latest) AS status, started, ended, (SELECT count(*) FROM l WHERE l.user_id = e.user_id AND l.event_id > ended) AS late FROM e""")
def str_queue_status(spark, sf):
    states = F.array(*map(F.lit, ("queued", "running", "running", "running", "completed", "failed", "running")))
    log = table(spark, sf, "events").select("user_id", "event_id", F.get(states, (F.col("event_id") % 7).cast("int")).alias("status"))
    return rules.queue_status(log, "user_id", "event_id", "status")


@query("agg_entropy", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x + 1) * 127), 0), 255) AS INT)) AS v FROM embeddings WHERE len(embedding) = 64), g AS (SELECT vec_id, ((v[i + 1] >> 4) << 8) | ((v[(i + 21) % 64 + 1] >> 4) << 4) | (v[(i + 42) % 64 + 1] >> 4) AS bin FROM e, range(64) t(i)),
h AS (SELECT vec_id, bin, count(*) / 64.0 AS q FROM g GROUP BY ALL) SELECT vec_id, round(least(greatest(-sum(q * log2(q)) / 12, 0), 1), 6) AS colour FROM h GROUP BY 1""")
def agg_entropy(spark, sf):
    v = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x + 1) * 127), F.lit(0)), F.lit(255)).cast("int"))
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", v.alias("v"))
    turned = lambda n: F.concat(F.slice("v", n + 1, 64 - n), F.slice("v", 1, n)) if n else F.col("v")
    frames = rows.select("vec_id", turned(0).alias("red"), turned(21).alias("green"), turned(42).alias("blue"))
    return frames.select("vec_id", F.round(mx.colour_score(F.col("red"), F.col("green"), F.col("blue")), 6).alias("colour"))
