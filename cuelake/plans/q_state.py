"""Queries for hierarchies (group M), history (P), streams (O) and sources (A, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.operators import history, trees
from cuelake.plans.catalog import query
from cuelake.session import stream_table, table
from cuelake.sources import sinks
from cuelake.streaming import delivery, rules, timed


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, parent): regions, nations, customers."""
    region = table(spark, sf, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r:"), "n_regionkey").alias("parent"))
    customer = table(spark, sf, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n:"), "c_nationkey").alias("parent"))
    return region.unionByName(nation).unionByName(customer)


_TREE = """tree AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'r:' || n_regionkey FROM nation UNION ALL SELECT 'c:' || c_custkey, c_name, 'n:' || c_nationkey FROM customer)"""
_UP = _TREE + """, up AS (SELECT id, id AS ancestor, CAST(0 AS BIGINT) AS depth FROM tree UNION ALL SELECT u.id, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.parent IS NOT NULL)"""


@query("tree_ancestors", f"WITH RECURSIVE {_UP} SELECT id, ancestor AS ancestor_id, depth FROM up")
def tree_ancestors(spark, sf):
    return trees.ancestors(tree(spark, sf)).withColumnRenamed("ancestor", "ancestor_id")


@query("tree_descendants", f"WITH RECURSIVE {_UP} SELECT ancestor AS id, count(*) AS n FROM up GROUP BY 1")
def tree_descendants(spark, sf):
    return trees.descendants(tree(spark, sf)).groupBy("id").agg(F.count("*").alias("n"))


@query("tree_path", f"WITH RECURSIVE {_UP} SELECT u.id, string_agg(t.name, '<' ORDER BY u.depth) AS path FROM up u JOIN tree t ON t.id = u.ancestor GROUP BY 1")
def tree_path(spark, sf):
    return trees.paths(tree(spark, sf))


@query("tree_repair", f"WITH {_TREE} SELECT id, CASE WHEN parent LIKE 'n:1%' THEN NULL ELSE parent END AS parent FROM tree WHERE id NOT LIKE 'n:1%'")
def tree_repair(spark, sf):
    rows = tree(spark, sf).where("id not like 'n:1%'")
    blank = rows.limit(1).select(F.lit(" ").alias("id"), "name", "parent")
    return trees.repair(rows.unionByName(blank)).select("id", "parent")


@query("tree_dfs", f"WITH RECURSIVE {_UP} SELECT u.id, max(u.depth) AS depth, string_agg(t.name || '/' || t.id, '|' ORDER BY u.depth DESC) AS place FROM up u JOIN tree t ON t.id = u.ancestor GROUP BY 1")
def tree_dfs(spark, sf):
    out = trees.depth_first(tree(spark, sf))
    return out.select("id", "depth", F.array_join(F.transform("place", lambda k: F.concat(k["name"], F.lit("/"), k["id"])), "|").alias("place"))


@query("tree_filter_up", f"WITH RECURSIVE {_UP} SELECT DISTINCT ancestor AS id FROM up WHERE id IN (SELECT id FROM tree WHERE name LIKE '%7')")
def tree_filter_up(spark, sf):
    nodes = tree(spark, sf)
    return trees.keep_with_ancestors(nodes, nodes.where("name like '%7'")).select("id")


@query("tree_cascade", f"WITH RECURSIVE {_UP} SELECT id FROM tree WHERE id NOT IN (SELECT id FROM up WHERE ancestor IN ('r:1', 'n:3'))")
def tree_cascade(spark, sf):
    nodes = tree(spark, sf)
    return trees.cascade_delete(nodes, nodes.where("id in ('r:1', 'n:3')")).select("id")


@query("tree_kw_delete", f"""WITH RECURSIVE {_UP} SELECT o_orderkey FROM orders WHERE 'c:' || o_custkey NOT IN (SELECT id FROM up WHERE ancestor = 'r:2')""")
def tree_kw_delete(spark, sf):
    nodes = tree(spark, sf)
    left = trees.cascade_delete(nodes, nodes.where("id = 'r:2'")).select("id")
    return table(spark, sf, "orders").withColumn("id", F.concat(F.lit("c:"), "o_custkey")).join(left, "id", "left_semi").select("o_orderkey")


@query("tree_move", f"WITH {_TREE} SELECT id, CASE WHEN id IN ('n:4', 'n:5') OR (id = 'c:9' AND parent NOT IN ('n:4', 'n:5')) THEN 'r:0' ELSE parent END AS parent FROM tree")
def tree_move(spark, sf):
    nodes = tree(spark, sf)
    return trees.move(nodes, nodes.where("id in ('n:4', 'n:5', 'c:9', 'r:0')"), "r:0").select("id", "parent")


@query("tree_copy", f"WITH RECURSIVE {_UP}, i AS (SELECT * FROM tree WHERE id IN (SELECT id FROM up WHERE ancestor = 'n:2')) SELECT sha256('x' || id) AS id, name, CASE WHEN id = 'n:2' THEN parent ELSE sha256('x' || parent) END AS parent FROM i")
def tree_copy(spark, sf):
    nodes = tree(spark, sf)
    return trees.copy(nodes, nodes.where("id = 'n:2'"), "x")


@query("tree_upsert", "SELECT sha256(p_type) AS id, p_type AS name, NULL AS parent FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT sha256(p_type || '>' || p_brand), p_brand, sha256(p_type) FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def tree_upsert(spark, sf):
    return trees.from_paths(table(spark, sf, "part").select(F.array("p_type", "p_brand").alias("path")))


@query("tree_children", f"WITH {_TREE} SELECT parent, string_agg(name, '|' ORDER BY name, id) AS children FROM tree WHERE parent IS NOT NULL GROUP BY 1")
def tree_children(spark, sf):
    rows = tree(spark, sf).where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("c"))
    return rows.select("parent", F.array_join("c.name", "|").alias("children"))


@query("tree_search_values", f"WITH RECURSIVE {_UP} SELECT u.id, array_to_string(list_sort(list_distinct(list(lower(t.name)))), '|') AS searched FROM up u JOIN tree t ON t.id = u.ancestor GROUP BY 1")
def tree_search_values(spark, sf):
    nodes = tree(spark, sf)
    up = trees.ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor"), F.lower("name").alias("name")), "ancestor")
    return up.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("searched"))


@query("agg_keyword_effective", f"WITH RECURSIVE {_UP} SELECT ancestor AS keyword_id, count(DISTINCT o_orderkey) AS n_shots FROM orders JOIN up ON up.id = 'c:' || o_custkey GROUP BY 1")
def agg_keyword_effective(spark, sf):
    uses = table(spark, sf, "orders").select(F.concat(F.lit("c:"), "o_custkey").alias("id"), "o_orderkey").distinct().groupBy("id").count()
    up = trees.ancestors(tree(spark, sf)).join(uses, "id")
    return up.groupBy(F.col("ancestor").alias("keyword_id")).agg(F.sum("count").alias("n_shots"))


@query("agg_subtree_any", f"WITH RECURSIVE {_UP} SELECT ancestor AS id, bool_or(name LIKE '%77%') AS any FROM up JOIN tree USING (id) GROUP BY 1")
def agg_subtree_any(spark, sf):
    nodes = tree(spark, sf)
    return trees.ancestors(nodes).join(nodes.select("id", "name"), "id").groupBy(F.col("ancestor").alias("id")).agg(F.bool_or(F.col("name").like("%77%")).alias("any"))


@query("flt_keyword_all", f"WITH RECURSIVE {_UP} SELECT o_orderkey FROM orders JOIN up ON up.id = 'c:' || o_custkey WHERE ancestor IN ('r:2', 'n:7') GROUP BY 1 HAVING count(DISTINCT ancestor) = 2")
def flt_keyword_all(spark, sf):
    wanted = F.array(F.lit("r:2"), F.lit("n:7"))
    have = trees.ancestors(tree(spark, sf)).groupBy("id").agg(F.collect_set("ancestor").alias("a"))
    return table(spark, sf, "orders").withColumn("id", F.concat(F.lit("c:"), "o_custkey")).join(have.where(F.size(F.array_except(wanted, "a")) == 0), "id", "left_semi").select("o_orderkey")


# ---- history ---------------------------------------------------------------------------------

def _snapshots(spark, sf):
    before = table(spark, sf, "customer")
    changed = before.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    added = before.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return before, changed.unionByName(added)


@query("hist_diff", "SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'delete' ELSE 'update' END AS change_type FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 10000000, 'insert' FROM customer WHERE c_custkey % 11 = 0")
def hist_diff(spark, sf):
    return history.diff(*_snapshots(spark, sf), "c_custkey").select(F.col("c_custkey").alias("key"), "change_type")


@query("hist_apply", "SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 11 = 0")
def hist_apply(spark, sf):
    before, after = _snapshots(spark, sf)
    return history.apply(before, history.diff(before, after, "c_custkey"), "c_custkey").select("c_custkey", "c_acctbal")


@query("hist_restore", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def hist_restore(spark, sf):
    before, after = _snapshots(spark, sf)
    return history.apply(after, history.diff(before, after, "c_custkey"), "c_custkey", back=True).select("c_custkey", "c_name", "c_acctbal")


@query("hist_time_travel", "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'click'")
def hist_time_travel(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "click", "delete").otherwise("set").alias("op"))
    half = table(spark, sf, "events").agg(F.expr("max(event_id) div 2")).first()[0] or 0
    return history.as_of(log, "user_id", "event_id", half).select("user_id", "value")


@query("hist_append", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, CASE WHEN k = 40 THEN 'base' ELSE 'entry' END AS role FROM r WHERE k <= 40")
def hist_append(spark, sf):
    return history.capped(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("hist_dirty", "SELECT user_id, max(event_id) <> max(event_id) FILTER (value > 50) AS dirty FROM events GROUP BY 1 HAVING count(*) FILTER (value > 50) > 0")
def hist_dirty(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.max(F.when(F.col("value") > 50, F.col("event_id"))).alias("saved"))
    return rows.where("saved is not null").select("user_id", (F.col("cursor") != F.col("saved")).alias("dirty"))


@query("prj_history_rows", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cursor FROM events) SELECT user_id, cursor, cursor = 3 AS current, cursor > 3 AS future FROM e UNION ALL SELECT DISTINCT user_id, 0, FALSE, FALSE FROM e""")
def prj_history_rows(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("cursor"))
    both = rows.unionByName(rows.select("user_id").distinct().withColumn("cursor", F.lit(0).cast("long")))
    return both.select("user_id", "cursor", (F.col("cursor") == 3).alias("current"), (F.col("cursor") > 3).alias("future"))


@query("dml_annotate", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE quality END AS quality FROM labels UNION ALL SELECT doc_id, 5 FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def dml_annotate(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", "quality")
    return history.upsert(old, table(spark, sf, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(5).alias("quality")), "doc_id")


@query("dml_state_upsert", "SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 9 FROM labels WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def dml_state_upsert(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", "quality")
    new = old.where("doc_id % 3 = 0").withColumn("quality", F.lit(9))
    return history.upsert(old, new, "doc_id", keep=old.where("doc_id % 2 = 0"))


@query("dml_stack_view", "SELECT o_custkey, min(o_orderkey) AS first, arg_min(o_orderdate, o_orderkey) AS start, arg_max(o_orderdate, o_orderkey) AS stop, count(*) AS n FROM orders GROUP BY 1")
def dml_stack_view(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("stop"))
    return history.stack_view(rows, "o_custkey", "o_orderkey", "start", "stop")


# ---- streams ---------------------------------------------------------------------------------

@query("str_rate_limit", """WITH RECURSIVE e AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_type, k, ts AS opened FROM e WHERE k = 1 UNION ALL SELECT e.event_type, e.k, CASE WHEN e.ts < w.opened + INTERVAL 1 HOUR THEN w.opened ELSE e.ts END FROM w JOIN e ON e.event_type = w.event_type AND e.k = w.k + 1)
SELECT event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY opened) - 1 AS window_no, opened AS first_ts, count(*) - 1 AS suppressed FROM w GROUP BY event_type, opened""")
def str_rate_limit(spark, sf):
    return rules.rate_limited(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", 3600).withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


@query("str_rate_limit_stream", """WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_type, k, t AS opened FROM e WHERE k = 1 UNION ALL SELECT e.event_type, e.k, CASE WHEN e.t < w.opened + 3600000000 THEN w.opened ELSE e.t END FROM w JOIN e ON e.event_type = w.event_type AND e.k = w.k + 1),
g AS (SELECT event_type, opened, count(*) - 1 AS suppressed FROM w GROUP BY ALL)
SELECT event_type, 'first' AS kind, make_timestamp(opened) AS at, 0 AS suppressed FROM g
UNION ALL SELECT event_type, 'flush', make_timestamp(opened + 3600000000), suppressed FROM g WHERE suppressed > 0 AND (opened + 3600000000 + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def str_rate_limit_stream(spark, sf):
    """The table's files as a stream with event-time timers; a window that the newest event hasn't passed stays open."""
    out = timed.rate_limited_flushes(stream_table(spark, sf, "events"), "event_type", "ts", 3600)
    return timed.read_all(out, sinks.shared_folder(spark, "rates")).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("str_running_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def str_running_max(spark, sf):
    return rules.running_max(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id", "progress")


@query("str_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def str_latest(spark, sf):
    return rules.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("str_change_only", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def str_change_only(spark, sf):
    return rules.changes_only(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("event_id")


@query("str_throttle", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM events),
w AS (SELECT user_id, k, p AS told, TRUE AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.p >= w.told + 10 THEN e.p ELSE w.told END, e.p >= w.told + 10 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, e.event_id FROM w JOIN e USING (user_id, k) WHERE kept""")
def str_throttle(spark, sf):
    rows = rules.running_max(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "progress")
    return rules.throttled(rows, "user_id", "event_id", "progress", 10.0).select("user_id", "event_id")


@query("str_journal", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 200")
def str_journal(spark, sf):
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return table(spark, sf, "events").withColumn("k", k).where("k <= 200").select("event_type", "event_id")


@query("str_delivery", """SELECT event_id AS event, 3 AS delivered, 1 + CAST(event_type = 'purchase' AS BIGINT) AS handled, CAST(event_type <> 'purchase' AS BIGINT) + CAST(event_type <> 'signup' AS BIGINT) AS ignored, CAST(event_type = 'signup' AS BIGINT) AS failed FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)
UNION ALL SELECT NULL, 1, (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE event_type <> 'purchase'), 0""")
def str_delivery(spark, sf):
    """The newest reports, and a row with the numbers that two subscribers wrote (events, and events less purchases); a third
    always fails."""

    def broken(events, batch):
        raise RuntimeError("no")

    folder = sinks.shared_folder(spark, "delivery")
    kind = F.col("event_type")
    subscribers = {
        "all": delivery.Subscriber(F.lit(True), delivery.table_sink(f"{folder}/all")),
        "money": delivery.Subscriber(kind == "purchase", delivery.table_sink(f"{folder}/money")),
        "broken": delivery.Subscriber(kind == "signup", broken),
    }
    delivery.deliver(stream_table(spark, sf, "events"), subscribers, "event_id", "event_id", folder).awaitTermination()
    schema = table(spark, sf, "events").schema
    every, money = (spark.read.schema(schema).parquet(f"{folder}/{n}").agg(F.count("*").alias(n)) for n in ("all", "money"))
    both = every.select(F.col("all").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(money.select(F.lit(0).cast("long").alias("n"), F.col("money").alias("m")))
    wrote = both.agg(F.sum("n").alias("handled"), (F.sum("n") - F.sum("m")).alias("ignored"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return delivery.journal(spark, folder).unionByName(wrote.select(F.lit(None).cast("long").alias("event"), one.alias("delivered"), "handled", "ignored", zero.alias("failed")))


def _windows(spark: SparkSession, sf: str, slide: str | None = None) -> DataFrame:
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = rules.windowed_counts(events, "event_type", "ts", "1 hour", "10 minutes", slide)
    return counted.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def str_tumbling(spark, sf):
    return _windows(spark, sf)


@query("str_sliding", "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL")
def str_sliding(spark, sf):
    return _windows(spark, sf, "15 minutes")


@query("str_windows", """WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events),
g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def str_windows(spark, sf):
    """Session windows over a table; tumbling ones with a watermark and late rows are read as a stream in the tests."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# ---- sources and sinks -----------------------------------------------------------------------

@query("src_parse_srt", "SELECT conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS sequence, turn * 2000000 AS start_us, turn * 2000000 + 1500000 AS end_us FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def src_parse_srt(spark, sf):
    from cuelake.sources.subtitles import parse_srt

    clock = lambda ms: F.concat(F.lpad((ms / 3_600_000).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((ms / 60_000 % 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((ms / 1000 % 60).cast("int").cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("int").cast("string"), 3, "0"))
    ms = F.col("turn") * 2000
    block = F.concat(clock(ms), F.lit(" --> "), clock(ms + 1500), F.lit("\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n"))
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", block.alias("b")))).alias("r"))
    return parse_srt(files.select(F.col("conv_id").alias("path"), F.array_join("r.b", "").alias("content"))).select("path", "sequence", "start_us", "end_us")


@query("fn_codec_from_path", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ass' WHEN 1 THEN 'webvtt' WHEN 2 THEN 'subrip' ELSE 'ssa' END AS codec FROM part")
def fn_codec_from_path(spark, sf):
    from cuelake.sources.subtitles import codec_of

    path = F.concat("p_name", F.lit("."), F.expr("CASE p_size % 4 WHEN 0 THEN 'ASS' WHEN 1 THEN 'vtt' WHEN 2 THEN 'srt' ELSE 'ssa' END"))
    return table(spark, sf, "part").select("p_partkey", codec_of(path).alias("codec"))


@query("fn_incident_clip", "SELECT doc_id, length(left(text, 4096)) AS size, CAST(least(greatest(n_chars, 1), 10000) AS BIGINT) AS times FROM documents")
def fn_incident_clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(F.left("text", F.lit(4096))).alias("size"), F.least(F.greatest("n_chars", F.lit(1)), F.lit(10000)).alias("times"))
