"""Queries for folders with bound items (M9-M11) and keyword paths (M6): orders are items in the folder of their customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import bins, trees
from cuelake.plans.catalog import query
from cuelake.plans.q_state import _TREE, _UP, tree
from cuelake.session import table

#: Chains of up to four orders, each bound to the one before.
_ITEMS = """items AS (SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'video' ELSE 'audio' END AS kind, 'c:' || o_custkey AS bin, CASE WHEN o_orderkey % 5 > 1 THEN 'o:' || (o_orderkey - 1) END AS bound FROM orders)"""
_BOTH = "SELECT 'folder' AS type, id, parent AS place, NULL AS bound FROM {} UNION ALL SELECT 'item', id, bin, bound FROM {}"


def _items(spark, sf):
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.concat(F.lit("o:"), n).alias("id"), F.when(n % 3 == 0, "video").otherwise("audio").alias("kind"), F.concat(F.lit("c:"), "o_custkey").alias("bin"), F.when(n % 5 > 1, F.concat(F.lit("o:"), n - 1)).alias("bound"))


def _both(folders, items, *more):
    rows = folders.select(F.lit("folder").alias("type"), "id", F.col("parent").alias("place"), F.lit(None).cast("string").alias("bound"), *more)
    return rows.unionByName(items.select(F.lit("item").alias("type"), "id", F.col("bin").alias("place"), "bound", *more))


#: What nation 3, customer 7 and the orders whose number ends in 21 hold.
_HELD = f"""{_UP}, {_ITEMS}, f AS (SELECT DISTINCT id FROM up WHERE ancestor IN ('n:3', 'c:7')),
g AS (SELECT id FROM items WHERE bin IN (SELECT id FROM f) OR id LIKE '%21' UNION SELECT i.id FROM items i JOIN g ON i.bound = g.id)"""


def _selection(spark, sf):
    folders, items = tree(spark, sf), _items(spark, sf)
    return folders, items, folders.where("id in ('n:3', 'c:7')").select("id"), items.where("id like '%21'").select("id")


@query("tree_delete_bound", f"WITH RECURSIVE {_HELD} " + _BOTH.format("tree WHERE id NOT IN (SELECT id FROM f)", "items WHERE id NOT IN (SELECT id FROM g)"))
def tree_delete_bound(spark, sf):
    return _both(*bins.delete_entries(*_selection(spark, sf)))


@query("tree_copy_bound", f"""WITH RECURSIVE {_HELD}
SELECT 'folder' AS type, sha256('x:' || id) AS id, CASE WHEN parent IN (SELECT id FROM f) THEN sha256('x:' || parent) ELSE 'r:4' END AS place, NULL AS bound, coalesce(parent NOT IN (SELECT id FROM f), TRUE) AS root FROM tree WHERE id IN (SELECT id FROM f)
UNION ALL SELECT 'item', sha256('x:' || id), CASE WHEN bin IN (SELECT id FROM f) THEN sha256('x:' || bin) ELSE 'r:4' END, CASE WHEN bound IN (SELECT id FROM g) THEN sha256('x:' || bound) END, bin NOT IN (SELECT id FROM f) AND coalesce(bound NOT IN (SELECT id FROM g), TRUE) FROM items WHERE id IN (SELECT id FROM g)""")
def tree_copy_bound(spark, sf):
    return _both(*bins.copy_entries(*_selection(spark, sf), mark="x", target="r:4"), "root")


@query("tree_move_bound", f"""WITH {_TREE}, {_ITEMS}, m AS (SELECT id FROM items WHERE id LIKE '%2'), l AS (SELECT id FROM m UNION SELECT id FROM items WHERE bound IN (SELECT id FROM m))
SELECT 'folder' AS type, id, CASE WHEN id = 'n:3' OR (id IN ('c:7', 'c:9') AND parent <> 'n:3') THEN 'r:4' ELSE parent END AS place, NULL AS bound FROM tree
UNION ALL SELECT 'item', id, CASE WHEN id IN (SELECT id FROM l) THEN 'r:4' ELSE bin END, CASE WHEN id IN (SELECT id FROM m) AND kind <> 'video' AND bound IS NOT NULL AND bound NOT IN (SELECT id FROM l) THEN NULL ELSE bound END FROM items""")
def tree_move_bound(spark, sf):
    folders, items = tree(spark, sf), _items(spark, sf)
    asked = folders.where("id in ('n:3', 'c:7', 'c:9')").select("id")
    return _both(*bins.move_entries(folders, items, asked, items.where("id like '%2'").select("id"), "r:4"))


# ---- keyword paths ---------------------------------------------------------------------------


@query("tree_merge_paths", """WITH ex AS (SELECT DISTINCT 'k:' || p_type AS id, p_type AS name, NULL AS parent, ['old', p_type] AS syn FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT 'k:' || p_type || '>' || p_brand, p_brand, 'k:' || p_type, ['old'] FROM part WHERE p_size % 2 = 0 AND p_partkey % 2 = 0),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'M' || p_size % 4 ELSE p_type END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS b, 's' || p_size % 3 AS syn FROM part),
x AS (SELECT p.*, coalesce(e.id, sha256('>' || a)) AS id1 FROM p LEFT JOIN ex e ON e.parent IS NULL AND e.name = a),
y AS (SELECT x.*, coalesce(e.id, sha256(id1 || '>' || b)) AS id2 FROM x LEFT JOIN ex e ON e.parent = id1 AND e.name = b),
n AS (SELECT id, name, parent FROM ex UNION SELECT id1, a, NULL FROM y UNION SELECT id2, b, id1 FROM y),
s AS (SELECT id, unnest(syn) AS w FROM ex UNION SELECT id2, syn FROM y)
SELECT id, name, parent, coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM s WHERE s.id = n.id), '') AS synonyms, (SELECT count(*) FROM y WHERE y.id2 = n.id) AS n_paths FROM n""")
def tree_merge_paths(spark, sf):
    part = table(spark, sf, "part")
    even = part.where("p_size % 2 = 0")
    tops = even.select(F.concat(F.lit("k:"), "p_type").alias("id"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parent"), F.array(F.lit("old"), F.col("p_type")).alias("synonyms"))
    below = even.where("p_partkey % 2 = 0").select(F.concat(F.lit("k:"), "p_type", F.lit(">"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("k:"), "p_type").alias("parent"), F.array(F.lit("old")).alias("synonyms"))
    other = F.col("p_partkey") % 5 == 0
    names = F.array(F.when(other, F.concat(F.lit("M"), (F.col("p_size") % 4).cast("string"))).otherwise(F.col("p_type")), F.when(other, F.col("p_type")).otherwise(F.col("p_brand")))
    paths = part.select(F.col("p_partkey").alias("path"), names.alias("names"), F.array(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("synonyms"))
    nodes, leaves = trees.merge_paths(tops.unionByName(below).distinct(), paths)
    out = nodes.join(leaves.groupBy("id").agg(F.count("*").alias("n_paths")), "id", "left")
    return out.select("id", "name", "parent", F.array_join(F.sort_array("synonyms"), "|").alias("synonyms"), F.coalesce("n_paths", F.lit(0).cast("long")).alias("n_paths"))
