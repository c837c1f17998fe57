"""Hierarchies given as (id, name, parent): closures, paths, cascades.

Closures double: when all ancestors nearer than a distance are known, and the node at just that distance, joining
the two gives all that are nearer than twice as far. A tree takes as many rounds as its depth has binary digits;
each is written to the checkpoint folder, so that no round repeats the ones before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.session import cut


def ancestors(nodes: DataFrame) -> DataFrame:
    """M2: (id, ancestor, depth), each node itself included at depth 0; ends at missing parents and cycles.

    Of a node on a cycle, or below one, every other node that its way up meets is told once. Repeated ids count
    once; null ids are no nodes.
    """
    ids = nodes.where("id is not null").select("id").distinct()
    links = nodes.where("parent is not null and id is not null and id <> parent").select(F.col("id").alias("_id"), F.col("parent").alias("_up")).distinct()
    jump = cut(links.join(ids.select(F.col("id").alias("_up")), "_up", "left_semi").select("_id", "_up"))
    found = ids.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    # a frame that was cut is taken for as small as the file it came from; broadcast by that, all of it is built up in the driver
    reach = 1
    while not jump.isEmpty():
        further = jump.hint("merge").join(found, jump["_up"] == found["id"]).select(F.col("_id").alias("id"), "ancestor", (F.col("depth") + reach).alias("depth"))
        found = cut(found.unionByName(further))
        twice = jump.join(jump.select(F.col("_id").alias("_up"), F.col("_up").alias("_top")).hint("merge"), "_up").select("_id", F.col("_top").alias("_up")).distinct()
        # who is met again has been told, with all beyond
        jump = cut(twice.join(found.select(F.col("id").alias("_id"), F.col("ancestor").alias("_up")).hint("merge"), ["_id", "_up"], "left_anti"))
        reach *= 2
    return found.groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))


def descendants(nodes: DataFrame) -> DataFrame:
    """M3, M4: (id, descendant, depth)."""
    return ancestors(nodes).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "depth")


def paths(nodes: DataFrame, by: str = "<") -> DataFrame:
    """M1: (id, path) leaf first; null where a parent is missing or a cycle is met."""
    up = ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor"), "name", "parent"), "ancestor")
    chain = up.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "name"))).alias("c"), F.max_by("parent", "depth").alias("_open"))
    return chain.select("id", F.when(F.col("_open").isNull(), F.array_join("c.name", by)).alias("path"))


def repair(nodes: DataFrame) -> DataFrame:
    """M5: blank ids go, the first of repeated ids stays (by name), unknown and own parents become roots; so do nodes on a cycle."""
    first = nodes.where("id is not null and trim(id) <> ''").groupBy("id").agg(F.min(F.struct("name", "parent")).alias("n")).select("id", "n.name", "n.parent")
    known = first.select(F.col("id").alias("_known"))
    held = first.join(known, first["parent"] == known["_known"], "left").select("id", "name", F.when(F.col("_known") != F.col("id"), F.col("_known")).alias("parent"))
    rooted = ancestors(held).join(held.where("parent is null").select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    fine = held.join(rooted.withColumn("_fine", F.lit(True)), "id", "left")
    return fine.select("id", "name", F.when(F.col("_fine"), F.col("parent")).alias("parent"))


def depth_first(nodes: DataFrame, order: str = "name") -> DataFrame:
    """M7: (id, depth, place): place sorts like a walk through the tree, children by order."""
    up = ancestors(nodes).join(nodes.select(F.col("id").alias("ancestor"), F.struct(order, F.col("id")).alias("_key")), "ancestor")
    return up.groupBy("id").agg(F.max("depth").alias("depth"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "_key")))), lambda x: x["_key"]).alias("place"))


def _jumps(nodes: DataFrame) -> DataFrame:
    """(id, up): each node once with a parent that is a node too, or null; of repeated ids the smallest parent."""
    once = nodes.where("id is not null").groupBy("id").agg(F.min(F.when(F.col("parent") != F.col("id"), F.col("parent"))).alias("_up"))
    known = once.select(F.col("id").alias("_known"))
    return once.hint("merge").join(known, F.col("_up") == F.col("_known"), "left").select("id", F.col("_known").alias("up"))


def reached(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the nodes that are seeds or stand below one, by a flag and a pointer a node that doubles its distance.

    A seed need not be a node itself: its children are reached. Cycles end when pointers have gone as far as there are
    nodes. Rows are never more than the nodes.
    """
    marks = seeds.select("id").where("id is not null").distinct().withColumn("_seed", F.lit(True))
    raw = nodes.where("id is not null and parent is not null").select("id", F.col("parent").alias("_raw"))
    own = raw.join(marks.select(F.col("id").alias("_raw")), "_raw", "left_semi").select("id").unionByName(marks.select("id")).distinct().withColumn("flag", F.lit(True))
    held = cut(_jumps(nodes).join(own, "id", "left").select("id", F.coalesce("flag", F.lit(False)).alias("flag"), "up"))
    n, reach = held.count(), 1
    while reach < n and not held.where("not flag and up is not null").isEmpty():
        above = held.select(F.col("id").alias("up"), F.col("flag").alias("_flag"), F.col("up").alias("_next"))
        # who is flagged needs no pointer any more, but leads those below to its flag
        held = cut(held.join(above, "up", "left").select("id", (F.col("flag") | F.coalesce("_flag", F.lit(False))).alias("flag"), F.col("_next").alias("up")))
        reach *= 2
    return held.where("flag").select("id")


def above(nodes: DataFrame, matching: DataFrame) -> DataFrame:
    """(id): the nodes in matching and all above them; flags go up along pointers that double their distance."""
    marks = matching.select("id").where("id is not null").distinct().withColumn("flag", F.lit(True))
    # nothing is broadcast by its guessed size, as for ancestors
    held = cut(_jumps(nodes).hint("merge").join(marks, "id", "left").select("id", F.coalesce("flag", F.lit(False)).alias("flag"), "up"))
    n, reach = held.count(), 1
    while reach < 2 * n and not held.where("flag and up is not null").isEmpty():
        told = held.where("flag and up is not null").select(F.col("up").alias("id"), F.lit(True).alias("_told")).distinct()
        next_ = held.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        flagged = held.hint("merge").join(told, "id", "left").select("id", (F.col("flag") | F.coalesce("_told", F.lit(False))).alias("flag"), "up")
        held = cut(flagged.hint("merge").join(next_, "up", "left").select("id", "flag", F.col("_next").alias("up")))
        reach *= 2
    return held.where("flag").select("id")


def keep_with_ancestors(nodes: DataFrame, matching: DataFrame) -> DataFrame:
    """M8: the nodes whose id is in matching, and all above them."""
    return nodes.join(above(nodes, matching), "id", "left_semi")


def cascade_delete(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes without the removed ones and all below them."""
    return nodes.join(reached(nodes, removed), "id", "left_anti")


def move(nodes: DataFrame, moved: DataFrame, target: str) -> DataFrame:
    """The topmost of the moved nodes get the target as parent; moves into their own subtree are rejected."""
    chain = ancestors(nodes)
    asked = moved.select("id").distinct()
    inner = chain.where("depth > 0").join(asked, "id", "left_semi").join(asked.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    above = chain.where(F.col("id") == target).select(F.col("ancestor").alias("id"))
    top = asked.join(inner, "id", "left_anti").join(above, "id", "left_anti").withColumn("_moved", F.lit(True))
    return nodes.join(top, "id", "left").select("id", "name", F.when(F.col("_moved"), F.lit(target)).otherwise(F.col("parent")).alias("parent"))


def copy(nodes: DataFrame, roots: DataFrame, mark: str) -> DataFrame:
    """Copies of the subtrees under new ids made of a mark and the old ones; copied roots keep their parent."""
    below = ancestors(nodes).join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    inside = nodes.join(below, "id", "left_semi")
    there = below.select(F.col("id").alias("parent"), F.lit(True).alias("_inside"))
    new = lambda c: F.sha2(F.concat(F.lit(mark), F.col(c)), 256)
    return inside.join(there, "parent", "left").select(new("id").alias("id"), "name", F.when(F.col("_inside"), new("parent")).otherwise(F.col("parent")).alias("parent"))


def from_paths(rows: DataFrame, path: str = "path") -> DataFrame:
    """M6: the nodes (id, name, parent) along root-first paths of names; an id is a hash of its path, so equal paths meet."""
    steps = rows.select(F.explode(F.expr(f"transform(sequence(1, size({path})), n -> slice({path}, 1, n))")).alias("p")).where("size(p) > 0")
    key = lambda p: F.sha2(F.array_join(p, ">"), 256)
    made = steps.select(key(F.col("p")).alias("id"), F.element_at("p", -1).alias("name"), F.when(F.size("p") > 1, key(F.slice("p", 1, F.size("p") - 1))).alias("parent"))
    return made.distinct()


def merge_paths(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: keyword paths put into a tree: (id, name, parent, synonyms) with what was missing, and (path, id) of their ends.

    nodes: (id, name, parent, synonyms); paths: (path, names, synonyms), names from the top. Along a path the child of
    that name is taken; of several with one parent and name the one with the smallest id. Where there is none, nodes are
    made, with a hash of parent and name as id, so equal paths meet. A path's synonyms join those of its end, each once: old ones
    first, then by path. Paths without names, or with a null among them, end nowhere. Each level of the existing tree
    that paths still follow is one join; what has left it is finished in one step.
    """
    known = cut(nodes.where("id is not null").groupBy(F.col("parent").alias("_parent"), F.col("name").alias("_name")).agg(F.min("id").alias("_id")))
    fine = (F.size("names") > 0) & ~F.exists("names", lambda n: n.isNull())
    wanted = paths.where(F.coalesce(fine, F.lit(False)))
    live = cut(wanted.select("names").distinct().select("names", F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("at")))
    ends, left, level = None, None, 1
    while not live.isEmpty():
        name = F.element_at("names", level)
        child = F.col("at").eqNullSafe(F.col("_parent")) & (name == F.col("_name"))
        step = cut(live.join(known, child, "left").select("names", "at", F.col("_id").alias("id")))
        off = step.where("id is null").select("names", "at", F.lit(level).alias("level"))
        done = step.where((F.col("id").isNotNull()) & (F.size("names") == level)).select("names", "id")
        left = off if left is None else left.unionByName(off)
        ends = done if ends is None else ends.unionByName(done)
        live = step.where((F.col("id").isNotNull()) & (F.size("names") > level)).select("names", F.col("id").alias("at"))
        level += 1
    if left is None:
        return nodes, paths.select("path", F.lit(None).cast("string").alias("id")).limit(0)
    kind = "array<struct<id:string,name:string,parent:string>>"
    start = F.struct(F.col("at").alias("at"), F.array().cast(kind).alias("made"))

    def grow(acc, name):
        id_ = F.sha2(F.concat(F.coalesce(acc["at"], F.lit("")), F.lit(">"), name), 256)
        return F.struct(id_.alias("at"), F.array_append(acc["made"], F.struct(id_.alias("id"), name.alias("name"), acc["at"].alias("parent"))).alias("made"))

    rest = F.slice("names", F.col("level"), F.size("names") - F.col("level") + 1)
    grown = left.select("names", F.aggregate(rest, start, grow).alias("g"))
    fresh = grown.select(F.explode("g.made").alias("n")).select("n.*").distinct()
    reached_ends = wanted.join(ends.unionByName(grown.select("names", F.col("g.at").alias("id"))), "names")
    leaves = reached_ends.select("path", "id")
    words = reached_ends.select("id", "path", F.explode("synonyms").alias("w")).where("w is not null").groupBy("id", "w").agg(F.min("path").alias("first"))
    added = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first", "w"))).alias("_w")).select("id", F.col("_w.w").alias("_added"))
    everyone = nodes.select("id", "name", "parent", "synonyms").unionByName(fresh.withColumn("synonyms", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    out = everyone.join(added, "id", "left").select("id", "name", "parent", F.array_union(F.coalesce("synonyms", none), F.coalesce("_added", none)).alias("synonyms"))
    return out, leaves
