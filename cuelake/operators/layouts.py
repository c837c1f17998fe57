"""Layout trees as rows: nodes (doc, id, parent, kind, axis, ratio) of splits and areas, and the panels in areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.trees import above
from cuelake.session import cut

# fixed values: a layout document's fields, and the bounds of a split's ratio
LAYOUT_XML = "focused string, panels struct<panel: array<struct<_id: string, _type: string>>>, nodes struct<node: array<struct<_id: string, _parent: string, _kind: string, _axis: string, _ratio: double, _tabs: string>>>"
RATIO = (0.05, 0.95)


def parse_layouts(files: DataFrame, deal: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, panels, tabs) of XML documents (doc, xml); a null or blank document has none.

    nodes: (doc, id, parent, kind, axis, ratio, place), place being the number in the document, panels: (doc, id, type), tabs: (doc, area, panel).
    Each document is read once, whatever is asked of it: what was read is written to the checkpoint folder. deal=False: files
    lie in many tasks already.
    """
    # no filter on xml: the optimiser moves it below what deals the documents out, where few tasks write all of them to look
    x = F.when(F.trim("xml") != "", F.from_xml(F.col("xml"), F.lit(LAYOUT_XML)))
    read = cut((dealt(files) if deal else files).select("doc", x.alias("x")))
    nodes = read.select("doc", F.posexplode("x.nodes.node").alias("place", "n")).select("doc", "place", F.col("n._id").alias("id"), F.nullif(F.col("n._parent"), F.lit("")).alias("parent"), F.col("n._kind").alias("kind"), F.col("n._axis").alias("axis"), F.col("n._ratio").alias("ratio"), F.col("n._tabs").alias("_tabs"))
    panels = read.select("doc", F.explode("x.panels.panel").alias("p")).select("doc", F.col("p._id").alias("id"), F.col("p._type").alias("type"))
    tabs = nodes.where("kind = 'area'").select("doc", F.col("id").alias("area"), F.explode(F.filter(F.split(F.coalesce("_tabs", F.lit("")), " "), lambda x: x != "")).alias("panel"))
    return nodes.drop("_tabs"), panels, tabs


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out by doc over as many tasks as a shuffle has: documents are dear to read and write, but small files make few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")


def layout_xml(panels: Column, nodes: Column, focused: Column) -> Column:
    """A document of arrays of structs with the fields of LAYOUT_XML."""
    return F.to_xml(F.struct(focused.alias("focused"), F.struct(panels.alias("panel")).alias("panels"), F.struct(nodes.alias("node")).alias("nodes")))


def valid(files: DataFrame, deal: bool = True) -> DataFrame:
    """The documents (doc, xml) that break no rule and can be written; one without a node has no root and can't."""
    good = _judged(*parse_layouts(files, deal)).where((F.col("n") > 0) & (F.size("problems") == 0))
    return files.join(good, "doc", "left_semi")


def problems(nodes: DataFrame, panels: DataFrame, tabs: DataFrame) -> DataFrame:
    """(doc, problem): every rule that a layout breaks.

    'node': an id that is blank or occurs twice; 'split': an axis other than x and y, a ratio outside its bounds
    or not two children; 'panel': a blank or repeated panel; 'docked': a panel in no area or in several; 'unknown':
    a tab without its panel; 'root': not exactly one node without a parent, or a parent that is no split.
    """
    return _judged(nodes, panels, tabs).select("doc", F.explode("problems").alias("problem"))


def _judged(nodes: DataFrame, panels: DataFrame, tabs: DataFrame) -> DataFrame:
    """(doc, n, problems): the number of a layout's nodes and the rules it breaks, found by counting once what stands under each id."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    fine = F.coalesce(F.col("axis").isin("x", "y") & F.col("ratio").between(*RATIO), F.lit(False))
    split, no = F.coalesce(F.col("kind") == "split", F.lit(False)), F.lit(False)
    text = lambda c: F.col(c).cast("string").alias("id")

    def fact(id_: Column, what: str, bad: Column = no, split: Column = no, root: Column = no) -> Column:
        return F.struct(id_, F.lit(what).alias("what"), bad.alias("bad"), split.alias("split"), root.alias("root"))

    own = fact(text("id"), "node", split & ~fine, split, F.col("parent").isNull())
    child = F.when(F.col("parent").isNotNull(), fact(text("parent"), "child"))
    facts = nodes.select("doc", F.explode(F.array(own, child)).alias("f")).where("f is not null")
    facts = facts.unionByName(panels.select("doc", fact(text("id"), "panel", F.coalesce(blank("type"), no)).alias("f")))
    facts = facts.unionByName(tabs.select("doc", fact(text("panel"), "tab").alias("f"))).select("doc", "f.*")
    n = lambda what: F.count_if(F.col("what") == what)
    space = F.col("what").isin("node", "child").alias("_tree")
    held = facts.groupBy("doc", space, "id").agg(
        n("node").alias("nodes"), n("child").alias("children"), n("panel").alias("panels"), n("tab").alias("tabs"),
        F.max("bad").alias("bad"), F.max("split").alias("split"), F.count_if("root").alias("roots"),
    )
    c = F.col
    here = c("id").isNotNull()  # null is nobody's child and no tab's panel
    told = {
        "node": (c("nodes") > 1) | ((c("nodes") > 0) & blank("id")),
        "split": c("split") & (c("bad") | ~here | (c("children") != 2)),
        "root": (c("children") > 0) & ~c("split"),
        "panel": (c("panels") > 1) | ((c("panels") > 0) & (c("bad") | blank("id"))),
        "docked": ((c("panels") > 0) & (~here | (c("tabs") == 0))) | (c("tabs") > 1),
        "unknown": (c("tabs") > 0) & (~here | (c("panels") == 0)),
    }
    tree = ("node", "split", "root")
    by = held.groupBy("doc").agg(*[F.max((c("_tree") == F.lit(k in tree)) & rule).alias(k) for k, rule in told.items()], F.sum("roots").alias("_r"), F.sum("nodes").alias("n"))
    found = {**{k: c(k) for k in told}, "root": c("root") | ((c("n") > 0) & (c("_r") != 1))}
    return by.select("doc", "n", F.array_compact(F.array(*[F.when(bad, k) for k, bad in found.items()])).alias("problems"))


def _followed(held: DataFrame, looked: list[str], step) -> DataFrame:
    """held (doc, id, up, ...) with up followed by doubling its distance, until none is left: step(_o) gives the columns that a row
    takes from the one that up names, where _o holds up and the looked columns of that row, or is null if there is none.

    Ends after as many rounds as the number of the largest layout's rows has binary digits, also on cycles.
    """
    first, n, reach = held, None, 1
    while not held.where("up is not null").isEmpty():
        if reach > 8 and n is None:
            n = first.groupBy("doc").count().agg(F.max("count")).first()[0]
        if n is not None and reach > n:
            return held
        over = held.select("doc", F.col("id").alias("up"), F.struct("up", *looked).alias("_o"))
        # frames that were cut are taken for as small as the file they came from; broadcast by that, all of it is built up in the driver
        joined = held.hint("merge").join(over, ["doc", "up"], "left")
        taken = {"up": F.col("_o.up"), **{c: F.when(F.col("_o").isNotNull(), v).otherwise(F.col(c)) for c, v in step(F.col("_o")).items()}}
        held = cut(joined.select(*[taken.get(c, F.col(c)).alias(c) for c in held.columns]))
        reach *= 2
    return held


def numbered(nodes: DataFrame, tabs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, tabs) of parsed layouts with a node's place in the document as its id, and the id as its name.

    Nodes whose ids are repeated are nodes of their own then. A parent stands for the first split of that name, and is null
    if there is none. Areas of one name have the same panels.
    """
    splits = nodes.where("kind = 'split'").groupBy("doc", F.col("id").alias("parent")).agg(F.min("place").alias("_up"))
    own = nodes.hint("merge").join(splits, ["doc", "parent"], "left")
    tree = own.select("doc", F.col("place").alias("id"), F.col("_up").alias("parent"), "kind", "axis", "ratio", "place", F.col("id").alias("name"))
    areas = nodes.where("kind = 'area'").select("doc", F.col("id").alias("area"), "place")
    return cut(tree), areas.hint("merge").join(tabs, ["doc", "area"]).select("doc", F.col("place").alias("area"), "panel")


def rectangles(nodes: DataFrame, turns: bool = False) -> DataFrame:
    """(doc, id, kind, x, y, width, height): where each node lies in the unit square.

    A split hands its first child (by place) the ratio of its width (axis x) or height (any other axis), the other the rest.
    Each node's map to its parent is composed with the parent's own, at doubled distances, so deep layouts take few rounds.
    Nodes with an unknown parent lie like roots; a null ratio is a half. What else nodes hold is kept. turns=True adds the
    numbers of the children (0, 1) that lead from the root to a node: sorted by them, areas are listed as in the tree;
    a node on or below a cycle has none (null).
    """
    split = nodes.where("kind = 'split'").select("doc", F.col("id").alias("parent"), F.when(F.col("axis") == "x", "x").otherwise("y").alias("_axis"), F.coalesce("ratio", F.lit(0.5)).alias("_r"))
    nth = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("place", "id")) - 1
    rows = nodes.hint("merge").join(split, ["doc", "parent"], "left").withColumn("_nth", nth).withColumn("_first", F.col("_nth") == 0)
    size = lambda axis: F.when(F.col("_axis") == axis, F.when(F.col("_first"), F.col("_r")).otherwise(1 - F.col("_r"))).otherwise(F.lit(1.0))
    start = lambda axis: F.when((F.col("_axis") == axis) & ~F.col("_first"), F.col("_r")).otherwise(F.lit(0.0))
    up = F.when(F.col("_r").isNotNull(), F.col("parent"))
    more = [c for c in nodes.columns if c not in ("doc", "id", "parent", "axis", "ratio", "place")]
    way = [F.when(F.col("_r").isNotNull(), F.array("_nth")).otherwise(F.array().cast("array<int>")).alias("turns")] if turns else []
    own = cut(rows.select("doc", "id", *more, up.alias("up"), start("x").alias("x"), start("y").alias("y"), size("x").alias("width"), size("y").alias("height"), *way))

    def composed(o: Column) -> dict[str, Column]:
        within = lambda at, size: o[at] + o[size] * F.col(at)
        led = {"turns": F.concat(o["turns"], F.col("turns"))} if turns else {}
        return {"x": within("x", "width"), "y": within("y", "height"), "width": o["width"] * F.col("width"), "height": o["height"] * F.col("height"), **led}

    found = _followed(own, ["x", "y", "width", "height", *(["turns"] if turns else [])], composed)
    return (found.withColumn("turns", F.when(F.col("up").isNull(), F.col("turns"))) if turns else found).drop("up")


def pruned(nodes: DataFrame, tabs: DataFrame, fallback: str | int) -> DataFrame:
    """The nodes of each layout without its empty areas; a split with one child left gives its place to it.

    tabs: (doc, area, panel). A layout with no panel at all becomes one area, the fallback.
    """
    key = lambda c: F.struct(F.col("doc"), F.col(c).alias("id"))
    nodes = cut(nodes)
    keyed = nodes.select(key("id").alias("id"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent"))
    filled = nodes.where("kind = 'area'").join(tabs.select("doc", F.col("area").alias("id")).distinct().hint("merge"), ["doc", "id"], "left_semi")
    stay = above(keyed, filled.select(key("id").alias("id"))).select("id.doc", "id.id")
    kept = cut(nodes.join(stay.hint("merge"), ["doc", "id"], "left_semi"))
    children = kept.where("parent is not null").groupBy("doc", F.col("parent").alias("id")).agg(F.count("*").alias("_n"))
    own = kept.withColumn("up", F.when(F.count("parent").over(Window.partitionBy("doc", "parent")) == 1, F.col("parent")))
    held = own.hint("merge").join(children, ["doc", "id"], "left")
    # up: the parent if it gives its place away
    moved = _followed(cut(held), ["parent", "place"], lambda o: {"parent": o["parent"], "place": o["place"]})
    out = moved.where(F.coalesce("_n", F.lit(0)) != 1).select(*nodes.columns)
    kinds = dict(nodes.dtypes)
    alone = {"doc": F.col("doc"), "id": F.lit(fallback), "kind": F.lit("area"), "place": F.lit(0)}
    empty = nodes.select("doc").distinct().join(kept.select("doc").distinct().hint("merge"), "doc", "left_anti")
    return out.unionByName(empty.select(*[alone.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in nodes.columns]))


def with_ratios(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Splits named in changes (doc, split, ratio) get that ratio; areas and unknown names stay."""
    news = changes.select("doc", F.col("split").alias("id"), F.col("ratio").alias("_ratio"))
    set_ = F.when((F.col("kind") == "split") & F.col("_ratio").isNotNull(), F.col("_ratio")).otherwise(F.col("ratio"))
    return nodes.hint("merge").join(news, ["doc", "id"], "left").withColumn("ratio", set_).select(*nodes.columns)


def with_areas(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Areas named in changes (doc, area, split, axis, ratio, added, leads) are replaced by a split of themselves and a
    new area, which comes first if leads is true. Each area may be named once; unknown ones change nothing. What else an area's
    row holds goes with it; the new rows hold null there."""
    news = changes.withColumnRenamed("area", "id").select("doc", "id", F.struct("split", "axis", "ratio", "added", "leads").alias("_c"))
    kinds, c = dict(nodes.dtypes), F.col("_c")

    def row(**have: Column) -> Column:
        return F.struct(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    own = {n: F.col(n) for n in nodes.columns}
    nth = lambda leads: F.when(leads, 0).otherwise(1)
    split = row(doc=F.col("doc"), id=c["split"], parent=F.col("parent"), kind=F.lit("split"), axis=c["axis"], ratio=c["ratio"], place=F.col("place"))
    added = row(doc=F.col("doc"), id=c["added"], parent=c["split"], kind=F.lit("area"), place=nth(c["leads"]))
    moved = row(**{**own, "parent": c["split"], "place": 1 - nth(c["leads"])})
    hit = (F.col("kind") == "area") & c.isNotNull()
    rows = F.when(hit, F.array(split, added, moved)).otherwise(F.array(row(**own)))
    return nodes.hint("merge").join(news, ["doc", "id"], "left").select(F.explode(rows).alias("_r")).select("_r.*")


def docked_beside(nodes: DataFrame, tabs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered (nodes, tabs) after moves (doc, panel, name, axis, leads): the panel leaves its areas for a new one beside each
    area of that name, half to half, which comes first if leads is true. A layout may have one move; unknown areas change nothing.

    The new rows have no name; their ids are below -1.
    """
    areas = nodes.where("kind = 'area'").select("doc", "name", F.col("id").alias("area"))
    real = cut(areas.hint("merge").join(moves, ["doc", "name"]).withColumn("added", -3 - 2 * F.col("area")))
    changes = real.select("doc", "area", (F.col("added") + 1).alias("split"), "axis", F.lit(0.5).alias("ratio"), "added", "leads")
    left = tabs.hint("merge").join(real.select("doc", "panel").distinct(), ["doc", "panel"], "left_anti")
    return with_areas(nodes, changes), left.select("doc", "area", "panel").unionByName(real.select("doc", F.col("added").alias("area"), "panel"))
