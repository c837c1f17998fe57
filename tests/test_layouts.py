"""Layout trees: rectangles, pruning and replaced areas."""

import pytest

from cuelake.operators import layouts

NODES = "doc long, id string, parent string, kind string, axis string, ratio double, place int"
TABS = "doc long, area string, panel string"


def split(doc, id_, parent, axis, ratio, place=0):
    return (doc, id_, parent, "split", axis, ratio, place)


def area(doc, id_, parent, place=0):
    return (doc, id_, parent, "area", None, None, place)


def rects(df):
    return {(r["doc"], r["id"]): tuple(round(r[c], 9) for c in ("x", "y", "width", "height")) for r in layouts.rectangles(df).collect()}


def test_rectangles(spark):
    rows = [split(1, "s", None, "x", 0.25), area(1, "a", "s", 0), split(1, "t", "s", "y", None, 1), area(1, "b", "t", 5), area(1, "c", "t", 3), area(2, "s", None), area(2, "lost", "gone")]
    got = rects(spark.createDataFrame(rows, NODES).repartition(3))
    assert got[1, "s"] == (0, 0, 1, 1) and got[1, "a"] == (0, 0, 0.25, 1) and got[1, "t"] == (0.25, 0, 0.75, 1)
    # the smaller place comes first, a null ratio is a half
    assert got[1, "c"] == (0.25, 0, 0.75, 0.5) and got[1, "b"] == (0.25, 0.5, 0.75, 0.5)
    assert got[2, "s"] == got[2, "lost"] == (0, 0, 1, 1) and len(got) == 7
    assert rects(spark.createDataFrame([], NODES)) == {}


def test_deep_layouts(spark):
    depth = 40
    rows = [split(1, f"s{k}", f"s{k - 1}" if k else None, "xy"[k % 2], 0.5, 1) for k in range(depth)] + [area(1, f"a{k}", f"s{k}", 0) for k in range(depth)] + [area(1, "end", f"s{depth - 1}", 1)]
    nodes = spark.createDataFrame(rows, NODES)
    x = y = 0.0
    w = h = 1.0
    for k in range(depth):
        x, w, y, h = (x + w / 2, w / 2, y, h) if k % 2 == 0 else (x, w, y + h / 2, h / 2)
    got = next(r for r in layouts.rectangles(nodes).collect() if r["id"] == "end")
    assert (got["x"], got["y"], got["width"], got["height"]) == pytest.approx((x, y, w, h))
    # all but two areas are empty: one split is left
    tabs = spark.createDataFrame([(1, "a3", "p"), (1, "end", "q"), (1, "end", "r")], TABS)
    left = {r["id"]: (r["parent"], r["place"]) for r in layouts.pruned(nodes, tabs, "x").collect()}
    assert left == {"s3": (None, 1), "a3": ("s3", 0), "end": ("s3", 1)}


def test_pruning_without_panels_and_replaced_areas(spark):
    nodes = spark.createDataFrame([split(1, "s", None, "x", 0.5), area(1, "a", "s", 0), area(1, "b", "s", 1), area(2, "a", None)], NODES)
    tabs = spark.createDataFrame([(1, "b", "p"), (1, "unknown", "q")], TABS)
    left = sorted((r["doc"], r["id"], r["parent"], r["kind"], r["place"]) for r in layouts.pruned(nodes, tabs, "main").collect())
    assert left == [(1, "b", None, "area", 0), (2, "main", None, "area", 0)]
    changes = spark.createDataFrame([(1, "b", "t", "y", 0.3, "new", True), (2, "a", "t", "x", 0.4, "new", False), (2, "none", "u", "x", 0.4, "v", False)], "doc long, area string, split string, axis string, ratio double, added string, leads boolean")
    more = layouts.with_areas(nodes, changes)
    got = rects(layouts.with_ratios(more, spark.createDataFrame([(1, "s", 0.2), (1, "a", 0.9), (9, "s", 0.1)], "doc long, split string, ratio double")))
    assert got[1, "a"] == (0, 0, 0.2, 1) and got[1, "new"] == (0.2, 0, 0.8, 0.3) and got[1, "b"] == (0.2, 0.3, 0.8, 0.7)
    assert got[2, "a"] == (0, 0, 0.4, 1) and got[2, "new"] == (0.4, 0, 0.6, 1) and len(got) == 8


def test_each_document_is_read_once(spark):
    """However many rules look at it, and by more than one task though it comes from one."""
    from pyspark.sql import functions as F

    files = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc"), F.lit('<ROW><focused>p</focused><panels><panel id="p" type="t"/></panels><nodes><node id="a" kind="area" tabs="p"/></nodes></ROW>').alias("xml"))
    nodes, panels, tabs = layouts.parse_layouts(files)
    found = layouts.problems(nodes, panels, tabs)
    for out in (nodes, panels, tabs, found):
        assert "from_xml" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert nodes.rdd.getNumPartitions() > 1
    assert nodes.count() == panels.count() == tabs.count() == 64 and found.count() == 0


def test_rules_of_odd_layouts(spark):
    rows = [
        split(1, "s", None, "x", 0.5), area(1, "a", "s"), area(1, "b", "s"),
        split(2, None, None, "x", 0.5), area(2, " ", None),
        split(3, "s", None, "x", 0.5), split(3, "s", "s", "y", None), area(3, "s", "s"),
        area(4, "a", "gone"), split(5, "s", None, "x", 0.96), area(5, "a", "s"), area(6, "a", None), split(6, "t", "a", "y", 0.05),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    panels = spark.createDataFrame([(1, "p", "t"), (1, "q", "t"), (2, None, "t"), (2, "r", " "), (6, "p", "t"), (6, "p", "t"), (8, "p", None)], "doc long, id string, type string")
    tabs = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "x", None), (6, "a", "p"), (6, "t", "p"), (7, "a", "p")], TABS)
    got = {}
    for r in layouts.problems(nodes, panels, tabs).collect():
        got.setdefault(r["doc"], []).append(r["problem"])
    assert {k: sorted(v) for k, v in got.items()} == {
        2: ["docked", "node", "panel", "root", "split", "unknown"], 3: ["node", "split"], 4: ["root"], 5: ["split"],
        6: ["docked", "panel", "root", "split"], 7: ["unknown"], 8: ["docked", "panel"],
    }


def test_documents_are_written_by_the_tasks_that_read_them(spark, monkeypatch):
    """What deals out the keys of documents stands below the writing of all XML: one file's task writes none, not even to look at it."""
    from pyspark.sql import functions as F

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    parsed, real = [], layouts.cut
    monkeypatch.setattr(layouts, "cut", lambda df: parsed.append(plan(df)) or real(df))
    node = F.struct(F.lit("a").alias("_id"), F.when(F.col("doc") % 2 == 0, "gone").alias("_parent"), F.lit("area").alias("_kind"), F.lit("p").alias("_tabs"))
    panel = F.struct(F.lit("p").alias("_id"), F.lit("t").alias("_type"))
    keys = layouts.dealt(spark.range(0, 64, 1, 1).select(F.col("id").alias("doc")))
    files = keys.select("doc", layouts.layout_xml(F.array(panel), F.array(node), F.lit("p")).alias("xml"))
    good = layouts.valid(files, deal=False)
    below = lambda text: text.split("RepartitionByExpression", 1)[1]
    assert "to_xml" in parsed[0] and "to_xml" not in below(parsed[0]) and parsed[0].count("RepartitionByExpression") == 1
    assert "to_xml" in plan(good) and "to_xml" not in below(plan(good))
    assert {r["doc"] for r in good.collect()} == set(range(1, 64, 2))


def test_blank_documents_hold_nothing(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, '<ROW><nodes><node id="a" kind="area"/></nodes></ROW>'), (5, "<ROW><focused>p</focused></ROW>")]
    files = spark.createDataFrame(rows, "doc long, xml string")
    nodes, panels, tabs = layouts.parse_layouts(files)
    assert [r["doc"] for r in nodes.collect()] == [4] and panels.count() == tabs.count() == 0
    assert [r["doc"] for r in layouts.valid(files).collect()] == [4]


def test_links_of_a_tree_are_not_broadcast_by_a_guess(spark, monkeypatch):
    """A frame that was cut counts as small as the file it came from, however many rows it has."""
    from cuelake.operators import trees

    plans, real = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    nodes = spark.range(6).selectExpr("id", "nullif(id, 0) - 1 AS parent")
    got = {(r["id"], r["ancestor"], r["depth"]) for r in trees.ancestors(nodes).collect()}
    assert got == {(k, k - d, d) for k in range(6) for d in range(k + 1)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans[1:])


def moves(spark, rows):
    return spark.createDataFrame(rows, "doc long, panel string, name string, axis string, leads boolean")


def test_numbered_layouts_keep_repeated_ids(spark):
    rows = [split(1, "s", "gone", "z", 0.25), area(1, "a", "s", 1), area(1, "a", "s", 2), area(1, "c", "none", 3), split(2, "s", "t", "x", 0.5), split(2, "t", "s", "x", 0.5, 1), area(2, "a", "t", 2)]
    tabs = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (2, "b", "p")], TABS)
    tree, docked = layouts.numbered(spark.createDataFrame(rows, NODES), tabs)
    assert {(r["doc"], r["id"]): (r["parent"], r["name"]) for r in tree.collect()} == {(1, 0): (None, "s"), (1, 1): (0, "a"), (1, 2): (0, "a"), (1, 3): (None, "c"), (2, 0): (1, "s"), (2, 1): (0, "t"), (2, 2): (1, "a")}
    assert sorted(tuple(r) for r in docked.collect()) == [(1, 1, "p"), (1, 1, "q"), (1, 2, "p"), (1, 2, "q")]
    got = {(r["doc"], r["id"]): (r["turns"], r["y"], r["height"], r["name"]) for r in layouts.rectangles(tree, turns=True).collect()}
    # an axis that is not x divides the height, as in the interface; what is on or below a cycle has no place in the list
    assert got[1, 1] == ([0], 0, 0.25, "a") and got[1, 2] == ([1], 0.25, 0.75, "a") and got[1, 3][0] == got[1, 0][0] == []
    assert [got[2, i][0] for i in range(3)] == [None, None, None] and len(got) == 7


def test_panels_docked_beside_an_area(spark):
    nodes = [split(1, "s", None, "x", 0.5), area(1, "a", "s", 1), area(1, "b", "s", 2), area(2, "a", None), area(3, "a", None)]
    tree, docked = layouts.numbered(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "a", "p"), (3, "a", "p")], TABS))
    changed, docked = layouts.docked_beside(tree, docked, moves(spark, [(1, "q", "b", "y", True), (2, "p", "none", "x", True), (3, "r", "a", "x", False)]))
    assert sorted(tuple(r) for r in docked.collect()) == [(1, -7, "q"), (1, 1, "p"), (2, 0, "p"), (3, -3, "r"), (3, 0, "p")]
    got = {(r["doc"], r["id"]): (r["parent"], r["kind"], r["name"], r["place"], r["ratio"]) for r in changed.collect()}
    assert got[1, -6] == (0, "split", None, 2, 0.5) and got[1, -7] == (-6, "area", None, 0, None) and got[1, 2] == (-6, "area", "b", 1, None)
    assert got[3, 0] == (-2, "area", "a", 0, None) and got[3, -3] == (-2, "area", None, 1, None) and got[2, 0] == (None, "area", "a", 0, None)
    left = {(r["doc"], r["id"]): (r["parent"], r["place"]) for r in layouts.pruned(changed, docked, -1).collect()}
    assert left == {(1, 0): (None, 0), (1, 1): (0, 1), (1, -7): (0, 2), (2, 0): (None, 0), (3, -2): (None, 0), (3, 0): (-2, 0), (3, -3): (-2, 1)}


def panels_managed(doc):
    """What the interface's functions make of a document of tree_layout: (leaf list before, after, centres), on nested nodes."""
    k, turn, panel, target = doc % 9, doc // 9 % 6, "qp"[doc // 54 % 2], "ab"[doc // 108 % 2]
    right = "a" if k == 5 else "b"
    root = {"id": "s", "axis": "z" if k == 3 else "x", "ratio": 0.96 if k == 1 else 0.5, "sides": ["a", right]}
    areas = {"a": set(), right: set()}
    areas["a"] |= {"p", "q"} if k == 4 else {"p"}
    areas[right] |= {6: {"q", "r"}, 7: set()}.get(k, {"q"})

    def listed(node):
        return [node] if isinstance(node, str) else [name for side in node["sides"] for name in listed(side)]

    def replaced(node):
        if isinstance(node, str):
            return {"id": None, "axis": "x" if turn < 2 else "y", "ratio": 0.5, "sides": ["n", node] if turn % 2 == 0 else [node, "n"]} if node == target else node
        return {**node, "sides": [replaced(side) for side in node["sides"]]}

    def pruned(node):
        if isinstance(node, str):
            return node if areas[node] else None
        sides = [side for side in map(pruned, node["sides"]) if side]
        return {**node, "sides": sides} if len(sides) == 2 else (sides or [None])[0]

    def centers(node, x, y, w, h):
        if isinstance(node, str):
            return [(x + w / 2, y + h / 2)]
        one, two = node["sides"]
        if node["axis"] == "x":
            part = w * node["ratio"]
            return centers(one, x, y, part, h) + centers(two, x + part, y, w - part, h)
        part = h * node["ratio"]
        return centers(one, x, y, w, part) + centers(two, x, y + part, w, h - part)

    before = listed(root)
    if doc % 3:
        root["ratio"] = min(max(doc % 11 / 10, 0.05), 0.95)
    gone = {"p", "q"} if turn == 4 else {panel} if turn < 4 and target in areas else set()
    areas = {name: held - gone for name, held in areas.items()}
    if turn < 4 and target in areas:
        root, areas["n"] = replaced(root), {panel}
    root = pruned(root) or "a"
    return ",".join(before), ",".join(listed(root)), ",".join(f"{x * 1e6:.0f} {y * 1e6:.0f}" for x, y in centers(root, 0.0, 0.0, 1.0, 1.0))


def test_tree_layout_takes_every_step_on_every_document(spark, sf_dir, tmp_path):
    """Documents without a root or with repeated ids too; the plain form is nested, as the interface's."""
    from cuelake.plans import catalog

    # two whole rounds of what a document's number decides
    spark.range(216).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["doc"]: r for r in catalog.queries()["tree_layout"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(216)) and {(r["areas"], r["splits"], r["depth"]) for r in got.values()} == {(2, 1, 1)}
    assert {doc: (r["leaves"], r["edited"], r["centers"]) for doc, r in got.items()} == {doc: panels_managed(doc) for doc in got}


def test_layouts_are_not_broadcast_by_a_guess(spark, monkeypatch):
    """Neither to be edited, nor pruned, nor laid out: frames that were cut count as small as the file they came from."""
    from cuelake.operators import trees

    plans, real = [], layouts.cut
    caught = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
    monkeypatch.setattr(layouts, "cut", caught)
    monkeypatch.setattr(trees, "cut", caught)
    nodes = spark.range(6).selectExpr("id AS doc", "explode(array('s', 'a', 'b')) AS id").selectExpr("doc", "id", "if(id = 's', null, 's') AS parent", "if(id = 's', 'split', 'area') AS kind", "'x' AS axis", "0.5D AS ratio", "if(id = 's', 0, ascii(id) - 96) AS place")
    tabs = spark.range(6).selectExpr("id AS doc", "'a' AS area", "'p' AS panel")
    tree, docked = layouts.numbered(nodes, tabs)
    tree = layouts.with_ratios(tree, tree.selectExpr("doc", "id AS split", "0.2D AS ratio"))
    tree, docked = layouts.docked_beside(tree, docked, tabs.selectExpr("doc", "'p' AS panel", "'b' AS name", "'x' AS axis", "true AS leads"))
    assert layouts.rectangles(layouts.pruned(tree, docked, -1)).count() == 6
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
