"""Folders with bound items and keyword paths, against plain loops."""

import random

import pytest

from cuelake.operators import bins, trees

FOLDERS, ITEMS = "id string, parent string", "id string, kind string, bin string, bound string, hidden boolean"


def plain_within(folders, items, folder_ids, item_ids):
    known = {f[0] for f in folders}
    inside = {f for f in folder_ids if f in known}
    held = set(item_ids)
    for _ in range(len(folders) + len(items) + 1):
        inside |= {i for i, p in folders if p in inside}
        held |= {i for i, _, b, to, _ in items if b in inside or to in held}
    return inside, held & {i[0] for i in items}


@pytest.fixture(scope="module")
def state():
    rng = random.Random(6)
    folders = [(f"f{k}", rng.choice([None, "gone", *(f"f{n}" for n in range(max(0, k - 6), k))])) for k in range(60)] + [("a", "b"), ("b", "a"), ("self", "self")]
    items = [(f"i{k}", rng.choice(["video", "audio", None]), rng.choice([None, "gone", *(f[0] for f in folders)]), rng.choice([None, None, "lost", *(f"i{n}" for n in range(max(0, k - 4), k))]), True) for k in range(150)]
    items += [("x", "audio", None, "y", None), ("y", "audio", None, "x", None)]
    return folders, items


def frames(spark, state):
    return spark.createDataFrame(state[0], FOLDERS).repartition(3), spark.createDataFrame(state[1], ITEMS).repartition(3)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.mark.parametrize("picked", [(["f3", "f20", "nowhere", None], ["i7", "lost", "x"]), (["a"], []), ([], [])])
def test_delete_follows_folders_and_bindings(spark, state, picked):
    got = bins.delete_entries(*frames(spark, state), ids(spark, picked[0]), ids(spark, picked[1]))
    inside, held = plain_within(*state, *picked)
    assert sorted(r["id"] for r in got[0].collect()) == sorted(f[0] for f in state[0] if f[0] not in inside)
    assert sorted(tuple(r) for r in got[1].select("id", "bin", "bound").fillna("").collect()) == sorted((i, b or "", to or "") for i, _, b, to, _ in state[1] if i not in held)


def test_move_takes_bound_items_along(spark):
    folders = [("t", None), ("f", None), ("g", "f"), ("h", "g")]
    items = [("v", "video", "f", None, None), ("s", "audio", "f", "v", None), ("deep", "audio", "f", "s", None), ("alone", "audio", "f", "w", None), ("w", "video", "f", None, None), ("vv", "video", "f", "w", None)]
    state = (folders, items)

    def moved(folder_ids, item_ids, target):
        a, b = bins.move_entries(*frames(spark, state), ids(spark, folder_ids), ids(spark, item_ids), target)
        return {r["id"]: r["parent"] for r in a.collect()}, {r["id"]: (r["bin"], r["bound"]) for r in b.collect()}

    where, held = moved(["g", "h"], ["v", "alone", "vv"], "t")
    assert where == {"t": None, "f": None, "g": "t", "h": "g"}
    # s comes along with v, but not what hangs on s; a sound that leaves its video is unbound, a video never
    assert held == {"v": ("t", None), "s": ("t", "v"), "deep": ("f", "s"), "alone": ("t", None), "w": ("f", None), "vv": ("t", "w")}
    assert moved(["f"], ["v"], "h") == ({i: p for i, p in folders}, {i[0]: (i[2], i[3]) for i in items})
    assert moved(["f"], ["v"], "unknown")[1]["v"] == ("f", None)
    assert moved(["h"], ["s"], None) == ({"t": None, "f": None, "g": "f", "h": None}, {i[0]: (i[2], i[3]) for i in items} | {"s": (None, None), "deep": (None, "s")})


def test_copies_point_to_copies(spark, state):
    picked = (["f3", "f20"], ["i7"])
    folders, items = frames(spark, state)
    inside, held = plain_within(*state, *picked)
    for in_place in (False, True):
        got = bins.copy_entries(folders, items, ids(spark, picked[0]), ids(spark, picked[1]), "m", "f0", in_place)
        assert got[0].columns == ["id", "parent", "root"] and got[1].columns == [*items.columns, "root"]
        new = {r["old"]: r["id"] for r in folders.select("id").union(items.select("id")).selectExpr("id as old", "sha2(concat_ws(':', 'm', id), 256) as id").collect()}
        old = lambda x: x if in_place else "f0"
        assert {(r["id"], r["parent"], r["root"]) for r in got[0].collect()} == {(new[i], new[p] if p in inside else old(p), p not in inside) for i, p in state[0] if i in inside}
        want = {(new[i], new[b] if b in inside else old(b), new[t] if t in held else (t if in_place else None), b not in inside and t not in held, False) for i, _, b, t, _ in state[1] if i in held}
        assert {(r["id"], r["bin"], r["bound"], r["root"], r["hidden"]) for r in got[1].collect()} == want


def test_projects_go_with_their_last_item(spark):
    items = spark.createDataFrame([("a", None), ("c", "b")], "id string, source string")
    projects = spark.createDataFrame([(p,) for p in "abcd"] + [(None,)], "project string")
    assert sorted(r[0] for r in bins.referenced(projects, items, "project", "source").collect()) == ["a", "b", "c"]


def test_flags_equal_closures(spark, state):
    nodes = frames(spark, state)[0].selectExpr("id", "id as name", "parent")
    closure = trees.ancestors(nodes)
    for picked in (["f3", "f40", "b"], ["self"], []):
        seeds = ids(spark, picked)
        assert {r[0] for r in trees.reached(nodes, seeds).collect()} == {r["id"] for r in closure.collect() if r["ancestor"] in picked}
        assert {r[0] for r in trees.above(nodes, seeds).collect()} == {r["ancestor"] for r in closure.collect() if r["id"] in picked}
    line = spark.range(1000).selectExpr("cast(id as string) as id", "cast(id as string) as name", "if(id > 0, cast(id - 1 as string), null) as parent")
    assert trees.reached(line, ids(spark, ["700"])).count() == 300 and trees.above(line, ids(spark, ["700"])).count() == 701


def test_paths_join_an_existing_tree(spark):
    nodes = spark.createDataFrame([("1", "a", None, ["x"]), ("2", "b", "1", None), ("0", "a", "2", []), ("9", "a", None, ["later"])], "id string, name string, parent string, synonyms array<string>")
    paths = spark.createDataFrame([(1, ["a", "b"], ["s", "x", "s"]), (2, ["a", "c", "d"], ["t"]), (3, ["a", "c"], None), (4, ["a"], ["x", "y"]), (5, [], ["z"]), (6, None, None), (7, ["a", None], []), (8, ["new"], []), (9, ["a", "b"], ["r", "s"])], "path long, names array<string>, synonyms array<string>")
    out, leaves = trees.merge_paths(nodes, paths)
    got = {r["id"]: (r["name"], r["parent"], r["synonyms"]) for r in out.collect()}
    ends = {r["path"]: r["id"] for r in leaves.collect()}
    assert set(ends) == {1, 2, 3, 4, 8, 9} and ends[1] == ends[9] == "2" and ends[4] == "1"
    assert got["1"] == ("a", None, ["x", "y"]) and got["2"] == ("b", "1", ["s", "x", "r"]) and got["9"] == ("a", None, ["later"])
    assert got[ends[3]] == ("c", "1", []) and got[ends[2]] == ("d", ends[3], ["t"]) and got[ends[8]] == ("new", None, [])
    assert len(got) == 7
    # a second time nothing is missing
    again, same = trees.merge_paths(out, paths)
    assert {r["id"]: (r["name"], r["parent"], r["synonyms"]) for r in again.collect()} == got and {r["path"]: r["id"] for r in same.collect()} == ends
    assert trees.merge_paths(nodes, paths.limit(0))[0].count() == 4
