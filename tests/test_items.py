"""Edits of items, annotations and stacks: odd inputs, and random ones against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import annotations, edits, items

ITEMS = "id string, kind string, bin string, bound string, name string, path string, enabled boolean, hidden boolean, offline boolean, changed string"
ROWS = [
    ("v", "video", "f", None, "film", "/a", True, None, True, "old"),
    ("w", "video", "g", None, None, None, None, True, None, None),
    ("s", "audio", "f", "v", "", "", False, False, False, None),
    ("t", None, None, "lost", "t", "/t", None, None, None, None),
    ("t", None, None, "lost", "t", "/t", None, None, None, None),  # repeated
    (None, "audio", None, None, None, None, None, None, None, None),
]


def by_id(df, *columns):
    return sorted(((r["id"] or "", *(r[c] for c in columns), r["changed"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame(ROWS, ITEMS).repartition(3)


def test_items_bound_and_unbound(spark, held):
    pairs = spark.createDataFrame([("s", "w"), ("s", None), ("t", "nowhere"), ("v", "w"), (None, "w"), ("unknown", "w")], "id string, video string")
    assert by_id(items.bind(held, pairs), "bin", "bound") == sorted([("", None, None, False), ("s", "g", "w", True), ("t", None, "nowhere", True), ("t", None, "nowhere", True), ("v", "f", None, False), ("w", "g", None, False)], key=str)
    assert by_id(items.unbind(held, pairs), "bound") == sorted([("", None, False), ("s", None, True), ("t", None, True), ("t", None, True), ("v", None, False), ("w", None, False)], key=str)
    assert items.bind(held.limit(0), pairs).count() == 0 and items.bind(held, pairs.limit(0)).where("changed").count() == 0


def test_items_renamed_hidden_and_relinked(spark, held):
    names = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", None), ("t", "t"), (None, "x")], "id string, name string")
    assert {r[:3] for r in by_id(items.rename(held, names), "name")} == {("", None, False), ("s", "", False), ("t", "t", False), ("v", "b", True), ("w", None, False)}
    assert {r[:3] for r in by_id(items.set_flag(held, names, "hidden", False), "hidden")} == {("", None, False), ("s", False, False), ("t", None, False), ("v", None, False), ("w", False, True)}
    assert {r[:3] for r in by_id(items.set_flag(held, names, "hidden", True), "hidden") if r[2]} == {("t", True, True), ("v", True, True)}
    links = spark.createDataFrame([("v", "/n", True, "audio"), ("s", "/m", False, "video"), ("t", None, True, "x"), ("w", "/k", None, None)], "id string, path string, probed boolean, kind string")
    got = set(by_id(items.relink(held, links), "path", "offline", "kind"))
    assert got == {("", None, None, "audio", False), ("s", "/m", False, "audio", True), ("t", "/t", None, None, False), ("v", "/n", False, "audio", True), ("w", "/k", False, "video", True)}


def test_items_taken_apart_once(spark, held):
    rows = [("v", "audio", 1, None, "", None), ("v", "subtitle", 2, "k", "", "C:\\x\\y.srt"), ("v", "subtitle", 3, "m", None, None), ("v", "subtitle", 3, "m", None, None), ("s", "audio", 1, None, "a", None), ("nowhere", "audio", 1, None, "a", None), (None, "audio", 1, None, "a", None), ("w", "picture", 1, None, "a", None)]
    streams = spark.createDataFrame(rows, "video string, kind string, stream int, track string, title string, path string")
    once = items.demux(held, streams)
    new = {r["id"]: (r["name"], r["bin"], r["bound"], r["enabled"], r["hidden"]) for r in once.where("changed").collect()}
    assert new == {"demux-audio:v:1": ("", "f", "v", True, False), "demux-subtitle:v:k": ("y.srt", "f", "v", True, False), "demux-subtitle:v:m": (items.UNTITLED + "3", "f", "v", True, False)}
    assert items.demux(once, streams).where("changed").count() == 0 and once.count() == len(ROWS) + 3


def test_annotations_exclude_colour_and_label(spark):
    schema = "item string, rating int, retained boolean, excluded boolean, colour string, label string, title string, more int"
    old = spark.createDataFrame([("a", 3, True, True, "red", None, None, 7), ("b", None, None, None, None, " x", "t", None), (None, 1, None, None, None, None, None, 1)], schema)

    def after(field, kind, *told):
        out = annotations.annotate(old, spark.createDataFrame(list(told), f"item string, value {kind}"), field)
        assert out.columns == [*old.columns, "changed"]
        return {r["item"]: tuple(r)[1:7] for r in out.collect() if r["changed"]}

    assert after("colour", "string", ("a", "red"), ("b", None), ("c", None), (None, "red"), ("d", "blue")) == {"b": (None, None, None, None, None, "t"), "d": (0, False, False, "blue", None, None)} | {"b": (0, False, False, None, None, "t")}
    assert after("label", "string", ("a", "\u00a0 "), ("b", "x"), ("c", " ")) == {"a": (3, True, True, None, None, None), "b": (0, False, False, None, "x", "t")}
    assert after("flag", "string", ("a", "retained"), ("b", "excluded"), ("c", None)) == {"b": (0, False, True, None, " x", "t")}
    assert after("rating", "double", ("a", 2.5), ("b", float("nan")), ("c", 99.0), ("c", 1.0)) == {"c": (5, False, False, None, None, None)}
    assert after("rating_by", "double", ("a", float("inf")), ("b", -3.0), ("c", 1e300)) == {"c": (5, False, False, None, None, None)}
    assert after("title", "string", ("a", ""), ("b", None), ("c", "")) == {"b": (0, False, False, None, " x", "")}
    with pytest.raises(ValueError):
        after("other", "string", ("a", "x"))
    assert annotations.annotate(old.limit(0), spark.createDataFrame([], "item string, value string"), "title").count() == 0


def test_keywords_used_like_a_plain_fold(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        recents = rng.sample("abcdef", rng.randrange(5))
        counters = {k: rng.randrange(1, 50) for k in rng.sample("abcdef", rng.randrange(5))}
        rows.append((n, recents, counters, [rng.choice(["a", "b", "g", "h"]) for _ in range(rng.randrange(4))]))
    df = spark.createDataFrame(rows, "n int, recents array<string>, counters map<string,bigint>, used array<string>")
    for r in df.withColumn("r", annotations.used_recents(F.col("recents"), F.col("used"))).withColumn("c", annotations.used_counters(F.col("counters"), F.col("used"))).collect():
        recents, counts = list(r["recents"]), dict(r["counters"])
        for k in r["used"]:
            recents = [k, *(x for x in recents if x != k)]
        for k in set(r["used"]):
            counts[k] = counts.get(k, 0) + 1
        if r["used"] and sum(counts.values()) >= 100:
            counts = {k: v // 2 for k, v in counts.items() if v // 2}
        assert (r["r"], r["c"]) == (recents, counts)


def test_keywords_of_boards_without_changes_are_not_used(spark):
    boards = spark.createDataFrame([("p", ["a"], {"a": 1}), ("q", None, None), ("r", [], {})], "board string, recents array<string>, counters map<string,bigint>")
    notes = spark.createDataFrame([("i", ["k"]), ("j", []), ("none", None)], "item string, keywords array<string>")
    chosen = spark.createDataFrame([("p", "i"), ("q", "j"), ("q", "j"), ("unknown", "none")], "board string, item string")
    given = spark.createDataFrame([("p", ["k"]), ("q", ["k", None]), ("unknown", ["k"])], "board string, used array<string>")
    got, done = annotations.assign(boards, notes, chosen, given, "append")
    assert {r["board"]: (r["recents"], r["counters"]) for r in got.collect()} == {"p": (["a"], {"a": 1}), "q": (["k"], {"k": 1}), "r": ([], {})}
    assert {r["item"] for r in done.where("changed").collect()} == {"j", "none"}
    assert annotations.assign(boards, notes, chosen, given, "off")[0].where("board = 'p'").first()["recents"] == ["a"]


def test_keywords_deleted_everywhere(spark):
    nodes = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("d", None, 4)], "id string, parent string, n int")
    boards = spark.createDataFrame([("p", ["c", "d"], {"b": 1, "d": 2}), ("q", None, None), ("r", ["d"], {"d": 1})], "board string, recents array<string>, counters map<string,bigint>")
    notes = spark.createDataFrame([("i", ["a", "d"]), ("j", None), ("k", ["b"])], "item string, keywords array<string>")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    left, b, a = annotations.delete_keywords(nodes, ids("b", "b", None, "unknown"), boards, notes)
    assert sorted(r["id"] for r in left.collect()) == ["a", "d"]
    assert {r["board"]: tuple(r)[1:] for r in b.collect()} == {"p": (["d"], {"d": 2}, True), "q": (None, None, False), "r": (["d"], {"d": 1}, False)}
    assert {r["item"]: tuple(r)[1:] for r in a.collect()} == {"i": (["a", "d"], False), "j": (None, False), "k": ([], True)}
    assert annotations.delete_keywords(nodes, ids(), boards, notes)[0].count() == 4


def test_collapsed_stacks(spark):
    rows = spark.createDataFrame([("b", n, n * 10, n * 10 + 9) for n in range(8)], "board string, item int, start int, end int")
    stacks = spark.createDataFrame([("b", "s", n, n, False) for n in (1, 2, 4)] + [("b", "t", n, n, True) for n in (5, 6)] + [("b", "u", 1, 7, None), ("b", "u", 2, 99, None)], "board string, stack string, ord int, item int, expanded boolean")
    shown = {r["item"]: (r["start"], r["end"]) for r in edits.visible_rows(rows, stacks).collect()}
    assert shown == {0: (0, 9), 1: (10, 49), 3: (30, 39), 5: (50, 59), 6: (60, 69), 7: (70, 79)}
    picked = spark.createDataFrame([("b", 2), ("b", 4), ("b", 6), ("b", 55), ("c", 2), ("b", 2)], "board string, item int")
    assert sorted(map(tuple, edits.visible_selection(picked, stacks).collect())) == [("b", 1), ("b", 6), ("b", 55), ("c", 2)]
    assert sorted(map(tuple, edits.selected_members(picked, stacks).collect())) == [("b", 1), ("b", 2), ("b", 4), ("b", 6), ("b", 55), ("c", 2)]
    assert edits.visible_rows(rows, stacks.limit(0)).count() == 8 and edits.visible_rows(rows.limit(0), stacks).count() == 0


def test_keywords_deleted_from_large_boards(spark):
    """Two hundred thousand keywords a board, half of them deleted: comparing all with all would take hours."""
    n = 200_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 1, (F.col("id") % 2).cast("string")).alias("parent"))
    names = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k.cast("string"))
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k.cast("long"))
    boards = spark.range(1).select("id", F.concat(names, F.array(F.lit("3"), F.lit("2"), F.lit("3"))).alias("recents"), F.map_from_arrays(names, one).alias("counters")).withColumnRenamed("id", "board")
    notes = spark.createDataFrame([], "item string, keywords array<string>")
    removed = spark.createDataFrame([("0",)], "id string")
    _, b, _ = annotations.delete_keywords(nodes, removed, boards, notes)
    sums = b.select(F.size("recents"), F.slice("recents", -2, 2), F.size("counters"), F.aggregate(F.map_values("counters"), F.lit(0).cast("long"), lambda s, x: s + x), "changed")
    # what is twice in recents stays so
    assert tuple(sums.first()) == (n // 2 + 2, ["3", "3"], n // 2, n * n // 4, True)
    uses = nodes.select(F.lit("p").alias("board"), F.col("id").alias("keyword"))
    marked = annotations.mark_uses(uses.unionByName(spark.createDataFrame([("q", None), ("q", "3")], "board string, keyword string")), annotations.gone_keywords(nodes, removed))
    assert {r["board"]: (r["n"], r["gone"]) for r in marked.groupBy("board").agg(F.count_if(~F.col("gone")).alias("n"), F.max("gone").alias("gone")).collect()} == {"p": (n // 2, True), "q": (2, False)}


def test_items_bound_to_nothing_are_spread(spark):
    """They match no video, so they needn't meet in one task."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for key, value in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(key, value)
    try:
        rows = spark.range(4000).select(F.concat(F.lit("v"), "id").alias("id"), F.lit("video").alias("kind"), F.when(F.col("id") % 100 == 7, "v3").alias("bound_to"), F.lit(True).alias("enabled"))
        out = edits.set_enabled(rows, rows.where("id in ('v3', 'v4')"), False)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
        assert sorted(r["id"] for r in out.where("changed").collect()) == sorted(["v3", "v4", *(f"v{k}" for k in range(7, 4000, 100))])
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
