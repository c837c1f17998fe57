"""Lists edited by index and histories, against plain lists."""

import random

from cuelake.operators import replay

NAMES = ("doc", "item", "value", "pos")


def plain_event(items, edits):
    named = {e[1] for e in edits}
    out = [x for x in items if x[0] not in named]
    for index, item, value in sorted((e for e in edits if e[2] is not None), key=lambda e: (e[0], e[1])):
        out.insert(min(index, len(out)), (item, value))
    return out


def lists_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["doc"]), r["pos"])):
        assert r["pos"] == len(got.setdefault(r["doc"], []))
        got[r["doc"]].append((r["item"], r["value"]))
    return got


def test_positions_equal_a_plain_list():
    rng, held, plain = random.Random(4), replay.Positions(), []
    for _ in range(4_000):
        edits = [(rng.randrange(0, 3_000), item, rng.choice([None, rng.random(), rng.random()])) for item in rng.sample(range(2_500), rng.randrange(1, 6))]
        held.event(sorted(edits, key=lambda e: (e[0], e[1])))
        plain = plain_event(plain, edits)
    assert list(held) == plain and len(held) == len(plain) > 1_000


def test_replay_and_odd_rows(spark):
    items = [("a", 3, "c", 2), ("a", 1, "a", 0), ("a", 2, "b", 1), ("a", 1, "again", 9), (None, 1, "n", 0), ("only", 7, "x", None), ("a", None, "lost", 0)]
    log = [("a", 10, 9, "new", 1), ("a", 10, 2, None, 0), ("a", 11, 1, "moved", 99), ("a", 9, 5, "neg", -3), ("a", None, 6, "first", None), ("fresh", 1, 1, "f", 5), (None, 1, 1, None, 0), ("a", 12, None, "lost", 0)]
    got = lists_of(replay.replay_positions(spark.createDataFrame(items, "doc string, item long, value string, pos long").repartition(3), spark.createDataFrame(log, "doc string, seq long, item long, value string, at long").repartition(3), *NAMES, "seq", "at"))
    # no seq: 6 1 2 3; seq 9: 5 6 1 2 3; seq 10 takes 2 out and puts 9 at 1; seq 11 puts 1 at the end
    assert got == {"a": [(5, "neg"), (9, "new"), (6, "first"), (3, "c"), (1, "moved")], "fresh": [(1, "f")], "only": [(7, "x")]}


def test_differences_go_both_ways(spark):
    rng = random.Random(8)
    before, after = [], []
    for doc in range(30):
        for side in (before, after):
            side += [(doc, item, rng.choice("xyz"), pos) for pos, item in enumerate(rng.sample(range(12), rng.randrange(0, 12)))]
    schema = "doc long, item long, value string, pos long"
    b, a = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    changes = replay.positional_diff(b, a, *NAMES)
    assert lists_of(replay.apply_positions(b, changes, *NAMES)) == lists_of(a)
    assert lists_of(replay.apply_positions(a, changes, *NAMES, back=True)) == lists_of(b)
    assert replay.positional_diff(b, b, *NAMES).count() == 0
    assert replay.replay_positions(b.limit(0), changes.selectExpr("doc", "0L as seq", "item", "new as value", "0 as at").limit(0), *NAMES, "seq", "at").count() == 0


def history(spark, steps, most=39):
    rows = [("d", n, *s) for n, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "doc string, n long, kind string, entry long, g string, label string, target long").repartition(2)
    got = sorted(replay.edit_histories(df, "doc", "n", "kind", "entry", "g", "label", "target", most).collect(), key=lambda r: r["place"])
    return [(r["first"], r["last"], r["label"]) for r in got], [r["place"] for r in got if r["current"]], [r["place"] for r in got if r["saved"]], [r["place"] for r in got if r["future"]]


def add(entry, group=None):
    return ("append", entry, group, f"l{entry}", None)


def jump(to):
    return ("jump", None, None, None, to)


SAVE = ("save", None, None, None, None)


def test_redo_branch_merge_and_cap(spark):
    # a jump back and an append cut what could be redone, and the saved state with it
    assert history(spark, [add(1), add(2), add(3), SAVE, jump(1), add(4)]) == ([(None, None, None), (1, 1, "l1"), (4, 4, "l4")], [2], [], [])
    assert history(spark, [add(1), SAVE, add(2), jump(1), add(3)])[2] == [1]
    # entries of a group merge at the tip only, and keep the first one's inverse
    assert history(spark, [add(1, "g"), add(2, "g"), add(3, "h"), add(4, "h")])[0][1:] == [(1, 2, "l2"), (3, 4, "l4")]
    assert history(spark, [add(1, "g"), add(2), jump(1), add(3, "g")])[0][1:] == [(1, 1, "l1"), (3, 3, "l3")]
    assert history(spark, [add(1, ""), add(2, "")])[0][1:] == [(1, 1, "l1"), (2, 2, "l2")]
    # beyond the cap the oldest leaves its label to the base, and the saved cursor moves along
    assert history(spark, [add(1), add(2), SAVE, add(3), add(4)], most=3) == ([(None, None, "l1"), (2, 2, "l2"), (3, 3, "l3"), (4, 4, "l4")], [3], [1], [])
    assert history(spark, [add(1), SAVE, add(2), add(3), add(4), add(5)], most=3)[2] == []
    # jumps stay within the history and show what can be redone; before a first append nothing happens
    assert history(spark, [jump(3), SAVE, add(1), add(2), jump(-5)])[1:] == ([0], [0], [1, 2])
    assert history(spark, [add(1), jump(99)])[1] == [1]
    assert history(spark, [jump(1), SAVE]) == ([], [], [], [])
