import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cuelake.llm import registry, trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(convs):
    """convs: conversation to its (role, text) turns. Rows of trie.NODE by dictionaries of whole prefixes."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def built(spark, rows, local_turns):
    turns = trie.encode_turns(spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).repartition(3))
    nodes = trie.prefix_trie(trie.sequences(turns, turns.select("conv_id").distinct()), local_turns)
    return sorted(tuple(r) for r in nodes.collect())


def shaped():
    """Copies, shared beginnings, prefixes of others, long tails and a comb."""
    rng = random.Random(3)
    convs = {}
    for c in range(120):
        convs[c * 7 - 100] = [(rng.choice("ua"), f"{rng.randrange(3)} w" * rng.randrange(3)) for _ in range(rng.randrange(1, 7))]
    common = [("user", f"turn {k}") for k in range(30)]
    for c in range(60):
        convs[10_000 + c] = common[: rng.choice([5, 20, 30])] + [("a", str(rng.randrange(4)))] * rng.randrange(3)
    for c in range(40):
        convs[20_000 + c] = common
    for c in range(12):
        convs[40_000 + c] = common[:c] + [("fork", "x y z")]
    return convs


def as_rows(convs):
    return [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("local_turns", [8, 400, 100_000])
def test_equals_dictionaries_of_prefixes(spark, local_turns):
    convs = shaped()
    assert built(spark, as_rows(convs), local_turns) == plain(convs)


def test_nulls_repeats_and_order(spark):
    rows = [(1, None, None, None), (1, 2, "u", "b"), (1, 1, "u", "a"), (2, 0, "", ""), (2, 5, "u", "a"), (2, 5, "u", "a"), (None, 0, "u", "lost"), (3, 0, "", "u"), (4, 0, "u", "")]
    want = {1: [("", ""), ("u", "a"), ("u", "b")], 2: [("", ""), ("u", "a"), ("u", "a")], 3: [("", "u")], 4: [("u", "")]}
    assert built(spark, rows, 2) == plain(want)
    one = {7: [("u", "x " * 200_000), ("a", "é")]}
    assert built(spark, as_rows(one), 1) == plain(one)
    assert built(spark, as_rows({c: [("u", "same")] for c in range(-5, 5)}), 1) == plain({c: [("u", "same")] for c in range(-5, 5)})


def test_empty_table(spark):
    assert built(spark, [], 10) == []


def test_long_conversations(spark):
    long = [("u", f"t{k}") for k in range(3_000)]
    convs = {1: long, 2: long[:1_500] + [("a", "other")], 3: long[:10], 4: long}
    assert built(spark, as_rows(convs), 100) == plain(convs)


def test_ids_of_a_sequence_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BITS", 2)
    convs = {c: [("u", str(c % 2))] for c in range(-40, 60)}
    assert built(spark, as_rows(convs), 10) == plain(convs)


def test_query_equals_dictionaries_of_prefixes(spark, sf_dir):
    own = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert sorted(tuple(r) for r in registry.op13_trie(spark, sf_dir).collect()) == plain(rebuilt)
