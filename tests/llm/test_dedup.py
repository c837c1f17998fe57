"""Near duplicates and repeated windows against brute force."""

import random

from pyspark.sql import functions as F

from cuelake.llm import near_dup, substring


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_components(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [len(s) for s in sets], label


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "ONE two", "alone here"]
    for _ in range(6):  # groups whose members are near, at the threshold and apart
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([30, 80, 150]))]
        texts += [mutated(rng, base, rng.randrange(6)) for _ in range(40)]
    texts += [texts[10]] * 20 + ["x " * 30000 + "end"] * 2
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, N int")
    n, label = brute_components(texts, 5, 85)
    got = {r["id"]: r for r in near_dup.find_near_duplicates(docs).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    kept = near_dup.drop_near_duplicates(docs, percent=85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 16)
    rng = random.Random(6)
    base = [f"v{k}" for k in range(120)]
    texts = [mutated(rng, base, rng.randrange(5)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_dup.find_near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 5, 85)[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.find_near_duplicates(docs).count() == 0
    assert near_dup.drop_near_duplicates(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0


def brute_removed(texts, width):
    at = {}
    words = [(t or "").encode().split() for t in texts]
    for d, ws in enumerate(words):
        for k in range(len(ws) - width + 1):
            at.setdefault(tuple(ws[k : k + width]), []).append((d, k))
    gone = [set() for _ in texts]
    for places in at.values():
        if len(places) > 1:
            for d, k in places:
                gone[d].update(range(k, k + width))
    return [(len(ws), len(g), b" ".join(w for k, w in enumerate(ws) if k not in g).decode()) for ws, g in zip(words, gone, strict=True)]


def test_repeats_equal_brute_force(spark):
    rng = random.Random(7)
    passages = [[f"p{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    texts = [None, "", "a a a a a a a a a a a a", "é x y"]
    for _ in range(80):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"q{rng.randrange(10**6)}" for _ in range(20)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += ["b " * 5000, texts[9]] * 3
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, N_words int")
    for width in (5, 10):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, width=width).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts, width)


def test_frequent_minimisers_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    texts = [" ".join([f"u{k}", *(f"c{n}" for n in range(30)), f"v{k}"]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, width=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 10)


def test_labels_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "z")], "doc_id long, text string")
    got = near_dup.find_near_duplicates(docs)
    assert got.where(F.col("first")).count() == 2
    assert near_dup.drop_near_duplicates(docs).count() == 2
