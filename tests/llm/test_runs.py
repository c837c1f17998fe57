import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import registry, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, times=4):
    """Every period tried one after the other; a stretch counts with its smallest."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a " * 7, "a b " * 4, " a  b\ta b\na b a b a", "a b " * 3 + "a", "x y z " * 40, "a a b a a b a a b a a b a a"]
    for _ in range(400):
        n, kinds = rng.choice([(8, 1), (20, 2), (40, 2), (80, 3), (60, 2)])
        words = [chr(97 + rng.randrange(kinds)) for _ in range(n)]
        if rng.random() < 0.6:
            p, at = rng.randrange(1, 8), rng.randrange(n)
            words[at:at] = (words[:p] * 9)[: rng.randrange(4 * p, 9 * p)]
        out.append(" ".join(words))
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(f"{fib[-1]} {fib[-2]}")
    return [*out, fib[-1], "a b c d " * 300 + "e " * 200 + "a b c d " * 9]


def test_equals_every_period_tried(spark):
    rows = [(i, t, "kept", 3) for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, RUNS int").repartition(3)
    out = runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        words = WORD.findall(r["text"] or "")
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want, r["text"]
        assert (r["n_words"], r["collapsed"]) == (len(words), collapsed(words, want))


@pytest.mark.parametrize(("least", "times"), [(2, 2), (4, 2), (9, 3)])
def test_other_limits(least, times):
    for t in texts():
        words = WORD.findall(t or "")
        codes = np.array([ord(w) for w in words], np.int64)
        got = [(a + s, n, q) for a, b in runs.stretches(codes, np.array([len(codes)]), least, times) for s, n, q in runs.runs_of(codes[a:b], least, times)]
        assert sorted(got) == plain_runs(words, least, times), t


def test_ordered_sets_tell_neighbours():
    rng = random.Random(1)
    values = rng.sample(range(100_000), 5_000)
    held, seen = runs.Ends(values[0]), [values[0]]
    for x in values[1:]:
        lower, higher = [v for v in seen[-300:] if v < x], [v for v in seen[-300:] if v > x]
        before, after = held.add(x)
        assert before < x and (after > x or after == -1)
        assert before >= max(lower, default=-1) and (not higher or -1 < after <= min(higher))
        seen.append(x)
    assert list(held) == sorted(values)


def test_very_long_texts(spark):
    rng = random.Random(2)
    loop = " ".join(str(rng.randrange(10**6)) for _ in range(9_999))
    rows = [(1, f"{loop} " * 15), (2, "same " * 200_000), (3, "x" * 3_000_000)]
    got = {r["doc_id"]: r for r in runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 149_985, 9_999)] and got[1]["collapsed"] == loop
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 200_000, 1)] and got[2]["collapsed"] == "same"
    assert got[3]["runs"] == [] and len(got[3]["collapsed"]) == 3_000_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.find_runs(docs).collect() == []


def test_query_equals_every_period_tried(spark, sf_dir):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.op11_runs(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    assert sum(r["n_runs"] for r in got) > 0
    for r in got:
        words = looped(r["doc_id"], docs[r["doc_id"]])
        found = plain_runs(words)
        assert r["n_runs"] == len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_null_ids_and_texts_loop_nothing(spark):
    rows = [(None, "a b c"), (7, None), (None, None)]
    got = registry.looped(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("text")).collect()
    assert sorted(str(r[0]) for r in got) == ["None", "None", "a b c"]
