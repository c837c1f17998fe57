"""The byte and word models against plain recursive and counted versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import lm


def steps(text):
    """(latest DEPTH bytes of context, latest first; symbol) of each byte and of the end."""
    data = [lm.EDGE] * lm.DEPTH + [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()] + [lm.EDGE]
    return [(tuple(data[k - lm.DEPTH : k][::-1]), data[k]) for k in range(lm.DEPTH, len(data))]


def nodes_on(context, symbol):
    """The binary nodes that a step passes, with the bit taken: (context so far, bits so far)."""
    bits = f"{symbol:08b}"
    return [((context[:d], bits[:n]), int(bits[n])) for d in range(lm.DEPTH + 1) for n in range(8)]


class Plain:
    """Weighted probabilities by the book's recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            for step in steps(text):
                self.add(step, 1)

    def add(self, step, n):
        for node, bit in nodes_on(*step):
            self.counts.setdefault(node, [0, 0])[bit] += n

    def weighted(self, node):
        zeros, ones = self.counts.get(node, (0, 0))
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
        context, bits = node
        if len(context) == lm.DEPTH:
            return own
        below = [n for n in self.counts if n[1] == bits and len(n[0]) == len(context) + 1 and n[0][:-1] == context]
        spread = sum(self.weighted(n) for n in below)
        return np.logaddexp(own, spread) - math.log(2)

    def log10(self, text):
        total = 0.0
        for step in steps(text):
            roots = [((), f"{step[1]:08b}"[:n]) for n in range(8)]
            before = [self.weighted(r) for r in roots]
            self.add(step, 1)
            total += sum(self.weighted(r) for r in roots) - sum(before)
            self.add(step, -1)
        return total / math.log(10)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A small table of several files: (id, text), and the texts."""
    texts = ["abra cadabra", "Abra kadabra", None, "", "abracadabra abra", "zebra", "ABRA cadabra", "\u00e9t\u00e9 abra", "abra cadabra"]
    path = str(tmp_path_factory.mktemp("lm") / "docs")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, BLOCK string").repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path), texts


def test_scores_equal_the_recursion(written):
    docs, texts = written
    got = {r["doc_id"]: r for r in lm.score_documents(docs, F.col("doc_id") < 5).collect()}
    plain = Plain(texts[:5])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["trains"] == (i < 5)
        assert got[i]["score"] == pytest.approx(plain.log10(t), rel=2e-5)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * math.log2(10) / (len((t or "").encode()) + 1))


def test_small_parts_tell_the_same(written, monkeypatch):
    docs, _ = written
    want = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 5).collect()}
    monkeypatch.setattr(lm, "WEIGH_KEYS", 1)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 5).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_word_model(written):
    docs, texts = written
    got = {r["doc_id"]: r for r in lm.score_documents(docs, F.col("doc_id") < 5).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    train = Counter(w for t in texts[:5] for w in [*low(t).split(), None])
    total = sum(train.values())
    for i, t in enumerate(texts):
        tokens = [*low(t).split(), None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (len(train) + 1))) for w in tokens)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(w in train for w in tokens), total)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-9)


def test_without_rows_or_training_rows(spark, written):
    docs, _ = written
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    got = lm.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)}
    assert all(r["score"] == pytest.approx(-8 * math.log10(2) * (len((r_text or "").encode()) + 1), rel=2e-5) for r in got for r_text in [written[1][r["doc_id"]]])


def test_probabilities_sum_to_one():
    keys, _ = lm.sequences(np.frombuffer(b"abracadabra", np.uint8), np.array([0, 11]))
    for context in (keys[3], keys[7], np.uint64(5 << 40)):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        distinct, counts = lm.summed(np.concatenate([keys, every]), np.append(np.ones(len(keys), np.int64), np.zeros(256, np.int64)))
        logs = lm.Subtrees(distinct, counts, top=0).logs([])
        assert (10 ** logs[np.searchsorted(distinct, every)]).sum() == pytest.approx(1)


def test_long_texts_and_packing(spark, tmp_path):
    text = "the long text goes on and on. " * 50_000
    spark.createDataFrame([(1, text), (2, text), (None, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in lm.score_documents(spark.read.parquet(str(tmp_path / "d")), F.col("doc_id") == 1).collect()}
    assert got[1]["score"] == got[2]["score"] and got[2]["bits_per_byte"] < 0.1 and got[None]["n_tokens"] == 2
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 40, 400).astype(np.uint64))
    assert np.array_equal(lm.unpack(*lm.pack(keys)), keys) and len(lm.unpack(*lm.pack(keys[:0]))) == 0
