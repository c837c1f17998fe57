"""The corpus pipeline against plain versions of its stages."""

import random

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cuelake.llm import pii, quality
from tests.llm.test_dedup import brute_components, mutated
from tests.llm.test_filters import brute_leaks


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with nulls, repeated rows, near copies, leaks and personal data."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("pipeline")
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = [(n, " ".join(word() for _ in range(14))) for n in range(4)]
    texts = [None, "", "short", "a b c d e f"]
    for n in range(160):
        words = [word() for _ in range(rng.randrange(20, 80))]
        texts.append(" ".join(words).capitalize() + ".")
        if n % 4 == 0:
            texts.append(mutated(rng, words, 1))
        if n % 5 == 0:
            texts.append(" ".join([*words, *items[n % 4][1].split()[:11]]))
        if n % 7 == 0:
            texts.append(f"{' '.join(words[:30])} at 10.20.30.{n} and ann{n}@example.com on 2001-02-{n % 28 + 1:02d}")
        if n % 3 == 0:
            texts.append("!!! $$$ " * 30 + str(n))
    rows = [(i, t, "en", "s", len(t or ""), "kept") for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _ROW string").write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(not (t or "!").startswith("!")), 0) for i, t in enumerate(texts) if i % 5] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([*items, (9, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, items


def test_run_equals_the_plain_stages(spark, small):
    folder, rows, items = small
    spark.conf.set("spark.cuelake.pii.key", "of the test")
    try:
        got = sorted((r["doc_id"], r["ids"], r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.run(spark, folder).collect())
    finally:
        spark.conf.unset("spark.cuelake.pii.key")
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: model.score(next(quality.features(pa.array([t or ""])))[2])[0]
    docs = sorted(((r[0], r[1]) for r in rows if score(r[1]) >= corpus_pipeline.LEAST_QUALITY), key=lambda r: r[0])
    assert 10 < len(docs) < len(rows)
    _, label = brute_components([t for _, t in docs], 5, 80)
    docs = [d for n, d in enumerate(docs) if label[n] == n]
    left = [(i, t) for i, t in docs if not brute_leaks(t, items)[1]]
    assert 5 < len(left) < len(docs)
    p = pii.Permuter(b"of the test")
    hidden = [(i, pii.replace(t or "", p)[0]) for i, t in left]
    assert any(a != b for (_, a), (_, b) in zip(left, hidden, strict=True))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, ids := library.encode(t, add_special_tokens=False).ids, len(ids), True) for i, t in hidden)
    assert got == want


def test_each_stage_keeps_columns_and_takes_empty_tables(spark, small):
    folder, _, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != "bpe":
            assert out.columns == docs.columns


def test_the_order_is_as_asked():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "bpe"]
