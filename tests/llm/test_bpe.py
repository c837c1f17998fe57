import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuelake.llm import bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    None,
    "",
    " ",
    "a",
    "\n\n \t x",
    "<|endoftext|>",
    "a b<|endoftext|> c  d<|endof" + "text|>",
    "é" * 3000,
    "x" * 5000,
    "  " * 2000 + "end",
    "it's we'll I'd 12 345 ---     \u0085 z",
    "The cat sat on the mat. " * 400,
    "日本語 テキスト " * 300,
    "\U0001f600 \U0001f468‍\U0001f469 " * 200,
]


def expected(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t.encode(text or "", add_special_tokens=False).ids


def test_equals_the_library_on_odd_texts(spark):
    rows = [(i, t, "kept") for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, decoded_col="decoded").collect()}
    library = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = expected(t)
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library_on_a_table(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in registry.op9_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = expected(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunks_are_reused_and_joins_are_exact():
    import pyarrow as pa

    codec = bpe.Codec(PATH)
    passage = " ".join(f"word{i * i} and more" for i in range(2000))
    texts = [f"{k} lead in {passage} tail {k}" for k in range(5)]
    out = [ids.tolist() for _, _, part in bpe.encode_texts(codec, pa.array(texts)) for ids in part]
    assert codec.reused > codec.encoded
    assert out == [expected(t) for t in texts]


def test_empty_table_and_decode(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH).count() == 0
    back = bpe.decode(spark.createDataFrame([([15496, 995],), ([],), (None,)], "ids array<int>"), PATH)
    assert [r["decoded"] for r in back.select("decoded").collect()] == ["Hello world", "", None]


def test_library_is_used_for_other_models(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.Codec(path).library is not None


def test_very_long_runs_equal_the_library(spark):
    """Runs of one character for which a backtracking pattern would need a deep stack, alone and between words."""
    n = 2_000_000
    texts = [*("a " + c * n + "b c" for c in (" ", "\n", "\t")), " \n" * n, "x" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, decoded_col="decoded").select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("h"), (F.col("decoded") == F.col("text")).alias("same")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["h"] == hashlib.sha256(",".join(map(str, expected(t))).encode()).hexdigest(), i
        assert got[i]["same"]
