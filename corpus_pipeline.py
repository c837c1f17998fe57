"""A training-data pipeline over documents: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept. Empty
tables pass through every stage, repeated rows are treated alike, and the columns of docs stay whatever they
are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, decontaminate, near_dup, pii, quality
from cuelake.session import cut, table

#: Documents whose quality score is below this are rejected.
LEAST_QUALITY = 0.5

#: The stages train a classifier, hash shingles in numpy and encode tokens, hence no SQL; tests compare run with
#: plain versions of the stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the positive-unlabelled classifier finds poor; null and empty texts are judged too."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, score_col="_quality_score")
    return scored.where(F.col("_quality_score") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and all null and empty texts."""
    return near_dup.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10, remove="documents")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by keyed pseudonyms of the same format; the key is spark.cuelake.pii.key."""
    return pii.pseudonymise(docs, pii.session_key(spark), spans_col=None)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the kept texts, and whether decoding them gives the text again; null texts count as empty."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded_col="_decoded")
    same = F.col("_decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's result is written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
