"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import oracles
from cuelake.session import table

#: The judged rules of op1: host, path and verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo so many parts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.near_dup import find_near_duplicates

    found = find_near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm import quality

    held_out = fold("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.pii import pseudonymise, session_key

    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", F.size("pii").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"), "pii", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    key = F.struct("row", "doc_id")
    hits = find_contamination(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), "key")
    return hits.select(
        "key.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.lm import score_documents

    held_out = fold("doc_id", 10) == 0
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm import toxicity

    held_out = fold("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cuelake.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def looped(docs: DataFrame) -> DataFrame:
    """docs with the texts of a tenth of the ids replaced: from word a on, p words in a loop up to the old length."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size("_words")
    cut = words.withColumn("_a", F.when(n > 0, g % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    loop = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), loop), F.lit(1), n), " ")
    return cut.withColumn("text", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text"))).drop("_words", "_a", "_p")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.runs import find_runs

    found = find_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), told.alias("told"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.chat import format_conversations, read_loss, read_turns

    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = format_conversations(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.trie import encode_turns, prefix_trie, sequences

    turns = encode_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    h = fold("conv_id", 4)
    convs = turns.select("conv_id").distinct()
    heads = convs.where(h > 0).select(F.col("conv_id").alias("c"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("conv_id"))
    taken = heads.join(turns.where("pos < 3"), "conv_id").where("pos < h").select(F.col("c").alias("conv_id"), "pos", "turn")
    rebuilt = turns.where(F.col("pos") >= h).unionByName(taken)
    return prefix_trie(sequences(rebuilt, convs)).withColumnRenamed("ends", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_near_dedup, op3_quality, op4_pii, op5_decontaminate, op6_lm_score, op7_substring, op8_toxicity, op9_bpe, op10_topk, op11_runs, op12_chat, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
