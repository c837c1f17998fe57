"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every token window.

DataFrame functions only. A window is first looked up by a hash of its first, middle and last word, as one
row of a generated sequence, which stays inside compiled code; text is cut only for windows found so, and
then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import cut, fresh, kept, lower_ascii, merged, settled

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct hashes (at most 32 MB in a task's hash table) go to all tasks; beyond it, hashes,
#: without any text, are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Up to so many bytes of windows' text go to all tasks to verify hits; beyond it, hits are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_hash(words: Column, at: Column, size: Column) -> Column:
    """A 64-bit hash of the window's first, middle and last word and its length."""
    pick = lambda k: F.get(words, k)
    return F.xxhash64(pick(at), pick(at + F.floor(size / 2).cast("int")), pick(at + size - 1), size)


def window_text(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, len, hash, window): the distinct windows of each item, as text.

    A window is width consecutive words; an item with fewer words, but not none, is one window. Null or
    wordless items have no window. Repeated items count once.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    placed = items.withColumn("len", F.least(F.lit(width), F.size("words"))).select("item", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("at"))
    at, size, words = F.col("at"), F.col("len"), F.col("words")
    return placed.select("item", "len", window_hash(words, at, size).alias("hash"), window_text(words, at, size).alias("window")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """One row per key: n_words, n_hit, items (sorted strings), spans (word ranges [from, to) that are hit).

    Every hit of the hash set is verified by its words. Null and empty texts have no words; long texts are
    scanned whole. Repeated texts are judged alike. Repeated keys are not expected: use a row number.
    An empty benchmark hits nothing, an empty docs gives an empty result. The result stands in the
    checkpoint folder.
    """
    with kept() as keep:
        windows = keep(benchmark_windows(benchmark, item_col, item_text_col, width))
        sizes = {r["len"]: (r["n"], r["bytes"]) for r in windows.groupBy("len").agg(F.count_distinct("hash").alias("n"), F.sum(F.octet_length("window") + 64).alias("bytes")).collect()}  # at most width rows
        hashes = windows.select("hash").distinct()
        texts = windows.select(F.col("window").alias("text")).distinct()
        base = docs.select(F.col(key).alias("key"), words_of(F.col(text_col)).alias("words"))
        # position -1 is a row that every document keeps
        spread = base.select("key", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - min(sizes, default=1), F.lit(-1)))).alias("at"))
        lengths = sorted(sizes) or [width]
        spread = spread.withColumn("len", F.lit(lengths[0])) if len(lengths) == 1 else spread.withColumn("len", F.explode(F.when(F.col("at") < 0, F.array(F.lit(lengths[0]))).otherwise(F.array(*map(F.lit, lengths)))))
        at, size, words = F.col("at"), F.col("len"), F.col("words")
        mark = F.lit(0).cast("long")
        spread = spread.where((at < 0) | (at + size <= F.size(words))).withColumn("hash", F.when(at < 0, mark).otherwise(window_hash(words, at, size)))
        known = hashes.unionByName(docs.sparkSession.range(1).select(mark.alias("hash"))).distinct()
        if sum(n for n, _ in sizes.values()) <= BROADCAST_WINDOWS:
            found = spread.join(F.broadcast(known), "hash", "left_semi").select("key", "at", "len", F.when(at < 0, F.size(words)).alias("n_words"), F.when(at >= 0, window_text(words, at, size)).alias("text"))
        else:
            placed = keep(spread.select("key", "at", "len", "hash", F.when(at < 0, F.size(words)).alias("n_words")).join(known, "hash", "left_semi"))
            some = base.join(placed.where("at >= 0").select("key").distinct(), "key", "left_semi")
            found = placed.where("at < 0").select("key", "at", "len", "n_words", F.lit(None).cast("string").alias("text")).unionByName(
                placed.where("at >= 0").join(some, "key").select("key", "at", "len", "n_words", window_text(words, at, size).alias("text"))
            )
        if sum(b for _, b in sizes.values()) <= BROADCAST_BYTES:
            seen = F.broadcast(texts.withColumn("seen", F.lit(True)))
            hits = keep(found.join(seen, "text", "left").where("at < 0 or seen").select("key", "at", "len", "n_words", "text"))
        else:
            found = keep(found)
            hits = found.where("at < 0").unionByName(found.where("at >= 0").join(texts, "text", "left_semi").select(*found.columns))
        ranges = F.sort_array(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("len")).alias("to")))))
        covered = hits.groupBy("key").agg(F.max("n_words").cast("long").alias("n_words"), ranges.alias("found"))
        # joins touching and overlapping ranges, in order: a range either lengthens the open one or closes it
        joined = F.expr("""aggregate(found, named_struct('done', CAST(array() AS array<struct<at:int,to:int>>), 'at', CAST(NULL AS int), 'to', CAST(NULL AS int)),
            (s, x) -> if(x.at <= s.to, named_struct('done', s.done, 'at', s.at, 'to', greatest(s.to, x.to)),
                named_struct('done', if(s.at IS NULL, s.done, concat(s.done, array(named_struct('at', s.at, 'to', s.to)))), 'at', x.at, 'to', x.to)),
            s -> if(s.at IS NULL, s.done, concat(s.done, array(named_struct('at', s.at, 'to', s.to)))))""")
        spans = covered.select("key", "n_words", joined.alias("spans"))
        pairs = windows.select(F.col("window").alias("text"), "item")
        items = hits.where("at >= 0").select("key", "text").distinct().join(pairs, "text").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
        n_hit = F.expr("CAST(aggregate(spans, 0, (n, x) -> n + x.to - x.at) AS BIGINT)").alias("n_hit")
        return cut(merged(spans.join(items, "key", "left").select(F.col("key").alias(key), "n_words", n_hit, F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"), docs))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, remove: str = "documents") -> DataFrame:
    """docs without what the benchmark holds.

    remove="documents" drops every document with a hit; remove="spans" cuts the hit words out of the text,
    with what stands between two hit words, and keeps the document. The columns are those of docs, whatever
    their names. Null and empty texts stay as they are, repeated rows are treated alike, empty tables give
    docs back.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r} is neither documents nor spans")
    docs = settled(docs)
    row, spans = fresh(docs, "_row", "_spans")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    hits = find_contamination(keyed, benchmark, row, text_col, item_col, item_text_col, width).where("n_hit > 0")
    if remove == "documents":
        return merged(keyed.join(hits.select(row), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), docs)
    both = keyed.join(hits.select(row, F.col("spans").alias(spans)), row, "left")
    any_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = f"`{text_col}`"
    cleaned = f"""array_join(transform(zip_with(split({text}, r'{any_word}', -1), regexp_extract_all({text}, r'{any_word}', 0), (gap, word) -> struct(gap, word)),
        (x, i) -> concat(if(exists(`{spans}`, s -> s.at < i AND i < s.to), '', x.gap), if(exists(`{spans}`, s -> s.at <= i AND i < s.to), '', coalesce(x.word, '')))), '')"""
    return both.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.expr(cleaned))).select(*[F.col(f"`{c}`") for c in docs.columns])
