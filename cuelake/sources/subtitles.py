"""Cue files as DataFrames: (path, content) in, one row per cue out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuelake.functions.text import clean_plain_text, extension, normalize_newlines
from cuelake.functions.timecode import parse_ass_time, parse_subtitle_time

# fixed values: encodings in the order in which they are tried after UTF-8
LEGACY = ("gbk", "big5", "shift_jis", "cp1252")
_TIMING = r"((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d{1,6})\s*-->\s*((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d{1,6})"


def codec_of(path: Column) -> Column:
    """A3: ass, ssa, webvtt, and subrip for all other names."""
    ext = extension(path)
    return F.when(ext.isin("ass", "ssa"), ext).when(ext.isin("vtt", "webvtt"), "webvtt").otherwise("subrip")


@F.pandas_udf(StringType())
def _legacy_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8", *LEGACY):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("gbk", "replace")

    for part in parts:
        yield part.map(one)


def decode_text(content: Column) -> Column:
    """A2: UTF-8 stays in the JVM; other bytes go through the legacy encodings."""
    plain = F.is_valid_utf8(content.cast("string"))
    return F.when(plain, content.cast("string")).otherwise(_legacy_text(content))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("path").orderBy(order)) - 1
    return rows.withColumn("sequence", number.cast("long"))


def parse_srt(files: DataFrame) -> DataFrame:
    """A4: (path, sequence, start_us, end_us, raw_text, plain_text) of SubRip or WebVTT text.

    Blocks are split at blank lines; NOTE, STYLE and REGION blocks and all without a timing line are skipped,
    and so are cues without text or length. Null content gives no row.
    """
    text = normalize_newlines(F.col("content"))
    blocks = files.select("path", F.posexplode(F.split(text, r"\n[ \t]*\n+")).alias("_at", "_b")).select("path", "_at", F.regexp_replace("_b", r"^\s+", "").alias("_b"))
    blocks = blocks.where(~F.regexp_like("_b", F.lit("^(NOTE|STYLE|REGION)")))
    line = r"(?s)^(?:[^\n]*\n)?[^\n]*?" + _TIMING + r"[^\n]*\n?(.*)$"
    cut = [F.regexp_extract("_b", line, k) for k in (1, 2, 3)]
    cues = blocks.where(F.contains("_b", F.lit("-->"))).select("path", "_at", parse_subtitle_time(cut[0]).alias("start_us"), parse_subtitle_time(cut[1]).alias("end_us"), cut[2].alias("raw_text"))
    kept = cues.withColumn("plain_text", clean_plain_text(F.col("raw_text"))).where("end_us > start_us and plain_text <> ''")
    return _numbered(kept, "_at").select("path", "sequence", "start_us", "end_us", "raw_text", "plain_text")


def parse_ass(files: DataFrame) -> DataFrame:
    """A5: (path, sequence, start_us, end_us, layer, style, speaker, raw_text, plain_text) of ASS or SSA text.

    Only the [Events] section counts; its latest Format line names the fields, the last of which keeps its
    commas. Short lines are dropped.
    """
    lines = files.select("path", F.posexplode(F.split(normalize_newlines(F.col("content")), "\n")).alias("_at", "_l")).withColumn("_l", F.trim("_l"))
    order = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_section", F.last(F.when(F.startswith("_l", F.lit("[")), F.lower("_l")), ignorenulls=True).over(order))
    form = F.when(F.regexp_like("_l", F.lit("(?i)^format:")) & (F.col("_section") == "[events]"), F.transform(F.split(F.regexp_replace("_l", "(?i)^format:", ""), ","), lambda x: F.lower(F.trim(x))))
    default = F.array(*map(F.lit, ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")))
    lines = lines.withColumn("_form", F.coalesce(F.last(form, ignorenulls=True).over(order), default))
    said = lines.where(F.regexp_like("_l", F.lit("(?i)^dialogue:")) & (F.col("_section") == "[events]"))
    said = said.withColumn("_p", F.expr("split(trim(regexp_replace(_l, '(?i)^dialogue:', '')), ',', size(_form))")).where("size(_p) = size(_form)")
    whole = lambda k: F.get("_p", F.nullif(F.array_position("_form", k), F.lit(0).cast("long")).cast("int") - 1)
    get = lambda k: F.trim(whole(k))
    cues = said.select("path", "_at", parse_ass_time(get("start")).alias("start_us"), parse_ass_time(get("end")).alias("end_us"), get("layer").try_cast("int").alias("layer"), get("style").alias("style"), get("name").alias("speaker"), whole("text").alias("raw_text"))
    kept = cues.withColumn("plain_text", clean_plain_text(F.col("raw_text"))).where("end_us > start_us and plain_text <> ''")
    return _numbered(kept, "_at").select("path", "sequence", "start_us", "end_us", "layer", "style", "speaker", "raw_text", "plain_text")


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: (cues, tracks) of files (path, content as bytes), the encoding and kind of each found out.

    tracks: (path, codec, n_cues, notice); a file without content or cues has a notice and no cues, never an
    error. cues: (path, sequence, start_us, end_us, layer, style, speaker, raw_text, plain_text).
    """
    texts = files.select("path", codec_of(F.col("path")).alias("codec"), decode_text(F.col("content")).alias("content"))
    ass = F.col("codec").isin("ass", "ssa")
    cues = parse_ass(texts.where(ass)).unionByName(parse_srt(texts.where(~ass)), allowMissingColumns=True)
    counts = cues.groupBy("path").agg(F.count("*").alias("n_cues"))
    notice = F.when(F.col("content").isNull(), "unreadable").when(F.col("n_cues") == 0, "no cues")
    tracks = texts.join(counts, "path", "left").withColumn("n_cues", F.coalesce("n_cues", F.lit(0).cast("long")))
    return cues, tracks.select("path", "codec", "n_cues", notice.alias("notice"))


def read_cue_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """A1: (path, content) of the files below folder whose names fit the pattern; path is relative to the folder.

    wanted (path) names the files to read instead of all; of those that are not there the content is null, and repeated
    or null paths count once or not at all. Files are listed and read as binary, so none fails for what it holds; one
    file is one row, which a worker holds whole. Spark lists no empty files, nor those whose name starts with _ or a dot:
    they count as not there.
    """
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    found = found.select(F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")).alias("path"), "content")
    if wanted is None:
        return found
    return wanted.select("path").where("path is not null").distinct().join(found, "path", "left")


def load_cue_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """A1: (cues, tracks) of the cue files below a folder, as scan tells them from read_cue_files.

    A wanted file that is not there, or empty, has the notice 'missing or empty', codec 'unknown' and no cues.
    """
    files = read_cue_files(spark, folder, wanted, pattern)
    cues, tracks = scan(files)
    gone = F.col("notice").eqNullSafe("unreadable")
    return cues, tracks.withColumns({"codec": F.when(gone, "unknown").otherwise(F.col("codec")), "notice": F.when(gone, "missing or empty").otherwise(F.col("notice"))})


def existing(spark: SparkSession, folder: str, asked: DataFrame, path: str = "path") -> DataFrame:
    """Asked with exists: whether its path, relative to the folder, names a file below it that read_cue_files lists. No file is opened."""
    there = read_cue_files(spark, folder).select(F.col("path").alias("_there")).distinct().withColumn("exists", F.lit(True))
    return asked.drop("exists").join(there, F.col(path) == F.col("_there"), "left").drop("_there").withColumn("exists", F.coalesce("exists", F.lit(False)))
