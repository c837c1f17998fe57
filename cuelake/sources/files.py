"""Scans of other byte sources: fingerprints of files, frame lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes at either end of a file that its fingerprint reads.
WINDOW = 1 << 20
#: What a probe reads around the range it is asked for, in microseconds.
PADDING_US = 250_000


def little_endian(value: Column) -> Column:
    """A long as its eight bytes, the lowest first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(value), 16, "0"), F.lit("(..)"), F.lit(1))), ""))


def fingerprinted(content: Column, head: Column, window: int = WINDOW) -> Column:
    """The bytes that a fingerprint covers: the head, the first window and, of longer content, the last one."""
    n = F.octet_length(content)
    tail = F.when(n > window, F.substring(content, n - window + 1, F.lit(window))).otherwise(F.lit(b""))
    return F.concat(head, F.substring(content, F.lit(1), F.lit(window)), tail)


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, fingerprint) of files as the binaryFile source reads them (path, modificationTime, length, content)."""
    head = F.concat(little_endian(F.col("length")), little_endian(F.unix_seconds("modificationTime")))
    return files.select("path", F.sha2(fingerprinted(F.col("content"), head), 256).alias("fingerprint"))


def parse_frames(lines: DataFrame, start_us: int, end_us: int, line: str = "line") -> DataFrame:
    """Lines `frame,pts,duration` in seconds with start_us and end_us, of frames that touch the padded range.

    Lines without a number for either are dropped.
    """
    parts = F.split(F.col(line), ",")
    us = lambda k: F.round(F.get(parts, F.lit(k)).try_cast("double") * 1e6).cast("long")
    rows = lines.withColumn("start_us", us(1)).withColumn("end_us", F.col("start_us") + us(2)).where("end_us is not null")
    return rows.where((F.col("end_us") > start_us - PADDING_US) & (F.col("start_us") < end_us + PADDING_US)).drop(line)


def reversed_bytes(value: Column, size: int) -> Column:
    """The lowest so many bytes of a number, the lowest first."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))


def fixed_records(files: DataFrame, size: int) -> DataFrame:
    """A10: (path, record, bytes, complete) of content cut into records of so many bytes; only the last one of a
    file can be incomplete. Null and empty content gives no row."""
    n = F.octet_length("content")
    starts = files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("record"))
    part = F.substring(F.col("content"), F.col("record") * size + 1, F.lit(size))
    return starts.select("path", F.col("record").cast("long").alias("record"), part.alias("bytes"), (F.octet_length(part) == size).alias("complete"))


# fixed values: the header of a window of samples, its channels and the ranges asked for
PCM_MAGIC, PCM_CHANNELS = b"LPCM", 2
PCM_DURATION_US, PCM_RATE = (20_000, 4_000_000), (8_000, 192_000)


def pcm_windows(rows: DataFrame) -> DataFrame:
    """Rows (rate, start_us, duration_us, samples) with payload (header and samples) or error.

    The header has the magic, the rate, the channels, two zero bytes, the start and the count of frames, the
    lowest byte first; samples are 32-bit floats of both channels in turn.
    """
    frame = 4 * PCM_CHANNELS
    frames = F.floor(F.octet_length("samples") / frame)
    error = F.when(~F.col("rate").between(*PCM_RATE), "rate").when(~F.col("duration_us").between(*PCM_DURATION_US), "duration").when(F.octet_length("samples") % frame != 0, "unaligned").when(F.col("samples").isNull(), "no samples")
    start = F.greatest("start_us", F.lit(0).cast("long"))
    header = F.concat(F.lit(PCM_MAGIC), reversed_bytes(F.col("rate"), 4), reversed_bytes(F.lit(PCM_CHANNELS), 2), F.unhex(F.lit("0000")), reversed_bytes(start, 8), reversed_bytes(frames, 4))
    return rows.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), F.concat(header, F.col("samples"))))


PROBE = """format struct<duration: string, start_time: string>, streams array<struct<index: int, codec_type: string, codec_name: string, avg_frame_rate: string, r_frame_rate: string, sample_rate: string, channels: bigint,
    width: bigint, height: bigint, tags: map<string, string>, disposition: map<string, int>>>"""


def parse_probe(files: DataFrame, json: str = "json") -> DataFrame:
    """(path, duration, index, codec_type, codec_name, channels, width, height, language, is_default), a row for each
    stream of a probe's JSON; JSON that can't be read, or has no streams, gives no row."""
    read = files.select("path", F.from_json(json, PROBE).alias("p")).select("path", F.col("p.format.duration").try_cast("double").alias("duration"), F.explode("p.streams").alias("s"))
    tag = lambda k: F.coalesce(F.try_element_at("s.tags", F.lit(k)), F.try_element_at("s.tags", F.lit(k.upper())))
    default = F.coalesce(F.try_element_at("s.disposition", F.lit("default")), F.lit(0)) == 1
    return read.select("path", "duration", *[F.col(f"s.{c}").alias(c) for c in ("index", "codec_type", "codec_name", "channels", "width", "height")], tag("language").alias("language"), default.alias("is_default"))
