"""Helpers shared by the corpus operators: checkpoints, row keys, vectorised words and hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import cut as cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step takes at once, so that a worker's memory is bounded.
CHUNK_BYTES = 1 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that start like the wanted ones and that df doesn't have, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


@contextmanager
def kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps frames on the executors' disks while the block runs; a lost part is computed again.

    What leaves the block must have been cut, as the frames are released at its end.
    """
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            df.unpersist()


#: Rows in a file that narrow_cut writes, and files that it writes at least where there are as many tasks.
FILE_ROWS, LEAST_FILES = 500_000, 8


def narrow_cut(df: DataFrame, rows: int) -> DataFrame:
    """cut for narrow frames of about so many rows: tasks are joined, so that few rows make few files."""
    return cut(df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS))))


#: Bytes of input, by Spark's estimate (which takes long texts for short ones), under which tasks are joined.
TASK_BYTES = 8 << 20


def merged(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with its tasks joined where the input, like, is small for so many: small inputs in many parts make
    many small files otherwise. Partitions of the usual sizes stay as they are."""
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(LEAST_FILES, -(-size // TASK_BYTES))))


#: What a plan may hold whose rows come in the same order whenever they are read.
_ORDERED = re.compile(r"[\s:+|-]*(?:Project|Filter|Relation|LogicalRDD|LocalRelation|OneRowRelation|Range|Generate|MapInArrow|LocalLimit)\b")


def settled(df: DataFrame) -> DataFrame:
    """df itself if it only reads tables, else its rows in the checkpoint folder.

    Rows may be numbered only if a second reading, after an executor was lost, meets them in the same order;
    those of a shuffle come as they arrive.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return df if all(_ORDERED.match(line) for line in plan.splitlines() if line.strip()) else cut(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- vectorised text inside tasks -----------------------------------------------------------

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    have = max(_POWERS, default=0)
    if have < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(1, U64)
            while len(p) < size:
                p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
            both.append(p[:size].copy())
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
        have = size
    return _POWERS[have]


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags: True for bytes in any of the ranges, both ends included."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: The words [^\x20\x09-\x0D]+ end at these bytes.
BLANKS = separators([(0x20, 0x20), (0x09, 0x0D)])
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n+1 ends of its texts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(ends: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most so many bytes together; a longer text stands alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of some texts: where each starts and ends in the bytes, and the words of each text.

    of_text[k] : of_text[k + 1] are the words of text k.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = BLANKS):
        inside = ~breaks[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        first = ends[:-1]
        before[first[first < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        last = ends[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of_text = np.searchsorted(self.starts, ends)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        value = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(value + (self.ends - self.starts).astype(U64) * _MULT)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_text) - 1), np.diff(self.of_text))


def run_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """For each run of so many consecutive word hashes, a 64-bit hash of the sequence."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = (_BASE * (2 * seed + 1)) % (1 << 64) | 1
    if length <= 8:
        value = np.zeros(n, U64)
        for k in range(length):
            value = value * U64(base) + words[k : k + n]
        return mix(value)
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    salted = mix(words + U64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    np.cumsum(salted * up[: len(words)], out=total[1:])
    return mix((total[length:] - total[:-length]) * down[:n] + U64(length))


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(x, U64).view(np.int64)
