"""Exact top-k inner products over a bit-sliced index.

Every block of vectors keeps, for each attribute, the bitmaps of its quantised values. A block of queries
adds those slices with bitmap arithmetic (full adders over whole bitmaps), walks the sum's slices from the
most significant one down to select the top rows, and then resolves exactly, by full inner products, every
row that the quantisation leaves in doubt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import shuffle_partitions

#: Rows whose slices are held together, and queries that are added together.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 64
#: Bits kept of a quantised attribute and of a query's weight.
ROW_BITS, WEIGHT_BITS = 5, 4
#: Queries that a task holds, about: at 64 attributes of 8 bytes, 8 MB.
QUERY_ROWS = 16_384


def quantise(ids: pa.Array, lists: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, floor(scale * x)) of the usable vectors, for each vector length.

    Null ids, null vectors, empty ones and those that hold a null or a component that isn't finite are left out.
    """
    ends = lists.offsets.to_numpy()
    flat = lists.values.cast(pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False)  # nulls become nan
    usable = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    sizes = np.diff(ends)
    for d in np.unique(sizes[usable & (sizes > 0)]):
        at = np.flatnonzero(usable & (sizes == d))
        matrix = numbers[ends[at][:, None] + np.arange(d)]
        fine = np.isfinite(matrix).all(axis=1)
        at = at[fine]
        yield at, np.asarray(ids.take(pa.array(at))).astype(np.int64), np.floor(matrix[fine] * scale).astype(np.int64)


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis (a multiple of 64) as 64-bit words."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """The slices of up to BLOCK_ROWS vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, d = values.shape
        self.low = values.min(axis=0)
        rest = values - self.low
        self.shift = max(0, int(rest.max()).bit_length() - ROW_BITS)
        kept = rest >> self.shift
        self.most = kept.max(axis=0)
        padded = np.zeros((d, -(-n // 64) * 64), np.int64)
        padded[:, :n] = kept.T
        self.slices = bitmaps(((padded[:, None, :] >> np.arange(ROW_BITS)[None, :, None]) & 1).astype(np.uint8))
        self.rows = bitmaps(np.arange(padded.shape[1]) < n)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of sum over d of |w_d| * (a_d, or its complement where w_d < 0), for each query."""
        negative = np.where(weights < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        size = np.abs(weights)
        top = int(size.max()).bit_length()
        masks = [np.where((size >> j) & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)) for j in range(top)]
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        level = 0
        while level < ROW_BITS + top - 1 or carries:
            pending, up = carries, []
            for j in range(top):
                b = level - j
                if 0 <= b < ROW_BITS:
                    for d in np.flatnonzero(masks[j].any(axis=0)):
                        pending.append((self.slices[d, b][None, :] ^ negative[:, d, None]) & masks[j][:, d, None])
                        if len(pending) == 3:
                            pending = [self._add(pending, up)]
            while len(pending) > 1:
                pending = [self._add(pending[:3], up), *pending[3:]]
            out.append(pending[0] if pending else np.zeros((len(weights), self.slices.shape[2]), np.uint64))
            carries = up
            level += 1
        return out

    @staticmethod
    def _add(x: list[np.ndarray], up: list[np.ndarray]) -> np.ndarray:
        """The sum bitmap of two or three bitmaps; the carry goes to the level above."""
        half = x[0] ^ x[1]
        carry = x[0] & x[1]
        if len(x) == 3:
            carry |= half & x[2]
            half ^= x[2]
        up.append(carry)
        return half

    def candidates(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
        """Bitmaps, for each query, of all rows that can be among its k best and can reach its floor score.

        own: the query's own rows; floor: the score that k rows are known to reach, or the least long.
        """
        shift = max(0, int(np.abs(queries).max()).bit_length() - WEIGHT_BITS)
        weights = queries >> shift
        left = queries - (weights << shift)  # 0 <= left < 2 ** shift
        slices = self.sums(weights)
        # score = fixed + 2**(self.shift + shift) * sum + rest, with rest between low and high
        unit = self.shift + shift
        span = (1 << self.shift) - 1
        full = (1 << ROW_BITS) - 1
        fixed = queries @ self.low - (np.where(weights < 0, -weights, 0).sum(axis=1) * full << unit)
        low = np.where(queries < 0, queries, 0).sum(axis=1) * span
        high = np.where(queries > 0, queries, 0).sum(axis=1) * span + ((left @ self.most) << self.shift)
        # from the most significant slice down: the k largest sums, and the least of them
        among = self.rows[None, :] & ~own
        sure, least = np.zeros_like(among), np.zeros(len(queries), np.int64)
        wanted = np.minimum(k, np.bitwise_count(among).sum(axis=1))
        for level in range(len(slices) - 1, -1, -1):
            ones = among & slices[level]
            many = np.bitwise_count(sure | ones).sum(axis=1) >= wanted
            least += many.astype(np.int64) << level
            sure = np.where(many[:, None], sure, sure | ones)
            among = np.where(many[:, None], ones, among & ~slices[level])
        reach = np.where(wanted == k, fixed + (least << unit) + low, np.iinfo(np.int64).min)  # k rows score so much at least
        bar = np.maximum(reach, floor)
        # rows whose sum allows the bar: sum >= need
        need = np.where(bar == np.iinfo(np.int64).min, 0, -((fixed + high - bar) >> unit))
        above, equal = np.zeros_like(sure), self.rows[None, :] & ~own
        top = (1 << len(slices)) - 1
        bits = np.clip(need, 0, top)
        for level in range(len(slices) - 1, -1, -1):
            one = ((bits >> level) & 1).astype(bool)[:, None]
            above = np.where(one, above, above | (equal & slices[level]))
            equal = equal & np.where(one, slices[level], ~slices[level])
        return np.where((need > top)[:, None], np.uint64(0), above | equal)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Search:
    """Queries of one vector length and their k best rows so far."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.numbers, self.ids, self.vectors, self.k = numbers, ids, vectors, k
        none = np.zeros(0, np.int64)
        self.found = [(none, none)] * len(ids)
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.held.append((ids, values))
        self.waiting += len(ids)
        if self.waiting >= BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        ids, values = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.waiting = [], 0
        for at in range(0, len(ids), BLOCK_ROWS):
            self._use(ids[at : at + BLOCK_ROWS], values[at : at + BLOCK_ROWS])

    def _use(self, ids: np.ndarray, values: np.ndarray) -> None:
        block = SlicedBlock(ids, values)
        for i in range(0, len(self.ids), BLOCK_QUERIES):
            part = slice(i, i + BLOCK_QUERIES)
            own = np.zeros((len(self.ids[part]), len(block.rows) * 64), np.uint8)
            own[:, : len(ids)] = self.ids[part][:, None] == ids[None, :]
            rows = block.candidates(self.vectors[part], bitmaps(own), self.floor[part], self.k)
            flags = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
            for q in np.flatnonzero(flags.any(axis=1)):
                at = np.flatnonzero(flags[q])
                scores = values[at] @ self.vectors[i + q]
                s, v = best_rows(np.concatenate([self.found[i + q][0], scores]), np.concatenate([self.found[i + q][1], ids[at]]), self.k)
                self.found[i + q] = s, v
                if len(s) == self.k:
                    self.floor[i + q] = s[-1]

    def result(self) -> pa.RecordBatch:
        self.flush()
        n = [len(s) for s, _ in self.found]
        columns = [np.repeat(self.numbers, n), np.repeat(self.ids, n), *(np.concatenate([x[c] for x in self.found]) for c in (1, 0))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_no", "query_id", "vec_id", "score"])


def scan(k: int, scale: int):
    """A function for mapInArrow over (is_row, query_no, id, v), queries first: the task's k best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[np.ndarray, ...]]] = {}
        searches: dict[int, Search] | None = None
        for batch in batches:
            split = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), True))
            queries, rows = batch.slice(0, split), batch.slice(split)
            if queries.num_rows:
                numbers = queries.column(1).to_numpy()
                for at, ids, values in quantise(queries.column(2), queries.column(3), scale):
                    asked.setdefault(values.shape[1], []).append((numbers[at], ids, values))
            if rows.num_rows:
                if searches is None:
                    searches = {d: Search(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) for d, parts in asked.items()}
                for _, ids, values in quantise(rows.column(2), rows.column(3), scale):
                    if len(ids) and values.shape[1] in searches:
                        searches[values.shape[1]].add(ids, values)
        for search in (searches or {}).values():
            if len(search.ids):
                yield search.result()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of largest inner product of floor(scale * x).

    Ties go to the smaller id. Rows with the query's id are never its results. Vectors that are null, empty
    or hold a null or a component that isn't finite take no part, as rows or as queries; vectors are only
    compared with vectors of their length. Repeated rows count each; repeated queries are one query. Scores
    must fit a long. Empty tables give an empty result; other columns take no part.

    Queries are dealt into groups that a task can hold and rows into cells; each group meets each cell in one
    task, which reads the cell's rows as a stream. Nothing goes through the driver but the count of queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).distinct()
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    cells = max(1, -(-shuffle_partitions(vectors.sparkSession) // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.xxhash64("id", "v")
    told = asked.withColumn("query_no", number).withColumn("group", F.pmod("query_no", F.lit(groups)).cast("int")).withColumn("cell", every(cells)).withColumn("is_row", F.lit(False))
    held = rows.withColumn("query_no", F.lit(0).cast("long")).withColumn("cell", F.pmod(number, F.lit(cells)).cast("int")).withColumn("group", every(groups)).withColumn("is_row", F.lit(True))
    both = told.unionByName(held).repartitionById(groups * cells, F.col("cell") * groups + F.col("group")).sortWithinPartitions("is_row")
    found = both.select("is_row", "query_no", "id", "v").mapInArrow(scan(k, scale), "query_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
