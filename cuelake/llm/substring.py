"""Exact removal of repeated word windows by super-k-mer partitioning.

Each window of consecutive words has a minimiser, the least hash among its shorter runs of words.
Consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to the bucket of
that minimiser, where sorting the windows counts them. Equal windows have equal minimisers, so a minimiser
that occurs once in the corpus needs no trip at all: counts of minimisers, which are small, decide first
which super-k-mers travel. A very frequent minimiser would gather too much in one bucket, so its windows are
counted as 128-bit hashes instead, with partial sums before they travel, and the repeated ones are joined
back to their places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import CHUNK_BYTES, U64, Words, cut, fresh, pieces, run_hashes, settled, signed, text_bytes

#: A minimiser that starts more super-k-mers than this has its windows counted by their hashes.
HOT = 200
#: The places of one window are joined to its hashes in so many groups.
SALTS = 8
_POSITION_BITS = U64(26)


def minimiser_words(width: int) -> int:
    return max(1, width // 5)


class SuperKmers:
    """Runs of consecutive windows of some texts whose minimiser is the same occurrence.

    text: the run's text; at: its first word in that text; windows: how many; number: its place among the
    runs of its text; value: hash of the minimiser.
    """

    def __init__(self, words: np.ndarray, of_text: np.ndarray, width: int):
        m = minimiser_words(width)
        inner = width - m + 1
        hashes = run_hashes(words, m)
        n = len(words) - width + 1
        if n <= 0:
            self.text = self.at = self.windows = self.number = np.zeros(0, np.int64)
            self.value = np.zeros(0, U64)
            return
        least = (hashes >> _POSITION_BITS << _POSITION_BITS) | (np.arange(len(hashes), dtype=U64) & U64((1 << 26) - 1))
        size = 1
        while size * 2 <= inner:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < inner:
            rest = inner - size
            least = np.minimum(least[: len(least) - rest], least[rest:])
        least = least[:n]
        text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))[:n]
        start = np.arange(n)
        fits = start + width <= of_text[1:][text]
        start, text, least = start[fits], text[fits], least[fits]
        if not len(start):
            first = np.zeros(0, np.int64)
        else:
            new = np.ones(len(start), bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
        self.text = text[first]
        self.at = start[first] - of_text[self.text]
        self.windows = np.diff(np.append(first, len(start)))
        before = np.searchsorted(self.text, self.text)
        self.number = np.arange(len(first)) - before
        # the occurrence's place in the concatenated words, from its low bits
        place = start[first] + ((least[first] & U64((1 << 26) - 1)).astype(np.int64) - (start[first] & ((1 << 26) - 1))) % (1 << 26)
        self.value = hashes[place] if len(first) else np.zeros(0, U64)


def _found(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, SuperKmers]]:
    data, ends = text_bytes(column)
    for i, j in pieces(ends):
        part, local = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        words = Words(part, local)
        yield i, j, part, local, SuperKmers(words.hashes(), words.of_text, width)


def _minimisers(width: int) -> Callable:
    """For mapInArrow over (row, text): the minimiser of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for i, _, _, _, kmers in _found(batch.column(1), width):
                if len(kmers.text):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(kmers.value)), pa.array(rows[i + kmers.text]), pa.array(kmers.number.astype(np.int32))], names=["minimiser", "row", "number"])

    return run


def _marked(kmers: SuperKmers, texts: int, marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The super-k-mers with the marked numbers; ends are those of each text's marks."""
    first = np.searchsorted(kmers.text, np.arange(texts))
    return np.repeat(first, np.diff(ends)) + marks[ends[0] : ends[-1]]


def _travellers(width: int) -> Callable:
    """For mapInArrow over (row, text, numbers): the wanted super-k-mers, packed, for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wanted = batch.column(0).to_numpy(), batch.column(2)
            marks, mark_ends = wanted.values.to_numpy(), wanted.offsets.to_numpy()
            for i, j, part, local, kmers in _found(batch.column(1), width):
                # (packed words) -> bucket, windows, rows, starts
                held: dict[bytes, tuple[int, int, list[int], list[int]]] = {}
                at, many, value, text = kmers.at.tolist(), kmers.windows.tolist(), signed(kmers.value).tolist(), kmers.text.tolist()
                words, of = [], -1
                for n in _marked(kmers, j - i, marks, mark_ends[i : j + 1]).tolist():
                    if text[n] != of:
                        of = text[n]
                        words = part[local[of] : local[of + 1]].tobytes().split()
                    packed = b" ".join(words[at[n] : at[n] + many[n] + width - 1])
                    known = held.setdefault(packed, (value[n], many[n], [], []))
                    known[2].append(int(rows[i + of]))
                    known[3].append(at[n])
                if held:
                    columns = zip(*held.values(), strict=True)
                    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([arrays[0], pa.array(list(held), pa.binary()), *arrays[1:]], names=["bucket", "packed", "windows", "rows", "starts"])

    return run


def _hashed(width: int) -> Callable:
    """For mapInArrow over (row, text, numbers): every window of the wanted super-k-mers, as two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wanted = batch.column(0).to_numpy(), batch.column(2)
            marks, mark_ends = wanted.values.to_numpy(), wanted.offsets.to_numpy()
            data, ends = text_bytes(batch.column(1))
            for i, j in pieces(ends):
                if mark_ends[i] == mark_ends[j]:
                    continue
                words = Words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                values = words.hashes()
                kmers = SuperKmers(values, words.of_text, width)
                n = _marked(kmers, j - i, marks, mark_ends[i : j + 1])
                many = kmers.windows[n]
                text = np.repeat(kmers.text[n], many)
                start = np.repeat(kmers.at[n], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = words.of_text[text] + start
                one, two = (signed(run_hashes(values, width, seed)[at]) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(rows[i + text]), pa.array(start.astype(np.int32))], names=["one", "two", "row", "from"])

    return run


def _count(width: int) -> Callable:
    """For mapInArrow over rows sorted by bucket: word ranges covered by windows that occur more than once."""

    def repeated(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        packed = table.column("packed").combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        data = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        words = Words(data, ends - ends[0])
        values = words.hashes()
        one, two = run_hashes(values, width, 1), run_hashes(values, width, 2)
        many = table.column("windows").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(many)), many)
        within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = words.of_text[:-1][row] + within
        one, two = one[at], two[at]
        rows = table.column("rows").combine_chunks()
        row_ends = rows.offsets.to_numpy()
        times = np.diff(row_ends)
        order = np.argsort(one, kind="stable")
        if len(order) > 1 and np.any((one[order][1:] == one[order][:-1]) & (two[order][1:] != two[order][:-1])):
            order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=times[row][order])
        flag = np.zeros(len(order), bool)
        flag[order] = total[group] >= 2
        # runs of flagged windows within a super-k-mer become one range of words
        begins = flag.copy()
        begins[1:] &= ~(flag[:-1] & (row[1:] == row[:-1]))
        stops = flag.copy()
        stops[:-1] &= ~(flag[1:] & (row[1:] == row[:-1]))
        b, e = np.flatnonzero(begins), np.flatnonzero(stops)
        if not len(b):
            return
        owner = row[b]
        n = times[owner]
        flat = np.repeat(row_ends[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who = rows.values.to_numpy()[flat]
        start = table.column("starts").combine_chunks().values.to_numpy()[flat].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array((start + np.repeat(within[b], n)).astype(np.int32)), pa.array((start + np.repeat(within[e], n) + width).astype(np.int32))], names=["row", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 4096):
                held.append(batch.slice(k, 4096))
                if sum(b.nbytes for b in held) < 2 * CHUNK_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                last = int(np.searchsorted(bucket == bucket[-1], True)) if bucket[0] != bucket[-1] else 0
                if last:  # the last bucket may go on
                    yield from repeated(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from repeated(table)

    return run


def _remove(text_at: int, spans_at: int) -> Callable:
    """For mapInArrow: n_words, n_removed and the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts, spans = part.column(text_at).to_pylist(), part.column(spans_at)
                n_words, n_removed, kept = [], [], []
                for text, ranges in zip(texts, spans.to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n_words.append(len(words))
                    if ranges:
                        stays = np.ones(len(words), bool)
                        for r in ranges:
                            stays[r["from"] : r["to"]] = False
                        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                others = [c for n, c in enumerate(part.columns) if n != spans_at]
                columns = [*others, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{n}" for n in range(len(columns))])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = 35, kept_col: str = "kept") -> DataFrame:
    """docs with n_words, n_removed and kept_col: the words outside every window that occurs more than once.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is width consecutive words of one document; it is
    repeated if its words also start anywhere else, in the same document too. Windows are judged on the
    input. Null and empty texts have no words; texts shorter than a window stay whole; repeated rows repeat
    each other's windows. Windows are compared by two independent 64-bit hashes of their words. Input
    columns named like a result are replaced. An empty table gives an empty result.
    """
    docs = settled(docs)
    results = {"n_words", "n_removed", kept_col.lower()}
    keep = [c for c in docs.columns if c.lower() not in results or c == text_col]
    row, spans = fresh(docs, "_row", "_spans")
    keyed = docs.select(F.monotonically_increasing_id().alias(row), F.coalesce(F.col(text_col), F.lit("")).alias("_" + row), *[F.col(f"`{c}`").alias(f"_c{n}") for n, c in enumerate(keep)])
    text = "_" + row
    minimisers = keyed.select(row, text).mapInArrow(_minimisers(width), "minimiser long, row long, number int")
    # as a table of its own, so that the join below can split the rows of a frequent minimiser
    often = cut(minimisers.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1"))
    marks = lambda few: F.sort_array(F.collect_list(F.when((F.col("n") <= HOT) == F.lit(few), F.col("number"))))
    wanted = minimisers.join(often, "minimiser").groupBy(F.col("row").alias(row)).agg(marks(True).alias("_few"), marks(False).alias("_many"))
    asked = keyed.join(wanted, row)
    found = asked.where(F.size("_few") > 0).mapInArrow(_picked(_travellers(width), [0, 1, len(keep) + 2]), "bucket long, packed binary, windows int, rows array<long>, starts array<int>")
    ranges = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(width), "row long, `from` int, `to` int")
    hashed = asked.where(F.size("_many") > 0).mapInArrow(_picked(_hashed(width), [0, 1, len(keep) + 3]), "one long, two long, row long, `from` int")
    again = hashed.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    places = hashed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(again, ["one", "two", "salt"]).select("row", "from", (F.col("from") + width).cast("int").alias("to"))
    gone = ranges.unionByName(places).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("from", "to")).alias(spans))
    joined = keyed.join(gone, row, "left")
    fields = [T.StructField(f"c{n}", f.dataType) for n, f in enumerate(joined.schema.fields[:-1])]
    n = len(fields)
    schema = T.StructType([*fields, T.StructField(f"c{n}", T.LongType()), T.StructField(f"c{n + 1}", T.LongType()), T.StructField(f"c{n + 2}", T.StringType())])
    out = joined.mapInArrow(_remove(1, n), schema)
    names = {**{c: f"c{k + 2}" for k, c in enumerate(keep)}, "n_words": f"c{n}", "n_removed": f"c{n + 1}", kept_col: f"c{n + 2}"}
    return out.select(*[F.col(v).alias(k) for k, v in names.items()])


def _picked(f: Callable, at: list[int]) -> Callable:
    """f over some columns only; the plan keeps the others, so that one exchange of the texts serves both joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(pa.RecordBatch.from_arrays([b.column(k) for k in at], names=[str(k) for k in at]) for b in batches)

    return run
