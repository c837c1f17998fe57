"""Periodic runs of words, found by a suffix automaton with small-to-large merging of end-position sets.

A run is a stretch of words that repeats with its smallest period and that no neighbouring word extends. Each
state of the automaton stands for sequences that end at the same places. Where two sets of places meet on the way
up the suffix links, the smaller is put into the larger one by one, and each new pair of neighbours whose distance
is no more than the state's length marks a square, a sequence that stands twice in a row. Squares are extended to
runs as far as the words agree.

Words that cannot be part of any long run are set aside first: of a run of k periods, each pair of adjacent words
stands in it k - 1 times at least, so a text falls apart at pairs that are rarer in it.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuelake.llm.common import pieces, text_bytes

#: Values in a block of an ordered set.
BLOCK = 512
#: Times that a text is taken apart at rare pairs before the automaton gets what is left.
ROUNDS = 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Ends:
    """An ordered set of places in blocks; adding one tells its neighbours, -1 where there is none."""

    __slots__ = ("blocks", "size", "tops")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            k -= 1
            self.tops[k] = x
        block = self.blocks[k]
        j = bisect_left(block, x)
        before = block[j - 1] if j else self.blocks[k - 1][-1] if k else -1
        after = block[j] if j < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(j, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops[k : k + 1] = [block[half - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(codes: list[int]) -> tuple[array, array, array]:
    """Longest length, suffix link and end of each state; clones have the end -1.

    A state's first transition stands in two arrays, further ones in a dictionary: most states have one.
    """
    length, link, end = array("q", [0]), array("q", [-1]), array("q", [-1])
    char, to = array("q", [-1]), array("q", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(codes):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        char.append(-1)
        to.append(-1)
        p, last = last, new
        while p != -1:
            if char[p] == -1:
                char[p], to[p] = c, new
            elif char[p] == c or c in more.get(p, ()):
                break
            else:
                more.setdefault(p, {})[c] = new
            p = link[p]
        if p == -1:
            continue
        q = to[p] if char[p] == c else more[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(-1)
        char.append(char[q])
        to.append(to[q])
        if q in more:
            more[clone] = dict(more[q])
        while p != -1:
            if char[p] == c:
                if to[p] != q:
                    break
                to[p] = clone
            elif more.get(p, {}).get(c) == q:
                more[p][c] = clone
            else:
                break
            p = link[p]
        link[q] = link[new] = clone
    return length, link, end


def squares(codes: list[int]) -> dict[int, set[int]]:
    """Period to ends of first halves: places e and e + period that end the same sequence of at least period words."""
    length, link, end = automaton(codes)
    ends: list[int | Ends | None] = [e if e >= 0 else None for e in end]
    found: dict[int, set[int]] = {}
    for v in np.argsort(-np.frombuffer(length, np.int64), kind="stable"):
        v = int(v)
        up = link[v]
        own, ends[v] = ends[v], None
        if up <= 0 or own is None:
            continue
        large = ends[up]
        if large is None:
            ends[up] = own
            continue
        sizes = [x.size if isinstance(x, Ends) else 1 for x in (own, large)]
        small, large = (own, large) if sizes[0] <= sizes[1] else (large, own)
        large = large if isinstance(large, Ends) else Ends(large)
        ends[up], most = large, length[up]
        for x in small if isinstance(small, Ends) else (small,):
            before, after = large.add(x)
            if before >= 0 and x - before <= most:
                found.setdefault(x - before, set()).add(before)
            if after >= 0 and after - x <= most:
                found.setdefault(after - x, set()).add(x)
    return found


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, compared in growing steps."""
    at, step, n = 0, 16, len(a)
    while at < n:
        other = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(other):
            return at + int(other[0])
        at += step
        step = min(2 * step, 1 << 16)
    return n


def runs_of(codes: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of so many words and periods at least, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for d, ends in squares(codes.tolist()).items():
        a, b, done = codes[:-d], codes[d:], -1
        for e in sorted(ends):
            if e < done:
                continue
            done = e + _agree(a[e:], b[e:])
            start = e + 1 - _agree(a[e::-1], b[e::-1])
            # the same stretch may show several periods; the others are multiples of the smallest
            where = (start, done + d)
            best[where] = min(d, best.get(where, d))
    return sorted((s, e - s, d) for (s, e), d in best.items() if e - s >= max(least_length, least_exponent * d))


def stretches(codes: np.ndarray, ends: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[int, int]]:
    """[from, to) of the stretches that may hold runs; ends: where texts end in codes."""
    size = int(codes.max()) + 1 if len(codes) else 1
    linked = np.ones(max(len(codes) - 1, 0), bool)
    inner = ends[(ends > 0) & (ends < len(codes))]
    linked[inner - 1] = False
    at = np.flatnonzero(linked)
    pair = codes[:-1].astype(np.int64) * size + codes[1:]
    _, pair = np.unique(pair, return_inverse=True)
    kinds = int(pair.max()) + 1 if len(pair) else 1
    for _ in range(ROUNDS):
        if not len(at):
            break
        fresh = np.diff(at, prepend=-2) != 1
        _, which, counts = np.unique((np.cumsum(fresh) - 1) * kinds + pair[at], return_inverse=True, return_counts=True)
        left = at[counts[which] >= least_exponent - 1]
        begins = np.flatnonzero(np.diff(left, prepend=-2) != 1)
        sizes = np.diff(begins, append=len(left))
        left = left[np.repeat(sizes >= least_length - 1, sizes)]
        if len(left) == len(at):
            break
        at = left
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True) if len(begins) else ():
        yield int(at[a]), int(at[b - 1]) + 2


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, and the n+1 ends of the texts in them; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=ends[1:])
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(real.to_numpy(zero_copy_only=False), out=kept[1:])
    return flat.filter(real), kept[ends]


def _of_texts(column: pa.Array, least_length: int, least_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, ends = split_words(column)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    rows: list[tuple[int, int, int]] = []
    for a, b in stretches(codes, ends, least_length, least_exponent):
        rows += [(a + s, n, d) for s, n, d in runs_of(codes[a:b], least_length, least_exponent)]
    found = np.array(sorted(rows), np.int64).reshape(-1, 3)
    text = np.searchsorted(ends, found[:, 0], "right") - 1
    sizes = np.zeros(len(ends), np.int32)
    np.cumsum(np.bincount(text, minlength=len(ends) - 1)[: len(ends) - 1], out=sizes[1:])
    parts = [pa.array(found[:, 0] - ends[text]), pa.array(found[:, 1]), pa.array(found[:, 2])]
    runs = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(parts, fields=list(RUN)))
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    stay = np.cumsum(gone[:-1]) == 0
    upto = np.zeros(len(words) + 1, np.int32)
    np.cumsum(stay, out=upto[1:])
    kept = pa.ListArray.from_arrays(pa.array(upto[ends]), words.filter(pa.array(stay)))
    return pa.array(np.diff(ends)), runs, pc.binary_join(kept, " ")


def find_runs(docs: DataFrame, text_col: str = "text", least_length: int = 6, least_exponent: int = 4, words_col: str = "n_words", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """docs with words_col (number of words), runs_col (start, length and period of each run, by start, then period;
    words counted from 0) and collapsed_col (the words that no run holds after its first period, joined by one blank).

    Runs have at least least_length words and least_exponent (2 or more) periods. Texts are taken whole; memory grows
    with the longest text, by some hundred bytes a word of stretches that repeat. Null and empty texts have no words,
    no runs and an empty collapsed text. Repeated rows stay; input columns named like a result are replaced. Rows are
    not moved: nothing is shuffled.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    results = {words_col.lower(), runs_col.lower(), collapsed_col.lower()}
    keep = [c for c in docs.columns if c.lower() not in results or c.lower() == text_col.lower()]
    text_at = next(n for n, c in enumerate(keep) if c.lower() == text_col.lower())
    rows = docs.select(*[docs[f"`{c}`"].alias(f"c{n}") for n, c in enumerate(keep)])
    added = [T.StructField("r0", T.LongType()), T.StructField("r1", T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in RUN]))), T.StructField("r2", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            _, ends = text_bytes(column)
            for i, j in pieces(ends):
                new = _of_texts(column.slice(i, j - i), least_length, least_exponent)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=schema.names)

    task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = run
    out = rows.mapInArrow(task, schema)
    names = {f"c{n}": c for n, c in enumerate(keep) if c.lower() not in results} | {"r0": words_col, "r1": runs_col, "r2": collapsed_col}
    return out.select(*[out[k].alias(v) for k, v in names.items()])
