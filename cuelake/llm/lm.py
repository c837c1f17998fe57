"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; every decision has a tree of the bytes before it, up to DEPTH deep, and
the Krichevsky-Trofimov estimates of all depths are mixed with the weights that the training texts give them
(Willems, Shtarkov and Tjalkens 1995). The prediction after training is fixed, so a text's code length is a
sum over its byte sequences of DEPTH + 1 bytes; a node that training never reached says one half.

Blocks of documents (the partitions of the input) state once which byte sequences and words they hold, with
the counts from training documents. Sequences are dealt out by their latest bytes; each part adds up the
counts of its subtrees and sends what they add to the nodes above (depth 2 and less), which are put together
from all parts. Then each part weights its subtrees and answers every block with exactly the values it asked
for. The whole model is never in one place, and a frequent context is split by its third byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import LOWER_BYTES, U64, Words, cut, mix, narrow_cut, pieces, settled, shuffle_partitions, text_bytes

#: Bytes of context: with the symbol, as many as a 64-bit key holds.
DEPTH = 7
#: Sequences are dealt out by two context bytes and the third byte's place in so many groups; whole subtrees of
#: TOP bytes stand in one part, so that depths below TOP are put together from all parts.
TOP, SPLIT = 3, 8
#: Sequences weighted at once, where whole subtrees allow it, so that a worker's memory is bounded.
WEIGH_KEYS = 200_000
#: Blocks whose sequences make a part, about, so that parts grow in number with the input and not in size.
PART_BLOCKS = 4
#: Stands before a text and, as a symbol, after it; no UTF-8 text holds this byte.
EDGE = 0xFF
#: Smoothing of the word model.
ALPHA = 0.1
WORD, BYTES = 0, 1
#: The word that ends every text.
_END = U64(0xFFFFFFFFFFFFFFFF)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, to about 1e-12."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for k in range(6):
        shift = shift * (x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


#: Small counts, which are most, look their values up.
_HALF, _WHOLE = lgamma(np.arange(1 << 12) + 0.5), lgamma(np.arange(1 << 13) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    out = np.empty(len(zeros))
    small = (zeros < len(_HALF)) & (ones < len(_HALF))
    a, b = zeros[small], ones[small]
    out[small] = _HALF[a] + _HALF[b] - _WHOLE[a + b]
    a, b = zeros[~small], ones[~small]
    out[~small] = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0)
    return out - 1.1447298858494002


def sequences(data: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every symbol with its context, the end of each text included, and the n+1 ends of the texts.

    In a key the latest byte of the context stands highest, then the one before, ... and the symbol lowest,
    hence keys that share recent context are neighbours.
    """
    n = len(ends) - 1
    size = np.diff(ends)
    where = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * depth + np.arange(n), size)
    wide = np.full(len(data) + n * (depth + 1), EDGE, np.uint8)
    wide[where] = LOWER_BYTES[data]
    key = np.zeros(len(wide) - depth if len(wide) else 0, U64)
    for k in range(1, depth + 1):
        key = (key << U64(8)) | wide[depth - k : len(wide) - k]
    key = (key << U64(8)) | wide[depth:]
    starts = ends[:-1] + np.arange(n) * (depth + 1)
    out_ends = np.concatenate([[0], np.cumsum(size + 1)])
    pick = np.arange(out_ends[-1]) + np.repeat(starts - out_ends[:-1], size + 1)
    return key[pick], out_ends


@dataclass
class Nodes:
    """The binary nodes of one depth for one of the eight decisions.

    of_row: the node of each (context, symbol) row of this depth; first: the first row of each node; zeros and
    ones: the training counts; weighted: log of the weighted probability; stop: the share of the node's own
    estimate in it.
    """

    of_row: np.ndarray
    first: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray | None = None
    stop: np.ndarray | None = None


def starts(x: np.ndarray) -> np.ndarray:
    """Flags of the first of equal neighbours."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def bit_of(keys: np.ndarray, done: int) -> np.ndarray:
    return (keys >> U64(7 - done)) & U64(1)


def nodes_of(rows: np.ndarray, counts: np.ndarray) -> list[Nodes]:
    """Nodes over sorted (context, symbol) rows, by how many bits of the symbol are done."""
    out = []
    for done in range(8):
        flags = starts(rows >> U64(8 - done))
        first = np.flatnonzero(flags)
        ones = np.where(bit_of(rows, done) == 1, counts, 0)
        both = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        one = np.add.reduceat(ones, first) if len(first) else np.zeros(0, np.int64)
        out.append(Nodes((np.cumsum(flags) - 1).astype(np.int32), first, both - one, one))
    return out


def settle(own: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted, stop): the node's own estimate and its children's product mixed, each at one half."""
    weighted = np.logaddexp(own, spread) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def parents(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows one byte of context shorter, sorted, and the place of each row's parent in them."""
    up = (rows >> U64(16) << U64(8)) | (rows & U64(255))
    order = np.argsort(up)
    flags = starts(up[order])
    of_row = np.empty(len(up), np.int64)
    of_row[order] = np.cumsum(flags) - 1
    return up[order][flags], of_row


class Subtrees:
    """Whole subtrees of `top` context bytes over sorted keys, weighted from the leaves up to that depth.

    rows[k], up[k] and nodes[k] belong to depth - k: its (context, symbol) rows, each row's parent among
    rows[k + 1], and the binary nodes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int = TOP, depth: int = DEPTH):
        self.top, self.depth = top, depth
        self.rows, self.up, self.nodes = [keys], [], [nodes_of(keys, counts)]
        for _ in range(depth - top):
            shorter, of_row = parents(self.rows[-1])
            counts = np.bincount(of_row, counts, minlength=len(shorter)).astype(np.int64)
            self.rows.append(shorter)
            self.up.append(of_row)
            self.nodes.append(nodes_of(shorter, counts))
        for k, level in enumerate(self.nodes):
            for done, x in enumerate(level):
                own = log_kt(x.zeros, x.ones)
                if not k:
                    x.weighted = own
                    continue
                below = self.nodes[k - 1][done]
                parent = x.of_row[self.up[k - 1][below.first]]
                x.weighted, x.stop = settle(own, np.bincount(parent, below.weighted, minlength=len(own)))

    def sums(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(done, node, zeros, ones, spread): what the uppermost nodes add to those one byte shorter."""
        rows = self.rows[-1]
        for done, x in enumerate(self.nodes[-1]):
            node, at = np.unique(node_keys(rows[x.first], done, 1), return_inverse=True)
            yield done, node, *(np.bincount(at, v, minlength=len(node)) for v in (x.zeros, x.ones, x.weighted))

    def logs(self, above: "list[Table]") -> np.ndarray:
        """log10 probability of each key's symbol in its context; above has the tables of depths 0..top-1."""
        out = np.zeros(len(self.rows[0]))
        for done in range(8):
            rows = self.rows[-1]
            # the share of the estimates so far, and what is left of the weight, on the way down
            told, left, bit = np.zeros(len(rows)), np.ones(len(rows)), bit_of(rows, done)
            for d, table in enumerate(above):
                zeros, ones, stop = table.find(node_keys(rows, done, self.top - d), done)
                told, left = told + left * stop * estimate(zeros, ones, bit), left * (1 - stop)
            for k in range(len(self.nodes) - 1, -1, -1):
                x = self.nodes[k][done]
                if k < len(self.nodes) - 1:
                    told, left = told[self.up[k]], left[self.up[k]]
                own = estimate(x.zeros[x.of_row], x.ones[x.of_row], bit_of(self.rows[k], done))
                if k:
                    stop = x.stop[x.of_row]
                    told, left = told + left * stop * own, left * (1 - stop)
                else:
                    told += left * own
            out += np.log10(told)
        return out


def estimate(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability that the next decision is the bit."""
    return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def node_keys(rows: np.ndarray, done: int, shorter: int) -> np.ndarray:
    """Names of the rows' nodes, so many bytes of context shorter: the context and, after a one, the bits done."""
    prefix = (U64(1) << U64(done)) | ((rows & U64(255)) >> U64(8 - done))
    return (rows >> U64(8) >> U64(8 * shorter) << U64(8)) | prefix


class Table:
    """Nodes of one depth by name: zeros, ones and stop."""

    def __init__(self) -> None:
        self.by_done: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * 8

    @staticmethod
    def of(node: np.ndarray, done: np.ndarray, zeros: np.ndarray, ones: np.ndarray, stop: np.ndarray) -> "Table":
        out = Table()
        order = np.lexsort((node, done))
        edges = np.searchsorted(done[order], np.arange(9))
        for k in range(8):
            at = order[edges[k] : edges[k + 1]]
            out.by_done[k] = (node[at], zeros[at], ones[at], stop[at])
        return out

    def find(self, node: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """zeros, ones and stop of the nodes; no counts where there is none."""
        names, zeros, ones, stop = self.by_done[done]
        if not len(names):
            return np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.ones(len(node))
        at = np.minimum(np.searchsorted(names, node), len(names) - 1)
        there = names[at] == node
        return np.where(there, zeros[at], 0), np.where(there, ones[at], 0), np.where(there, stop[at], 1.0)


# ---- the distributed part --------------------------------------------------------------------

_PACKED = "prefixes binary, sizes binary, low binary"
_ASKED = f"kind int, part int, block int, {_PACKED}, counts binary"
_NODE = "node long, done int, zeros long, ones long"


def squeeze(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then their second bytes, ..., compressed, after the length of all that."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def expand(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def rounded(logs: np.ndarray) -> np.ndarray:
    """As 32-bit numbers whose last byte is zero, which compresses; off by 2**-16 of the value at most."""
    bits = logs.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def pack(keys: np.ndarray) -> list[bytes]:
    """Sorted keys as their high parts, how many keys each has, and the low 32 bits, all squeezed."""
    high = (keys >> U64(32)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys))).astype(np.uint32)
    return [squeeze(high[first]), squeeze(sizes), squeeze((keys & U64(0xFFFFFFFF)).astype(np.uint32))]


def unpack(prefixes: bytes, sizes: bytes, low: bytes) -> np.ndarray:
    high = np.repeat(expand(prefixes, np.uint32), expand(sizes, np.uint32))
    return (high.astype(U64) << U64(32)) | expand(low, np.uint32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(starts(keys))
    return keys[first], np.add.reduceat(counts, first)


class Gathered:
    """Keys with counts, added up now and then so that a task holds little more than the distinct ones."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.many += len(keys)
        if self.many > 1_000_000:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
            self.waiting, self.many = [], 0
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            self.counts[at[known]] += counts[known]
            if len(self.keys):
                self.keys, self.counts = np.insert(self.keys, at[~known], keys[~known]), np.insert(self.counts, at[~known], counts[~known])
            else:
                self.keys, self.counts = keys, counts
        return self.keys, self.counts


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in training texts."""
    plain, held = np.sort(keys[train]), np.sort(keys[~train])
    first, held = np.flatnonzero(starts(plain)), held[starts(held)]
    times = np.diff(np.append(first, len(plain)))
    if not len(held):
        return plain[first], times
    return summed(np.concatenate([plain[first], held]), np.concatenate([times, np.zeros(len(held), np.int64)]))


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, each text closed by the end token, and the n+1 ends of the texts."""
    words = Words(LOWER_BYTES[data], ends)
    n = len(ends) - 1
    many = np.diff(words.of_text)
    out_ends = np.concatenate([[0], np.cumsum(many + 1)])
    out = np.full(out_ends[-1], _END, U64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), many)] = words.hashes()
    return out, out_ends


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each sequence: by two context bytes and the group of the third."""
    return (mix((keys >> U64(8 * (DEPTH - 1))) * U64(SPLIT) + (keys >> U64(8 * (DEPTH - 2))) % U64(SPLIT)) % U64(parts)).astype(np.int32)


def _asked(parts: int):
    """For mapInArrow over (block, trains, text): the task's distinct sequences and words, by part."""

    def told(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            at = order[edges[p] : edges[p + 1]]
            values = [kind, int(p), block, *pack(keys[at]), squeeze(counts[at])]
            types = [pa.int32()] * 3 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["kind", "part", "block", "prefixes", "sizes", "low", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words, block = Gathered(), Gathered(), None
        for batch in batches:
            if batch.num_rows:
                block = batch.column(0)[0].as_py()
            trains = np.asarray(batch.column(1)).astype(bool)
            data, ends = text_bytes(batch.column(2))
            for i, j in pieces(ends):
                for kind, into in ((sequences, found), (_words, words)):
                    keys, key_ends = kind(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                    into.add(*counted(keys, np.repeat(trains[i:j], np.diff(key_ends))))
        if block is None:
            return
        keys, counts = found.result()
        yield from told(BYTES, block, keys, counts, part_of(keys, parts))
        keys, counts = words.result()
        yield from told(WORD, block, keys, counts, (mix(keys) % U64(parts)).astype(np.int32))

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part; rows come sorted by part, the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = [*np.flatnonzero(starts(part)).tolist(), len(part)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != part[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    """Values of the columns, row by row."""
    for batch in table.select(names).to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sequences that blocks ask for, with the sums of their counts."""
    found = Gathered()
    for *packed, counts in _rows(rows, "prefixes", "sizes", "low", "counts"):
        found.add(unpack(*packed), expand(counts, np.int64))
    return found.result()


def _subtrees(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole subtrees of TOP context bytes at a time."""
    context = keys >> U64(8 * (DEPTH + 1 - TOP))
    ends = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
    start = 0
    while start < len(keys):
        fits = int(np.searchsorted(ends, start + WEIGH_KEYS, "right")) - 1
        end = int(ends[max(fits, int(np.searchsorted(ends, start, "right")))])
        yield keys[start:end], counts[start:end]
        start = end


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a part's rows: what its subtrees add to the nodes of depth TOP - 1."""
    for table in _parts(batches):
        for keys, counts in _subtrees(*_merged(table)):
            for done, node, zeros, ones, spread in Subtrees(keys, counts).sums():
                columns = [pa.array(node.view(np.int64)), pa.array(np.full(len(node), done, np.int32)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(spread)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "done", "zeros", "ones", "spread"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, done, zeros, ones, spread): the same nodes with stop and weighted."""
    for batch in batches:
        zeros, ones, spread = (batch.column(k).to_numpy() for k in (2, 3, 4))
        weighted, stop = settle(log_kt(zeros, ones), spread)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(stop), pa.array(weighted)], names=["node", "done", "zeros", "ones", "stop", "weighted"])


def _shorter(nodes: DataFrame) -> DataFrame:
    """What nodes add to those of one byte less context: (node, done, zeros, ones, spread)."""
    name = F.shiftleft(F.shiftrightunsigned("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
    return nodes.groupBy(name.alias("node"), "done").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("spread"))


def top_tables(rows: pa.Table) -> list[Table]:
    """The tables of depths 0 and 1 from the sums for depth 1."""
    node, done, zeros, ones = (rows.column(n).to_numpy() for n in ("node", "done", "zeros", "ones"))
    weighted, stop = settle(log_kt(zeros, ones), rows.column("spread").to_numpy())
    first = Table.of(node.astype(U64), done, zeros, ones, stop)
    name, at = np.unique(done.astype(np.int64) << 8 | (node & 255), return_inverse=True)
    zeros, ones, spread = (np.bincount(at, x, minlength=len(name)) for x in (zeros, ones, weighted))
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return [Table.of((name & 255).astype(U64), name >> 8, zeros, ones, settle(log_kt(zeros, ones), spread)[1]), first]


def _answers(tops: list[Table]):
    """For mapInArrow over a part's rows: first the nodes of depth 2 (block -1), then what blocks ask for.

    Every block gets the log10 probabilities of its sequences' last bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches):
            above = table.filter(pa.compute.equal(table.column("block"), -1))
            asked = table.filter(pa.compute.greater_equal(table.column("block"), 0))
            node, done, zeros, ones, stop = (above.column(n).to_numpy() for n in ("node", "done", "zeros", "ones", "stop"))
            tables = [*tops, Table.of(node.astype(U64), done, zeros, ones, stop)]
            keys, counts = _merged(asked)
            values = rounded(np.concatenate([np.zeros(0), *(Subtrees(k, c).logs(tables) for k, c in _subtrees(keys, counts))]))
            for block, *packed in _rows(asked, "block", "prefixes", "sizes", "low"):
                mine = squeeze(values[np.searchsorted(keys, unpack(*packed))])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([BYTES], pa.int32()), *(pa.array([b], pa.binary()) for b in (*packed, mine))], names=["block", "kind", "prefixes", "sizes", "low", "values"])

    return run


def _word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a part's rows: each block's words with their counts in all blocks.

    A row of block -1 tells how many tokens and distinct words the part has.
    """
    names = ["block", "kind", "prefixes", "sizes", "low", "values", "tokens", "distinct"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    for table in _parts(batches):
        keys, total = _merged(table)
        rows = [(-1, WORD, b"", b"", b"", b"", int(total.sum()), int((total > 0).sum()))]
        for block, *packed in _rows(table, "block", "prefixes", "sizes", "low"):
            rows.append((block, WORD, *packed, squeeze(total[np.searchsorted(keys, unpack(*packed))]), 0, 0))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), types, strict=True)], names=names)


def _lookup(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values at the keys' places in known; sorted keys find theirs far sooner."""
    order = np.argsort(keys)
    asked = keys[order]
    at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
    if len(keys) and (not len(known) or not np.array_equal(known[at], asked)):
        raise RuntimeError("a block of documents was dealt out differently than before: write the input to a table first")
    out = np.empty(len(keys), values.dtype)
    out[order] = values[at]
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (block, id, trains, text): the documents, compressed, some in a row."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for i, j in pieces(text_bytes(batch.column(3))[1]):
            rows = batch.slice(i, j - i).select(["id", "trains", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])


def _scored(tokens: int, distinct: int):
    """For mapInArrow over the rows of blocks, sorted: a block's answers come before its documents."""

    def known(answers: list[pa.RecordBatch], kind: int, of: type) -> tuple[np.ndarray, np.ndarray]:
        keys, values = [np.zeros(0, U64)], [np.zeros(0, of)]
        for batch in answers:
            for own, *packed, told in zip(*(batch.column(n).to_pylist() for n in ("kind", "prefixes", "sizes", "low", "values")), strict=True):
                if own == kind:
                    keys.append(unpack(*packed))
                    values.append(expand(told, of))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        return keys[order], values[order]

    def score(docs: pa.RecordBatch, words: tuple, sequences_: tuple) -> Iterator[pa.RecordBatch]:
        data, ends = text_bytes(docs.column("text"))
        for i, j in pieces(ends):
            part, local = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            keys, key_ends = _words(part, local)
            counts = _lookup(*words, keys)
            logs = np.log10((counts + ALPHA) / (tokens + ALPHA * (distinct + 1)))
            byte_keys, byte_ends = sequences(part, local)
            values = np.add.reduceat(_lookup(*sequences_, byte_keys).astype(float), byte_ends[:-1])
            own = docs.slice(i, j - i)
            columns = [own.column("id"), own.column("trains"), np.diff(key_ends), np.add.reduceat((counts > 0).astype(np.int64), key_ends[:-1]), np.add.reduceat(logs, key_ends[:-1]), values, -values * np.log2(10) / np.diff(byte_ends)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "trains", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, answers, words, found = None, [], None, None
        for batch in batches:
            block, ord_ = batch.column("block").to_numpy(), batch.column("ord").to_numpy()
            edges = [*np.flatnonzero(starts(block * 2 + ord_)).tolist(), len(block)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if of != block[i]:
                    of, answers, words, found = block[i], [], None, None
                rows = batch.slice(i, j - i)
                if ord_[i] == 0:
                    answers.append(rows)
                    continue
                if words is None:
                    words, found = known(answers, WORD, np.int64), known(answers, BYTES, np.float32)
                    answers = []
                for bundle in rows.column("docs"):
                    for docs in pa.ipc.open_stream(bundle.as_buffer()):
                        yield from score(docs, words, found)

    return run


def score_documents(docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, trains, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each of docs.

    trains: a column that tells which rows the models learn from (null: not). score is the log10 probability
    of the lower-cased (A-Z) text and its end under the byte model (each byte's share to 2**-16 of its value),
    bits_per_byte its code length per byte, the end counted as one. base_score is that of a smoothed word model: tokens are [^\\x20\\x09-\\x0D]+ and
    one end; n_known of the n_tokens occur in training texts. Null and empty texts hold the end alone.
    Repeated rows count each; very long texts are scored whole. Without training rows every bit has
    probability one half and base_score is 0 for an empty vocabulary. An empty table gives an empty result;
    other columns of docs take no part.
    """
    spark = docs.sparkSession
    docs = settled(docs)
    rows = docs.select(F.spark_partition_id().alias("block"), F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    blocks = max(1, docs.rdd.getNumPartitions())
    parts = max(shuffle_partitions(spark), blocks // PART_BLOCKS)
    asked = cut(rows.select("block", "trains", "text").mapInArrow(_asked(parts), _ASKED))
    dealt = lambda df: df.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block")
    columns = ["part", "block", "prefixes", "sizes", "low", "counts"]
    found = asked.where(F.col("kind") == BYTES).select(*columns)

    sums = dealt(found).mapInArrow(_sums, _NODE + ", spread double").groupBy("node", "done").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("spread").alias("spread"))
    # at most 2**24 nodes of depth 2, in any corpus; at most 2**16 of depth 1 come to the driver
    second = narrow_cut(sums.mapInArrow(_settled, _NODE + ", stop double, weighted double"), 1 << 16)
    tops = top_tables(_shorter(second).toArrow())
    groups = second.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))).mapInArrow(_placed(parts), "part int, block int, " + _NODE + ", stop double").distinct()
    both = groups.unionByName(found, allowMissingColumns=True)
    back = dealt(both).mapInArrow(_answers(tops), f"block int, kind int, {_PACKED}, values binary")

    words = cut(dealt(asked.where(F.col("kind") == WORD).select(*columns)).mapInArrow(_word_answers, f"block int, kind int, {_PACKED}, values binary, tokens long, distinct long"))
    told = words.where("block = -1").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = told["tokens"] or 0, told["distinct"] or 0

    answers = back.unionByName(words.where("block >= 0").drop("tokens", "distinct")).withColumn("ord", F.lit(0))
    kind = dict(rows.dtypes)["id"]
    bundles = rows.select("block", "id", "trains", "text").mapInArrow(_bundles, "block int, docs binary").withColumn("ord", F.lit(1))
    all_ = answers.unionByName(bundles, allowMissingColumns=True)
    out = all_.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "ord").mapInArrow(_scored(tokens, distinct), f"id {kind}, trains boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select(F.col("id").alias(id_col), "trains", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _placed(parts: int):
    """For mapInArrow over nodes of depth 2 and a group of third bytes: the part that weights those sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, group = batch.column("node").to_numpy().astype(U64) >> U64(8), batch.column("group").to_numpy().astype(U64)
            part = part_of((pair << U64(8 * (DEPTH - 1))) | (group << U64(8 * (DEPTH - 2))), parts)
            columns = [pa.array(part), pa.array(np.full(len(part), -1, np.int32)), *(batch.column(n) for n in ("node", "done", "zeros", "ones", "stop"))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "node", "done", "zeros", "ones", "stop"])

    return run
