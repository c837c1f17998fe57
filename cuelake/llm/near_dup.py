"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Every document's distinct word shingles give MinHash samples. Their bands propose candidates; the samples
folded into a parity bitmap (an odd sketch, Mitzenmacher, Pagh and Pham 2014) tell by the population count of
an XOR which candidates can be similar enough; those are confirmed on their full shingle sets.

Documents with equal sets are one class from the start. Within a bucket a class is compared with the
bucket's leader, not with all others; that comparison also gives the short difference of the two sets. The
leader's text travels once for each LEADER_NODES of its classes. Classes that their leader leaves out are
then compared with the leader's other classes by sketch and by these differences, which tell every
similarity exactly, in blocks of bounded size and without more texts; for that, a leader's nodes with their
differences are copied once for each of its blocks of BLOCK_NODES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import LOWER_BYTES, U64, Words, cut, fresh, merged, mix, narrow_cut, pieces, run_hashes, settled, signed, text_bytes
from cuelake.llm.components import components

#: At a similarity of 0.85 a pair misses all bands with probability (1 - 0.85**5)**32, about 7e-9.
BANDS, BAND_ROWS = 32, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 512
#: Nodes, and elements of their differences to the leader, that are compared with one another in a task at a time.
BLOCK_NODES, BLOCK_ELEMENTS = 4096, 1 << 20
#: Nodes of a leader that are compared with it in one group.
LEADER_NODES = 1024
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)
_SALTS = mix(np.arange(1001, SAMPLES + 1001, dtype=U64))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, values, ends): the distinct shingle hashes of the texts from..to, sorted within each text.

    A text of fewer words than size is one shingle; a text without words has none.
    """
    data, ends = text_bytes(column)
    for lo, hi in pieces(ends):
        for i in range(lo, hi, 4096):
            j = min(hi, i + 4096)
            words = Words(LOWER_BYTES[data[ends[i] : ends[j]]], ends[i : j + 1] - ends[i])
            hashes, of_text = words.hashes(), words.of_text
            many = np.diff(of_text)
            runs = run_hashes(hashes, size)
            at = np.arange(len(runs))
            text = np.repeat(np.arange(j - i), many)
            inside = at + size <= of_text[1:][text[: len(runs)]]
            values, owner = runs[inside], text[: len(runs)][inside]
            short = np.flatnonzero((many > 0) & (many < size))
            if len(short):
                whole = np.array([run_hashes(hashes[of_text[k] : of_text[k + 1]], int(many[k]), seed=7)[0] for k in short], U64)
                values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
            # 52 bits of hash below the text's number: one sort makes each text's values distinct
            key = np.sort((owner.astype(U64) << U64(52)) | (values >> U64(12)))
            if len(key):
                key = key[np.append(True, key[1:] != key[:-1])]
            yield i, j, key & U64((1 << 52) - 1), np.searchsorted(key >> U64(52), np.arange(j - i + 1, dtype=U64))


def _signatures(size: int):
    """For mapInArrow over (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, ends in shingle_sets(batch.column(2), size):
                n = np.diff(ends)
                full = np.flatnonzero(n > 0)
                one, two = np.zeros(j - i, U64), np.zeros(j - i, U64)
                bands = np.zeros((len(full), BANDS), U64)
                sketch = np.zeros((j - i, SKETCH_BITS // 64), U64)
                if len(full):
                    starts = ends[:-1][full]
                    spread = mix(values)
                    one[full] = np.add.reduceat(spread, starts)
                    two[full] = np.bitwise_xor.reduceat(mix(spread + U64(0x5851F42D4C957F2D)), starts)
                    for k in range(SAMPLES):
                        least = np.minimum.reduceat(spread * _FACTORS[k], starts)
                        salted = mix(least ^ _SALTS[k])
                        bands[:, k // BAND_ROWS] = bands[:, k // BAND_ROWS] * U64(0x9E3779B97F4A7C15) + salted
                        bit = salted >> U64(55)
                        sketch[full, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
                    bands = mix(bands)
                band_ends = np.zeros(j - i + 1, np.int32)
                band_ends[1:] = np.cumsum((n > 0) * BANDS)
                words = SKETCH_BITS // 64
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(n.astype(np.int64)),
                        pa.array(signed(one)),
                        pa.array(signed(two)),
                        pa.ListArray.from_arrays(pa.array(band_ends), pa.array(signed(bands.ravel()))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * words, words, dtype=np.int32)), pa.array(signed(sketch.ravel()))),
                    ],
                    names=["row", "id", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def _spokes(size: int, percent: int):
    """For mapInArrow over (leader, part, node, sketch, text), sorted: the links and the hashes in one set only.

    The leader's own row comes first in each part; its set is all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets: list[np.ndarray] = []
                for _, _, values, ends in shingle_sets(part.column(4), size):
                    sets += np.split(values, ends[1:-1])
                theirs = part.column(0).to_numpy() != part.column(2).to_numpy()
                differ, total = [], []
                for x, is_node in zip(sets, theirs.tolist(), strict=True):
                    if is_node:
                        differ.append(np.setxor1d(own, x, assume_unique=True))
                        total.append(len(own) + len(x))
                    else:
                        own = x
                if not differ:
                    continue
                at = pa.array(np.flatnonzero(theirs))
                n = np.array([len(x) for x, is_node in zip(sets, theirs.tolist(), strict=True) if is_node], np.int64)
                apart = np.array([len(d) for d in differ], np.int64)
                ends = np.concatenate([[0], np.cumsum(apart)]).astype(np.int32)
                columns = [
                    part.column(0).take(at),
                    part.column(2).take(at),
                    part.column(3).take(at),
                    pa.array(n),
                    pa.array(similar(np.array(total, np.int64), apart, percent)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(differ)))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["leader", "node", "sketch", "n", "linked", "differ"])

    return run


def similar(total: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Is the similarity of two sets large enough? total: their sizes together; apart: elements in one of them only."""
    return (100 * (total - apart) >= percent * (total + apart)) & (total > apart)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal values in the first so many columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        starts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            mark = tuple(marks[lo])
            if held and mark != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = mark
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _between(percent: int, bound: int):
    """For mapInArrow over a leader's nodes, sorted: links that join what the leader leaves apart.

    Rows are (leader, i, j, block, node, n, linked, differ, sketch). Of two sets x and y with differences dx
    and dy to the leader's, the elements in one only are those in one of dx and dy only, hence the leader's
    differences, which are short among near copies, give every similarity exactly. The sketches first leave
    out pairs that cannot be similar enough. Of many links that join the same two components one is told.
    """

    def joined(table: pa.Table) -> tuple[list[int], list[int]]:
        get = lambda name: table.column(name).combine_chunks()
        block, node, n, linked = (get(name).to_numpy(zero_copy_only=False) for name in ("block", "node", "n", "linked"))
        crossed = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        lists = get("differ")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()[ends[0] : ends[-1]]
        ends = ends.astype(np.int64) - ends[0]
        apart = np.diff(ends)
        owner = np.repeat(np.arange(len(node)), apart)
        order = np.argsort(values, kind="stable")
        values, postings = values[order], owner[order]
        place = np.empty(len(order), np.int64)
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        number = np.zeros(len(order), np.int64)
        number[first[1:]] = 1
        place[order] = np.cumsum(number)
        edges = np.append(first, len(order))
        sketches = get("sketch").flatten().to_numpy().view(U64).reshape(len(node), -1)
        # all that the leader links are one component
        label = np.where(linked, len(node), np.arange(len(node)))
        a, b = [], []
        for x in np.flatnonzero(~linked):
            may = label != label[x]
            if crossed:
                may &= block != block[x]
            may = np.flatnonzero(may)
            may = may[np.bitwise_count(sketches[may] ^ sketches[x]).sum(axis=1) <= bound]
            if not len(may):
                continue
            mine = place[ends[x] : ends[x + 1]]
            many = edges[mine + 1] - edges[mine]
            at = np.repeat(edges[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(postings[at], minlength=len(node))[may]
            near = may[similar(n[x] + n[may], apart[x] + apart[may] - 2 * common, percent)]
            for other in np.unique(label[near]):
                y = near[label[near] == other][0]
                a.append(int(node[x]))
                b.append(int(node[y]))
                label[label == other] = label[x]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            a, b = joined(table)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def sketch_bound(percent: int) -> int:
    """The XOR population count that pairs of at least this similarity stay under, six deviations of the samples off."""
    t = percent / 100
    differ = SAMPLES * (1 - t) + 6 * np.sqrt(SAMPLES * t * (1 - t))
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS)) + np.sqrt(SKETCH_BITS))


def _distance(a: str, b: str):
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, row_col: str | None = None) -> DataFrame:
    """(row, id, n_shingles, component_id, first): first tells the one row of each component to keep.

    A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+; a set holds the distinct shingles of size words, or
    the whole sequence of a shorter text. Documents are linked if 100 * intersection >= percent * union of
    their sets. component_id is the smallest id reachable. Null and empty texts have no shingle and stand
    alone. Repeated rows are one component; null ids sort before others. row_col: a unique number of docs'
    rows, taken as it is. An empty table gives an empty result. The result stands in the checkpoint folder.
    """
    docs = docs if row_col else settled(docs)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    keyed = docs.select(row.cast("long").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(keyed.dtypes)["id"]
    bound = sketch_bound(percent)
    sigs = cut(merged(keyed.mapInArrow(_signatures(size), f"row long, id {kind}, n long, d1 long, d2 long, bands array<long>, sketch array<long>"), keyed))
    rows = sigs.count()
    classes = narrow_cut(sigs.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "row")).alias("least")), rows).withColumn("node", F.col("least.row"))
    nodes = sigs.join(classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "bands", "sketch")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("many")).where("many > 1").select("key", "leader")
    stars = narrow_cut(buckets.join(leaders, "key").where("node <> leader").select("leader", "node").distinct(), 2 * rows)
    members = stars.select("node").unionByName(stars.select(F.col("leader").alias("node"))).distinct()
    known = nodes.select("node", "n", "sketch").join(members, "node")
    texts = keyed.select(F.col("row").alias("node"), "text").join(members, "node")

    # the sketches decide pairs that stand alone with their leader; the others are needed for what follows too
    many = stars.groupBy("leader").agg(F.count("*").alias("many"))
    a = known.select(F.col("node").alias("leader"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = known.select("node", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_distance("sa", "sb") <= bound)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / LEADER_NODES)).cast("int")
    pairs = narrow_cut(stars.join(many, "leader").join(a, "leader").join(b, "node").where(near | (F.col("many") > 1)).select("leader", part.alias("part"), "node", F.col("sb").alias("sketch")), 2 * rows)
    own = pairs.select("leader", "part").distinct().select("leader", "part", F.col("leader").alias("node"), F.lit(None).cast("array<long>").alias("sketch"))
    # the leader's row sorts before those of its nodes, as the least node of a bucket leads
    told = own.unionByName(pairs).join(texts, "node").select("leader", "part", "node", "sketch", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", "node")
    spokes = cut(merged(told.mapInArrow(_spokes(size, percent), "leader long, node long, sketch array<long>, n long, linked boolean, differ array<long>"), keyed))

    # nodes of a leader that it doesn't link with all its others, in blocks of bounded size
    left = spokes.groupBy("leader").agg(F.count("*").alias("many"), F.sum(F.size("differ")).alias("elements"), F.bool_and("linked").alias("done")).where("many > 1 and not done")
    left = left.select("leader", F.ceil(F.greatest(F.col("many") / BLOCK_NODES, F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    held = spokes.join(left, "leader").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "linked", "differ", "sketch")
    between = held.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_between(percent, bound), "a long, b long")
    labels = components(spokes.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(between), "a", "b", rows)

    ends = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ends.groupBy("component").agg(F.min("least").alias("first"))
    of_class = ends.join(least, "component").select("n", "d1", "d2", "first")
    alone = F.struct("id", "row")
    placed = sigs.select("row", "id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left").withColumn("first", F.coalesce("first", alone))
    return narrow_cut(placed.select("row", "id", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("first")), rows)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, of equal ids any one.

    Null and empty texts stand alone and all stay; of repeated rows one stays. The columns are those of docs,
    whatever their names; an empty table stays empty.
    """
    docs = settled(docs)
    (row,) = fresh(docs, "_row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    found = find_near_duplicates(keyed, id_col, text_col, size, percent, row_col=row)
    left = keyed.join(found.where(~F.col("first")).select(F.col("row").alias(row)), row, "left_anti")
    return merged(left.select(*[F.col(f"`{c}`") for c in docs.columns]), docs)
