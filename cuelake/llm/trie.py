"""The prefix trie of conversations: distributed MSD radix partitioning, finished by multikey quicksort.

Turns are encoded by a dictionary, and conversations with the same turns become one weighted sequence of turn ids.
A bucket holds the sequences below one node of the trie. All sequences are dealt out by their first turn that
differs, then the buckets that are still large by the next, and so on; what the sequences of a large bucket share
is skipped in one step. Small buckets go whole to a task, where a three-way quicksort by single turns sorts them and
makes a node of each group of equal turns. Sums over subtrees are carried from the small buckets up to the root.

A node is named by the smallest conversation that passes it and its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.common import cut

#: Turns that the sequences of a small bucket have together at most, unless it is a single sequence.
LOCAL_TURNS = 16_384
#: Conversations of one sequence whose ids are put into one string: those that agree in all but so many bits.
ID_BITS = 14
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
#: What a sequence is made of: the turns' ids, each with its number of words.
TURNS = "array<struct<id:bigint,words:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def encode_turns(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn): the turns with their place in the conversation from 0 and (id, words) from a dictionary.

    Turns stand by order_col, nulls first, ties by the SHA-256 of role and text. A null role or text is empty. Rows
    without a conversation id belong to no conversation and are left out; repeated rows are turns of their own. That
    SHA-256 is the key of the dictionary too: texts are read and hashed in one place and never shuffled.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{order_col}`").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    hashed = rows.select("conv_id", "turn", key.alias("key"), words.alias("words"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    placed = cut(hashed.select("conv_id", "key", "words", (F.row_number().over(place) - 1).cast("long").alias("pos")))
    # numbers that are written once are the same for all who read them
    known = cut(placed.groupBy("key").agg(F.first("words").alias("words")).withColumn("id", F.monotonically_increasing_id()))
    return placed.drop("words").join(known, "key").select("conv_id", "pos", F.struct("id", "words").alias("turn"))


def sequences(encoded: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, n, seq, ends): each distinct sequence once; conv_id is the smallest and n the number of its conversations.

    conversations: a row for each conv_id, with or without turns. ends is the SHA-256 of the ids, ascending and joined by commas:
    ids are joined in blocks and the blocks are hashed as a sorted stream, so a sequence may have any number of them.
    """
    gathered = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("turns"))
    seq = F.coalesce(F.transform("turns", lambda t: t["turn"]), F.array().cast(TURNS))
    own = conversations.select("conv_id").join(gathered, "conv_id", "left").select("conv_id", seq.alias("seq"))
    blocks = own.groupBy("seq", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    rows = blocks.select(F.xxhash64("seq").alias("h"), "seq", "block", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("part"))
    dealt = rows.repartition("h").sortWithinPartitions("h", "seq", "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, first, n = None, None, 0, 0
        for batch in batches:
            done: list[tuple] = []
            for seq, a, m, part in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if held is not None and seq == held:
                    digest.update(b",")
                    n += m
                else:
                    if held is not None:
                        done.append((first, n, held, digest.hexdigest()))
                    held, digest, first, n = seq, hashlib.sha256(), a, m
                digest.update(part.encode())
            if done:
                yield _rows(done, batch.schema.field(1).type)
        if held is not None:
            yield _rows([(first, n, held, digest.hexdigest())], held.type)

    return dealt.mapInArrow(hashed, f"conv_id long, n long, seq {TURNS}, ends string")


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    first, n, seq, ends = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array([s.as_py() for s in seq], kind), pa.array(ends, pa.string())], names=["conv_id", "n", "seq", "ends"])


def _shared(low: Column, high: Column) -> Column:
    """How many leading turns two sequences share; those of a sorted bucket's ends are shared by all of it."""
    n = F.least(F.size(low), F.size(high))
    other = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(low, i)["id"] != F.get(high, i)["id"]))
    return F.get(other, F.lit(0)).cast("long")


class _Nodes:
    """The nodes of one bucket, parents before children."""

    def __init__(self):
        self.conv: list[int] = []
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.n: list[int] = []
        self.words: list[int] = []
        self.ends: list[str] = []

    def add(self, conv: int, depth: int, parent: int, n: int, words: int, ends: str) -> int:
        for column, value in zip((self.conv, self.depth, self.parent, self.n, self.words, self.ends), (conv, depth, parent, n, words, ends), strict=True):
            column.append(value)
        return len(self.conv) - 1


EMPTY = hashlib.sha256(b"").hexdigest()


def sort_bucket(rows: list[tuple[int, int, list[int], list[int], str]], base: int) -> _Nodes:
    """Multikey quicksort of distinct sequences (conv, n, ids, words, ends) that share their first base turns, base > 0.

    Rows are split by one turn into less, equal and greater; the equal ones are a node and go on with the next
    turn. A stack stands in for the recursion, as conversations may be very long.
    """
    out = _Nodes()

    def node(group: list[tuple], depth: int, parent: int) -> tuple[int, list[tuple]]:
        ended = next((r for r in group if len(r[2]) == depth), None)
        at = out.add(min(r[0] for r in group), depth, parent, sum(r[1] for r in group), group[0][3][depth - 1], ended[4] if ended else EMPTY)
        return at, [r for r in group if len(r[2]) > depth]

    top, rest = node(rows, base, -1)
    work = [(rest, base, top)]
    while work:
        group, depth, parent = work.pop()
        if len(group) > 1:
            pivot = group[len(group) // 2][2][depth]
            less = [r for r in group if r[2][depth] < pivot]
            more = [r for r in group if r[2][depth] > pivot]
            work += [(g, depth, parent) for g in (less, more) if g]
            at, rest = node([r for r in group if r[2][depth] == pivot], depth + 1, parent)
            if rest:
                work.append((rest, depth + 1, at))
        elif group:
            while group:
                depth += 1
                parent, group = node(group, depth, parent)
    return out


def _finished(out: _Nodes, outside: int) -> list[list]:
    """The nodes as rows of NODE, with sums over subtrees; outside: the parent of the first one."""
    size = len(out.conv)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for k in range(size - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        saved[k] += (out.n[k] - 1) * out.words[k]
        p = out.parent[k]
        if p >= 0:
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    parents = [out.conv[p] if p >= 0 else outside for p in out.parent]
    return [out.conv, out.depth, parents, out.n, children, leaves, saved, out.ends]


def _local_nodes(small: DataFrame) -> DataFrame:
    """NODE rows of all small buckets; sorted rows are read as a stream, of which one bucket is held."""
    dealt = small.repartition("parent", "base", "sym").sortWithinPartitions("parent", "base", "sym")
    rows = dealt.select("parent", "base", "sym", "conv_id", "n", F.col("seq.id").alias("ids"), F.col("seq.words").alias("words"), "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None
        for batch in batches:
            made: list[list] = [[] for _ in range(8)]
            for parent, base, sym, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (parent, base, sym) != bucket:
                    if held:
                        for column, values in zip(made, _finished(sort_bucket(held, bucket[1]), bucket[0]), strict=True):
                            column += values
                    held, bucket = [], (parent, base, sym)
                held.append(tuple(row))
            if made[0]:
                yield nodes(made)
        if held:
            yield nodes(_finished(sort_bucket(held, bucket[1]), bucket[0]))

    def nodes(made: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=[f.split(" ")[0] for f in NODE.split(", ")])

    return rows.mapInArrow(run, NODE)


def _large_nodes(large: DataFrame, kids: DataFrame) -> DataFrame:
    """NODE rows of large buckets: the turns that all of a bucket share, from its base to where its children part.

    large: (conv_id, n, parent, base, shared, path, ends), path being the turns before the children part. kids: sums over
    the children, by parent and depth of the parent.
    """
    joined = large.join(kids, (large["conv_id"] == kids["of"]) & (large["shared"] == kids["of_depth"]), "left")
    # from the last node up to the first, which may be the root without a turn
    step = F.struct(F.lit(0).cast("long").alias("saved"), F.array().cast("array<struct<depth:bigint,saved:bigint>>").alias("nodes"))

    def up(acc: Column, depth: Column) -> Column:
        words = F.when(depth > 0, F.get("path", (depth - 1).cast("int"))["words"]).otherwise(F.lit(0))
        saved = acc["saved"] + (F.col("n") - 1) * words
        return F.struct(saved.alias("saved"), F.array_append(acc["nodes"], F.struct(depth.alias("depth"), saved.alias("saved"))).alias("nodes"))

    depths = F.reverse(F.sequence(F.col("base"), F.col("shared")))
    told = joined.select("*", F.aggregate(depths, step, up)["nodes"].alias("nodes")).select("*", F.explode("nodes").alias("node"))
    last = F.col("node.depth") == F.col("shared")
    depth = F.col("node.depth")
    return told.select(
        "conv_id",
        depth.alias("depth"),
        F.when(depth == 0, F.lit(None)).when(depth == F.col("base"), F.col("parent")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("node.saved") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends"),
    )


def _tops(nodes: DataFrame) -> DataFrame:
    """Sums over children by parent and its depth."""
    sums = (F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    return nodes.groupBy(F.col("parent_conv_id").alias("of"), (F.col("depth") - 1).alias("of_depth")).agg(*sums)


def prefix_trie(seqs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie's nodes, as NODE has them, from distinct sequences (conv_id, n, seq, ends).

    A bucket is dealt out again while its sequences have more than local_turns turns together; each round is written
    to the checkpoint folder and deals out the large buckets only. Rounds follow the places where large buckets
    part, not the depth. No sequences give no nodes.
    """
    active = cut(seqs.select("conv_id", "n", "seq", "ends", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("sym")))
    key = ["parent", "base", "sym"]
    rounds: list[DataFrame] = []
    small: DataFrame | None = None
    while True:
        turns = F.sum(F.size("seq") - F.col("base")).alias("turns")
        bounds = (F.count("*").alias("rows"), F.min("conv_id").alias("least"), F.sum("n").alias("total"), F.min(F.struct("seq", "ends")).alias("low"), F.max("seq").alias("high"))
        if not rounds:
            # the root is a single bucket: one row of bounds, which becomes constants
            at = active.agg(F.count("*").alias("rows"), F.min("conv_id").alias("least"), F.sum("n").alias("total"), F.min(F.struct("seq", "ends")).alias("low"), F.max("seq").alias("high"))
            found = at.where("rows > 0").select(F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("sym"), "least", "total", "low", "high")
        else:
            sizes = active.groupBy(*key).agg(turns, F.count("*").alias("rows"))
            heavy = sizes.where((F.col("turns") > local_turns) & (F.col("rows") > 1)).select(*key)
            heavy = cut(heavy)
            part = active.join(heavy, key, "left_semi")
            found = part.groupBy(*key).agg(*bounds[1:])
        shared = _shared(F.col("low.seq"), F.col("high"))
        large = found.select(F.col("least").alias("conv_id"), F.col("total").alias("n"), *key, shared.alias("shared"), "low")
        path = F.slice("low.seq", F.lit(1), F.col("shared").cast("int"))
        large = cut(large.select("conv_id", "n", *key, "shared", path.alias("path"), F.when(F.size("low.seq") == F.col("shared"), F.col("low.ends")).alias("ends")))
        if not rounds:
            top = large.select("conv_id", "shared").first()
            if top is None:
                return active.sparkSession.createDataFrame([], NODE)
            rest = active.where(F.size("seq") > top["shared"]).select("conv_id", "n", "seq", "ends", F.lit(top["conv_id"]).cast("long").alias("parent"), F.lit(top["shared"]).cast("long").alias("depth"))
        else:
            if not large.head(1):
                small = active if small is None else small.unionByName(active)
                break
            alone = active.join(heavy, key, "left_anti")
            small = alone if small is None else small.unionByName(alone)
            dealt = large.select(*key, F.col("conv_id").alias("of"), F.col("shared").alias("depth"))
            rest = active.join(dealt, key).where(F.size("seq") > F.col("depth")).select("conv_id", "n", "seq", "ends", F.col("of").alias("parent"), "depth")
        rounds.append(large)
        active = cut(rest.select("conv_id", "n", "seq", "ends", "parent", (F.col("depth") + 1).alias("base"), F.get("seq", F.col("depth").cast("int"))["id"].alias("sym")))
    nodes = cut(_local_nodes(small))
    out = nodes
    firsts = nodes.join(small.select(F.col("parent").alias("parent_conv_id"), F.col("base").alias("depth")).distinct(), ["parent_conv_id", "depth"], "left_semi") if len(rounds) > 1 else nodes.where(F.col("depth") == top["shared"] + 1)
    for large in reversed(rounds):
        made = cut(_large_nodes(large, _tops(firsts)))
        out = out.unionByName(made)
        heads = made.join(large.select("conv_id", F.col("base").alias("depth")), ["conv_id", "depth"], "left_semi")
        firsts = firsts.unionByName(heads)
    return out
