"""Edits of ordered lists, and histories with undo, redo branches and merging, replayed in order.

A document's edits are read as a sorted stream in one task, of which the document's list, or the few entries of its history, is held;
documents are independent of one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.streaming.rules import folded

#: Items in a block of a list.
BLOCK = 512


class Positions:
    """A list whose items are found by name and by place: blocks of items, and the block of each item."""

    def __init__(self):
        self.blocks: list[list] = [[]]
        self.where: dict[Any, list] = {}
        self.values: dict[Any, Any] = {}

    def __len__(self) -> int:
        return len(self.where)

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        return ((item, self.values[item]) for block in self.blocks for item in block)

    def remove(self, item: Any) -> None:
        block = self.where.pop(item, None)
        if block is not None:
            block.remove(item)
            del self.values[item]
            if not block and len(self.blocks) > 1:
                self.blocks = [b for b in self.blocks if b is not block]

    def insert(self, at: int, item: Any, value: Any) -> None:
        """Before the item that stands there, or at the end."""
        for k, block in enumerate(self.blocks):
            if at <= len(block) or k + 1 == len(self.blocks):
                block.insert(at, item)
                self.where[item], self.values[item] = block, value
                if len(block) > BLOCK:
                    rest = block[BLOCK // 2 :]
                    del block[BLOCK // 2 :]
                    self.blocks.insert(k + 1, rest)
                    for moved in rest:
                        self.where[moved] = rest
                return
            at -= len(block)

    def event(self, edits: list[tuple[int, Any, Any]]) -> None:
        """(index, item, value or None): all items named go, then those with a value come in by ascending index."""
        for _, item, _ in edits:
            self.remove(item)
        for index, item, value in sorted(edits, key=lambda e: e[0]):
            if value is not None:
                self.remove(item)
                self.insert(max(index, 0), item, value)


class _Replay:
    def __init__(self):
        self.list, self.pending, self.seq = Positions(), [], None

    def step(self, row: tuple) -> None:
        first, seq, index, item, value = row
        if first:
            if item not in self.list.where:
                self.list.insert(len(self.list), item, value)
            return
        if seq != self.seq:
            self.flush()
            self.seq = seq
        self.pending.append((index, item, value))

    def flush(self) -> None:
        self.list.event(self.pending)
        self.pending = []

    def rows(self) -> list[tuple]:
        self.flush()
        return [(n, item, value) for n, (item, value) in enumerate(self.list)]


def replay_positions(items: DataFrame, log: DataFrame, doc: str, item: str, value: str, pos: str, seq: str, index: str) -> DataFrame:
    """(doc, pos, item, value): each document's list after its log, one event after the other.

    items: (doc, item, value, pos), the lists before; log: (doc, seq, item, value, index), where the rows of one seq are one event.
    An event takes all its items out of the list; those with a value then come in by ascending index (ties by item), at
    the index or at the end of a shorter list. Null items are ignored, null and negative indices are 0, null values remove; of an
    item named again in an event the last counts, of one that a list holds twice the first. Null documents are one
    document, events without a seq come first. Documents may be in either table only.
    """
    kinds = dict(log.dtypes)
    place = F.greatest(F.coalesce(F.col(index), F.lit(0)), F.lit(0)).cast("long")

    def rows(df: DataFrame, first: bool, number: F.Column, at: F.Column) -> DataFrame:
        order = F.struct(F.lit(0 if first else 1).alias("stage"), number.alias("seq"), at.alias("index"))
        return df.where(F.col(item).isNotNull()).select(doc, order.alias("_order"), F.lit(first).alias("_first"), number.alias("_seq"), at.alias("_index"), item, value)

    both = rows(items, True, F.lit(None).cast(kinds[seq]), F.coalesce(F.col(pos), F.lit(0)).cast("long")).unionByName(rows(log, False, F.col(seq), place))
    out = f"`{pos}` long, `{item}` {kinds[item]}, `{value}` {kinds[value]}"
    return folded(both, doc, "_order", ["_first", "_seq", "_index", item, value], _Replay, _Replay.step, _Replay.rows, out)


def positional_diff(before: DataFrame, after: DataFrame, doc: str, item: str, value: str, pos: str) -> DataFrame:
    """P5: (doc, item, old, new, old_index, new_index): items that came, went, changed or stand elsewhere.

    A missing side is null; its index is then the other side's, as the edit that brings it back has to name a place.
    """
    a = before.select(doc, item, F.col(value).alias("old"), F.col(pos).cast("long").alias("_old"))
    b = after.select(doc, item, F.col(value).alias("new"), F.col(pos).cast("long").alias("_new"))
    both = a.join(b, [doc, item], "full_outer")
    changed = both.where(~(F.col("old").eqNullSafe(F.col("new")) & F.col("_old").eqNullSafe(F.col("_new"))))
    return changed.select(doc, item, "old", "new", F.coalesce("_old", "_new").alias("old_index"), F.coalesce("_new", "_old").alias("new_index"))


def apply_positions(state: DataFrame, changes: DataFrame, doc: str, item: str, value: str, pos: str, back: bool = False) -> DataFrame:
    """The lists after the changes of positional_diff as one event (or before them)."""
    side = "old" if back else "new"
    log = changes.select(doc, F.lit(0).cast("long").alias("_event"), item, F.col(side).alias(value), F.col(f"{side}_index").alias("_place"))
    return replay_positions(state, log, doc, item, value, pos, "_event", "_place")


class _History:
    """Entries [first, last, label, group], cursor and saved cursor; most entries and a base label are kept."""

    def __init__(self, most: int):
        self.most, self.entries, self.base, self.cursor, self.saved, self.active = most, [], None, 0, 0, False

    def step(self, row: tuple) -> None:
        kind, entry, group, label, target = row
        if kind == "append":
            self.append(entry, group, label)
        elif self.active and kind == "jump":
            self.cursor = max(0, min(target or 0, len(self.entries)))
        elif self.active and kind == "save":
            self.saved = self.cursor

    def append(self, entry: Any, group: Any, label: str | None) -> None:
        self.active = True
        if self.saved > self.cursor:
            self.saved = -1
        tip = self.entries[self.cursor - 1] if self.cursor else None
        merges = bool(group) and tip is not None and tip[3] == group and self.cursor == len(self.entries)
        del self.entries[self.cursor - merges :]
        self.entries.append([tip[0] if merges else entry, entry, label, group])
        while len(self.entries) > self.most:
            self.base = self.entries.pop(0)[2]
            self.saved = self.saved - 1 if self.saved > 0 else -1
        self.cursor = len(self.entries)

    def rows(self) -> list[tuple]:
        told = [[None, None, self.base, None], *self.entries] if self.active else []
        return [(n, *e, n == self.cursor, n > self.cursor, n == self.saved) for n, e in enumerate(told)]


def edit_histories(log: DataFrame, doc: str, order: str, kind: str, entry: str, group: str, label: str, target: str, most: int = 39) -> DataFrame:
    """(doc, place, first, last, label, group, current, future, saved): each document's history after its log.

    kind: 'append' puts an entry after the cursor and cuts what stood there to be redone; an entry of the same group as a
    tip at the end of the history joins it (first: whose inverse undoes it, last: the newest, whose label it takes). 'jump'
    moves the cursor to target within the history, 'save' marks the cursor; both do nothing before a first append. Beyond
    `most` entries the oldest goes and leaves its label to place 0, the base. saved marks no row when the saved state
    was cut away. Other kinds are ignored, null or empty groups never merge, null targets are 0; equal places in the
    order are taken by the columns' values.
    """
    kinds = dict(log.dtypes)
    out = f"place long, first {kinds[entry]}, last {kinds[entry]}, label {kinds[label]}, `group` {kinds[group]}, current boolean, future boolean, saved boolean"
    return folded(log, doc, order, [kind, entry, group, label, target], lambda: _History(most), _History.step, _History.rows, out)
