"""Chat formatting with Spark expressions only: turns sorted and merged in arrays, a loss mask, and reading back.

A formatted conversation is a string of blocks, one for each stretch of adjacent turns of one role:

    ### role:
    text<next>text</turn>

Control strings inside texts and roles get a backslash after their first character and backslashes are doubled,
so no text can open or close a turn and every text can be read back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fresh

HEAD, AFTER_ROLE, NEXT, MARK, END = "### ", ":\n", "<next>", "</turn>", "</turn>\n"
#: What may not stand inside a text; a role may not hold AFTER_ROLE either.
CONTROLS = (HEAD, NEXT, MARK)
#: Elements that one step of a running sum takes; longer arrays are summed group by group.
GROUP = 256


def escape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """text with doubled backslashes and a single one within each control string.

    A single backslash never stands in the doubled text otherwise, hence unescape finds the same places again.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """What escape was given."""
    for c in controls:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def in_groups(array: Column, size: int = GROUP) -> Column:
    """The array cut into arrays of so many elements; one empty array if it has none."""
    last = F.greatest(F.floor((F.size(array) - 1) / size).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(array, g * size + 1, F.lit(size)))


def _appended(array: Column, length: Callable[[Column], Column], value: Callable[[Column, Column], Column], kind: str) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(array, start, lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.array_append(acc["out"], value(acc["at"], x)).alias("out")))


def running_sums(lengths: Column) -> Column:
    """For each element the sum of those before it; in groups, as appending to an array copies it."""
    within = F.transform(in_groups(lengths), lambda g: _appended(g, lambda x: x, lambda at, x: at, "bigint"))
    return F.flatten(_appended(within, lambda g: g["at"], lambda at, g: F.transform(g["out"], lambda o: o + at), "array<bigint>")["out"])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_col, formatted, loss_spans): one row for each conversation.

    loss_spans holds (start, length), in characters from 0, of every text whose role is trained; markers and headers
    are never under the mask. Turns stand by order_col, nulls first, ties by role, then text; repeated rows are turns
    of their own. Null roles and texts are empty, and rows without a conversation id make a conversation of their own. No rows
    give no conversations; other columns are ignored. A conversation is a row of the result, so all of its turns
    meet in one task, as in every format that holds a conversation in a string.
    """
    empty = F.lit("")
    row = F.struct(F.col(f"`{order_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), empty).alias("role"), F.coalesce(F.col(f"`{text_col}`"), empty).alias("text"))
    (conv,) = fresh(turns.select(), "conv")
    sorted_turns = turns.select(F.col(f"`{conv_col}`").alias(conv), row.alias("t")).groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # where a block of one role begins
    begins = F.filter(
        F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)),
        lambda i: i.isNotNull(),
    )
    begun = sorted_turns.select(conv, "turns", begins.alias("begins"))

    def block(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("begins", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", first + 1, after - first), lambda t: t["text"])
        return F.struct(F.get("turns", first)["role"].alias("role"), texts.alias("texts"))

    merged = begun.select(conv, F.transform("begins", block).alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        no, loss = F.lit(False), b["role"].isin(*trained)
        header = piece(F.concat(F.lit(HEAD), escape(b["role"], (*CONTROLS, AFTER_ROLE)), F.lit(AFTER_ROLE)), no)
        texts = F.transform(b["texts"], lambda x, j: F.when(j == 0, F.array(piece(escape(x), loss))).otherwise(F.array(piece(F.lit(NEXT), no), piece(escape(x), loss))))
        return F.concat(F.array(header), F.flatten(texts), F.array(piece(F.lit(END), no)))

    cut = merged.select(conv, F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    sized = cut.select(conv, "pieces", F.transform("pieces", lambda p: F.char_length(p["text"]).cast("long")).alias("sizes"))
    placed = sized.select(conv, "pieces", "sizes", running_sums(F.col("sizes")).alias("starts"))
    # zipped outside of the lambda, which would otherwise sum the sizes again for each piece
    zipped = F.filter(F.arrays_zip("pieces", "starts", "sizes"), lambda z: z["pieces"]["loss"])
    spans = F.transform(zipped, lambda z: F.struct(z["starts"].alias("start"), z["sizes"].alias("length")))
    return placed.select(
        F.col(conv).alias(conv_col),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation again: array of (role, text), in order."""
    blocks = F.split(formatted, END)

    def turns(b: Column) -> Column:
        at = F.locate(AFTER_ROLE, b)
        role = unescape(F.substr(b, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), (*CONTROLS, AFTER_ROLE))
        texts = F.split(F.substr(b, at + len(AFTER_ROLE)), NEXT)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, without its escapes; nothing stands between two texts.

    A span is cut out of the stretch that its group of spans covers, so a long string isn't scanned for each span.
    """

    def stretch(g: Column) -> Column:
        first, last = F.get(g, F.lit(0)), F.element_at(g, -1)
        return F.struct(g.alias("spans"), first["start"].alias("at"), F.substr(formatted, first["start"].cast("int") + 1, (last["start"] + last["length"] - first["start"]).cast("int")).alias("text"))

    def texts(p: Column) -> Column:
        return F.array_join(F.transform(p["spans"], lambda s: unescape(F.substr(p["text"], (s["start"] - p["at"]).cast("int") + 1, s["length"].cast("int")))), "")

    return F.array_join(F.transform(F.transform(in_groups(spans), stretch), texts), "")
