"""Annotations of items: ratings, flags, colours, labels and titles, and the keywords with what is known of their use.

annotations: (item, rating, retained, excluded, colour, label, title, ...), one row an item; an item without a row has no
annotation. boards: (board, recents, counters), the keywords last used and a map of how often each was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cuelake.functions.mathx import half_up, rating
from cuelake.operators.edits import assign_keywords
from cuelake.operators.trees import reached

#: From this total on a board's counters are halved.
DECAY = 100
FIELDS = ("rating", "rating_by", "flag", "colour", "label", "title")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def _rule(field: str, told: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a told value differs from what is there, and the columns that it sets."""
    old = F.coalesce("rating", F.lit(0))
    flag = F.when(F.coalesce("retained", F.lit(False)), "retained").when(F.coalesce("excluded", F.lit(False)), "excluded").otherwise("none")
    none = F.lit(None).cast("string")
    if field == "rating":
        return old != rating(told), {"rating": rating(told)}
    if field == "rating_by":
        finite = told.isNotNull() & ~F.isnan(told) & (F.abs(told) != float("inf"))
        step = F.when(finite, F.greatest(F.least(told, F.lit(6.0)), F.lit(-6.0))).otherwise(F.lit(0.0))
        new = F.least(F.greatest(old + half_up(step), F.lit(0)), F.lit(5)).cast("int")
        return (half_up(step) != 0) & (new != old), {"rating": new}
    if field == "flag":
        wanted = F.coalesce(told, F.lit("none"))
        return flag != wanted, {"retained": wanted == "retained", "excluded": wanted == "excluded"}
    if field == "colour":
        return ~F.col("colour").eqNullSafe(told) | (_trimmed(F.col("label")) != ""), {"colour": told, "label": none}
    if field == "label":
        return (F.coalesce("label", F.lit("")) != _trimmed(told)) | F.col("colour").isNotNull(), {"label": F.nullif(_trimmed(told), F.lit("")), "colour": none}
    if field == "title":
        return F.coalesce("title", F.lit("")) != F.coalesce(told, F.lit("")), {"title": F.coalesce(told, F.lit(""))}
    raise ValueError(f"{field} is none of {FIELDS}")


def annotate(annotations: DataFrame, asked: DataFrame, field: str) -> DataFrame:
    """Annotations after asked (item, value) set a field, with a flag `changed`.

    rating: rounded, within 0..5; rating_by: adds to it; flag: retained, excluded or none; colour and label (trimmed)
    exclude one another: each clears the other; title. Null takes colour, label and flag away. An item without annotation
    gets one, with rating 0 and no flags, unless nothing changes. Of several values for an item the greatest counts.
    """
    one = asked.where("item is not null").groupBy("item").agg(F.max("value").alias("_value"), F.lit(True).alias("_asked"))
    both = annotations.withColumn("_known", F.lit(True)).join(one, "item", "full_outer")
    differs, new = _rule(field, F.col("_value"))
    marked = both.select("*", (F.coalesce("_asked", F.lit(False)) & differs).alias("changed"), *[v.alias(f"_new_{c}") for c, v in new.items()]).where("_known or changed")
    defaults = {"rating": F.lit(0), "retained": F.lit(False), "excluded": F.lit(False)}
    out = []
    for c, kind in annotations.dtypes:
        value = F.coalesce(F.col(c), F.when(F.col("changed"), defaults[c])) if c in defaults else F.col(f"`{c}`")
        out.append((F.when(F.col("changed"), F.col(f"_new_{c}")).otherwise(value) if c in new else value).cast(kind).alias(c))
    return marked.select(*out, "changed")


def used_recents(recents: Column, used: Column) -> Column:
    """Recents with the used keywords in front, the last used first; each once."""
    last_first = F.array_distinct(F.reverse(used))
    return F.concat(last_first, F.array_except(F.coalesce(recents, F.array().cast("array<string>")), last_first))


def used_counters(counters: Column, used: Column, limit: int = DECAY) -> Column:
    """Counters (a map) after one use of each used keyword, all halved once their total reaches the limit."""
    once = F.array_distinct(F.filter(used, lambda k: F.trim(k) != ""))
    ones = F.map_from_arrays(once, F.transform(once, lambda k: F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    empty = F.create_map().cast("map<string,bigint>")
    added = F.map_zip_with(F.coalesce(counters, empty), ones, lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))
    total = F.aggregate(F.map_values(added), zero, lambda n, x: n + x)
    halved = F.map_filter(F.transform_values(added, lambda k, n: F.floor(n / 2)), lambda k, n: n > 0)
    return F.when((F.size(once) > 0) & (total >= limit), halved).otherwise(added)


def assign(boards: DataFrame, annotations: DataFrame, chosen: DataFrame, given: DataFrame, mode: str, limit: int = DECAY) -> tuple[DataFrame, DataFrame]:
    """(boards, annotations) after the keywords of given (board, used) went to the chosen (board, item) of each board.

    annotations: (item, keywords); modes and the flag `changed` are those of edits.assign_keywords. A board on which an
    annotation changed remembers the keywords as used, except for 'off'. Null counts as no keyword; a board that
    boards doesn't know stays unknown; given has one row a board.
    """
    words = given.select("board", F.filter(F.coalesce("used", F.array().cast("array<string>")), lambda k: k.isNotNull()).alias("used"))
    asked = chosen.select("board", "item").distinct().join(words, "board")
    done = assign_keywords(annotations, asked, mode, given="used")
    if mode == "off":
        return boards, done
    hit = asked.join(done.where("changed").select("item"), "item", "left_semi").select("board").distinct()
    now = boards.join(words.join(hit, "board", "left_semi"), "board", "left")
    new = {"recents": used_recents(F.col("recents"), F.col("used")), "counters": used_counters(F.col("counters"), F.col("used"), limit)}
    return now.select(*[F.when(F.col("used").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in boards.columns]), done


def _held_gone(rows: DataFrame, key: str, held: Column, gone: DataFrame) -> DataFrame:
    """rows with _gone: which of the held keywords are gone, null if none. Only rows that hold one are grouped."""
    each = rows.select(key, F.explode(held).alias("id")).join(gone, "id", "left_semi")
    return rows.join(each.groupBy(key).agg(F.collect_set("id").alias("_gone")), key, "left")


def gone_keywords(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """(id): the removed (id) nodes and all below them in nodes (id, parent, ...); an id that is no node removes nothing."""
    return reached(nodes.select("id", "parent"), removed.select("id").join(nodes.select("id"), "id", "left_semi").distinct())


def mark_uses(uses: DataFrame, gone: DataFrame) -> DataFrame:
    """Uses (board, keyword, ...) with a flag `gone`: whether the keyword is one of gone (id).

    Boards as rows, the form for boards with very many keywords: one is dealt out over many tasks and no array of it is made.
    """
    ids = gone.select(F.col("id").alias("keyword"), F.lit(True).alias("gone")).distinct()
    return uses.drop("gone").join(ids, "keyword", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))


@F.udf(ArrayType(IntegerType()), useArrow=True)
def _places_left(names: list[str] | None, gone: list[str] | None) -> list[int]:
    """The places of the names that are not gone; nulls go too. By hash, as array_contains would compare all with all."""
    away = {None, *(gone if gone is not None else ())}
    return [k for k, name in enumerate(names if names is not None else ()) if name not in away]


def delete_keywords(nodes: DataFrame, removed: DataFrame, boards: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, boards, annotations) without the removed (id) keywords and all below them in nodes (id, parent, ...).

    They leave recents, counters and the keywords of annotations (item, keywords, ...), each with a flag `changed`. An id
    that is no node removes nothing. A board is one row here; mark_uses takes boards of any size.
    """
    gone = gone_keywords(nodes, removed)
    left = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    hit = F.col("_gone").isNotNull()
    rows = _held_gone(annotations, "item", F.col("keywords"), gone).withColumn("changed", hit)
    kept = F.when(hit, F.array_except("keywords", "_gone")).otherwise(F.col("keywords"))
    rows = rows.select(*[kept.alias(c) if c == "keywords" else F.col(f"`{c}`") for c in annotations.columns], "changed")
    names = F.array_distinct(F.concat(F.coalesce("recents", F.array().cast("array<string>")), F.coalesce(F.map_keys("counters"), F.array().cast("array<string>"))))
    out = _held_gone(boards, "board", names, gone).withColumn("changed", hit)
    keys, counts = F.map_keys("counters"), F.map_values("counters")
    out = out.withColumns({"_recent": _places_left("recents", "_gone"), "_counted": _places_left(keys, "_gone")})
    taken = lambda values, places: F.transform(places, lambda k: values[k])
    new = {
        "recents": F.when(F.col("recents").isNotNull(), taken(F.col("recents"), "_recent")),
        "counters": F.when(F.col("counters").isNotNull(), F.map_from_arrays(taken(keys, "_counted"), taken(counts, "_counted"))),
    }
    out = out.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in boards.columns], "changed")
    return left, out, rows
