"""Edits of annotated items: keyword assignment, stacks, cascades to bound items, names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as fx

# fixed values: most characters of a file's name, and tries for a free one
NAME_LENGTH, TRIES = 120, 1000
#: Over so many keys the rows whose key is null are dealt out.
SPREAD = 1 << 16


def assign_keywords(annotations: DataFrame, chosen: DataFrame, mode: str, keywords: str = "keywords", given: str = "given") -> DataFrame:
    """Annotations (item, keywords) after an edit of the chosen (item, given) rows, with a flag `changed`.

    mode: 'set' replaces, 'append' and 'on' add, 'off' removes. Sets are kept sorted and without blanks; a
    chosen item without annotation gets one, unless that changes nothing. Repeated chosen items count once.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")))
    asked = chosen.groupBy("item").agg(F.array_sort(F.flatten(F.collect_set(given))).alias("_given"))
    both = annotations.withColumn("_known", F.lit(True)).join(asked, "item", "full_outer")
    old, new = clean(F.col(keywords)), clean(F.col("_given"))
    after = {"set": new, "append": clean(F.concat(old, new)), "on": clean(F.concat(old, new)), "off": F.array_except(old, new)}[mode]
    changed = F.col("_given").isNotNull() & (after != old)
    out = both.withColumn("changed", changed).where("_known or changed")
    return out.withColumn(keywords, F.when(F.col("changed"), after).otherwise(F.coalesce(keywords, F.array().cast("array<string>")))).select("item", keywords, "changed")


def decayed_counters(uses: DataFrame, by: str, order: str, keyword: str, limit: int = 100) -> DataFrame:
    """E5: (by, keyword, counter) after all uses in order: at a total of the limit all counters are halved.

    Counters that reach zero go. A board's uses are read in order; fewer than limit counters are held.
    """
    from cuelake.streaming.rules import folded

    def step(state: dict, row: tuple) -> None:
        state[row[0]] = state.get(row[0], 0) + 1
        if sum(state.values()) >= limit:
            for k in list(state):
                state[k] //= 2
                if not state[k]:
                    del state[k]

    kinds = dict(uses.dtypes)
    return folded(uses, by, order, [keyword], dict, step, lambda state: sorted(state.items()), f"{keyword} {kinds[keyword]}, counter long")


def _numbered_members(stacks: DataFrame, order: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("board", "stack").orderBy(order)) - 1
    return stacks.withColumn("_at", at)


def _as_stacks(members: DataFrame, group: list[str], order: str) -> DataFrame:
    """Groups of two members at least, named by their first one."""
    held = members.groupBy(*group).agg(F.min_by("item", order).alias("stack"), F.count("*").alias("_n"), F.collect_list(F.struct(order, "item")).alias("_m")).where("_n > 1")
    return held.select("board", "stack", F.explode("_m").alias("_m")).select("board", "stack", f"_m.{order}", "_m.item")


def create_stack(stacks: DataFrame, items: DataFrame, chosen: DataFrame, order: str = "ord") -> DataFrame:
    """Stacks (board, stack, ord, item) after the chosen (board, item) of each board became one stack.

    Stacks that hold a chosen item are taken in whole; the new one has the order of items (board, ord, item) and
    is named by its first. A board with fewer than two such items stays as it is. Stacks don't share items.
    """
    asked = chosen.select("board", "item").distinct()
    touched = stacks.join(asked, ["board", "item"], "left_semi").select("board", "stack").distinct()
    inside = asked.unionByName(stacks.join(touched, ["board", "stack"], "left_semi").select("board", "item")).distinct()
    made = _as_stacks(items.select("board", order, "item").join(inside, ["board", "item"]), ["board"], order)
    gone = touched.join(made.select("board").distinct(), "board", "left_semi")
    return stacks.join(gone, ["board", "stack"], "left_anti").select("board", "stack", order, "item").unionByName(made.select("board", "stack", order, "item"))


def cancel_stacks(stacks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Without the stacks that hold a chosen (board, item)."""
    gone = stacks.join(chosen.select("board", "item").distinct(), ["board", "item"], "left_semi").select("board", "stack").distinct()
    return stacks.join(gone, ["board", "stack"], "left_anti")


def split_stacks(stacks: DataFrame, chosen: DataFrame, order: str = "ord", drop: bool = False) -> DataFrame:
    """Every stack is split before its chosen item (board, item; one a stack), which drop leaves out.

    Parts of fewer than two items are no stack; a stack split before its first item stays as it is.
    """
    rows = _numbered_members(stacks, order)
    cuts = rows.join(chosen.select("board", "item").distinct(), ["board", "item"], "left_semi").groupBy("board", "stack").agg(F.min("_at").alias("_cut"))
    both = rows.join(cuts, ["board", "stack"], "left")
    if drop:
        both = both.where("_cut is null or _at <> _cut")
    part = F.when(F.col("_at") >= F.col("_cut"), 1).otherwise(0)
    return _as_stacks(both.withColumn("_old", F.col("stack")).withColumn("_part", part), ["board", "_old", "_part"], order)


def visible_rows(rows: DataFrame, stacks: DataFrame, order: str = "ord", ends: tuple[str, ...] = ("end",)) -> DataFrame:
    """The rows (board, item, ...) that a board shows: of a collapsed stack its first item alone, with the ends of its
    last one; all others as they are.

    stacks: (board, stack, ord, item, expanded); null counts as collapsed. A last item without a row leaves the first
    one's ends, a first item without a row hides the stack. Stacks don't share items.
    """
    closed = stacks.where(~F.coalesce("expanded", F.lit(False)))
    edges = closed.groupBy("board", "stack").agg(F.min_by("item", order).alias("_first"), F.max_by("item", order).alias("_last"))
    members = closed.select("board", "item", F.col("stack").alias("_stack")).distinct()
    placed = rows.join(members, ["board", "item"], "left").join(edges.withColumnRenamed("stack", "_stack"), ["board", "_stack"], "left")
    shown = placed.where((F.col("_stack").isNull()) | (F.col("item") == F.col("_first")))
    wanted = edges.select("board", F.col("_last").alias("item")).distinct()
    last = rows.join(wanted, ["board", "item"], "left_semi").groupBy("board", F.col("item").alias("_last")).agg(F.first(F.struct(*ends)).alias("_ends"))
    out = shown.join(last, ["board", "_last"], "left")
    return out.select(*[F.when(F.col("_ends").isNotNull(), F.col(f"_ends.{c}")).otherwise(F.col(c)).alias(c) if c in ends else F.col(f"`{c}`") for c in rows.columns])


def visible_selection(selection: DataFrame, stacks: DataFrame, order: str = "ord") -> DataFrame:
    """The selected (board, item), members of a collapsed stack stood for by its first item; each once."""
    closed = stacks.where(~F.coalesce("expanded", F.lit(False)))
    edges = closed.groupBy("board", "stack").agg(F.min_by("item", order).alias("_first"))
    stands = closed.join(edges, ["board", "stack"]).select("board", "item", "_first").distinct()
    return selection.join(stands, ["board", "item"], "left").select("board", F.coalesce("_first", "item").alias("item")).distinct()


def selected_members(selection: DataFrame, stacks: DataFrame) -> DataFrame:
    """The (board, item) that an edit of the selection reaches: a member of a collapsed stack stands for all of them."""
    closed = stacks.where(~F.coalesce("expanded", F.lit(False))).select("board", "stack", "item").distinct()
    hit = closed.join(selection, ["board", "item"], "left_semi").select("board", "stack").distinct()
    return selection.select("board", "item").unionByName(closed.join(hit, ["board", "stack"], "left_semi").select("board", "item")).distinct()


def set_enabled(items: DataFrame, chosen: DataFrame, enabled: bool) -> DataFrame:
    """Items (id, kind, bound_to, enabled) after the chosen ids were switched, with a flag `changed`.

    Switching a video off takes the items bound to it along; switching on does not.
    """
    asked = chosen.select("id").distinct()
    wanted = asked.withColumn("_asked", F.lit(True))
    out = items.join(wanted, "id", "left")
    if not enabled:
        videos = items.where("kind = 'video'").select("id").join(asked, "id", "left_semi").select(F.col("id").alias("bound_to"), F.lit(True).alias("_follows"), F.pmod(F.hash("id"), F.lit(1)).alias("_spread")).distinct()
        # items bound to nothing match nothing, but by a null key alone they would all fall to one task; the videos' 0 is no
        # literal, as the optimiser would take it out of the key
        spread = F.when(F.col("bound_to").isNull(), F.pmod(F.hash("id"), F.lit(SPREAD)) + 1).otherwise(0)
        out = out.withColumn("_spread", spread).join(videos, ["bound_to", "_spread"], "left")
    else:
        out = out.withColumn("_follows", F.lit(None).cast("boolean"))
    hit = F.coalesce(F.col("_asked") | F.col("_follows"), F.col("_asked"), F.col("_follows"), F.lit(False))
    changed = hit & (F.coalesce("enabled", F.lit(True)) != F.lit(enabled))
    return out.select("id", "kind", "bound_to", F.when(hit, F.lit(enabled)).otherwise(F.col("enabled")).alias("enabled"), changed.alias("changed"))


def unique_names(rows: DataFrame, by: list[str], order: str, name: str, start: int) -> DataFrame:
    """repeats of a name within by, whatever its case, get -start, -(start + 1), ...; the first stays."""
    k = F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(order)) - 1
    return rows.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 0, F.concat(F.col(name), F.lit("-"), (F.col("_k") + (start - 1)).cast("string"))).otherwise(F.col(name))).drop("_k")


def export_names(clips: DataFrame, by: list[str], order: str, base: Column, extension: Column, upper: Column, start: int = 1, name: str = "file_name") -> DataFrame:
    """Clips with the names of their files: cleaned base, told apart within by, clamped, with its extension."""
    dotted = F.concat(F.lit("."), F.when(upper, F.upper(extension)).otherwise(F.lower(extension)))
    most = F.lit(NAME_LENGTH) - F.length("_ext")
    rows = clips.withColumn("_ext", dotted).withColumn(name, fx.clamp_base_name(fx.file_name_component(base), most))
    told = unique_names(rows, by, order, name, max(0, start))
    return told.withColumn(name, F.concat(fx.clamp_base_name(F.col(name), most), F.col("_ext"))).drop("_ext")


def next_free_names(asked: DataFrame, taken: DataFrame, name: str = "name", start: int = 1) -> DataFrame:
    """Asked with free: the first `stem-N.ext`, N from start on, that is not a name in taken, or null.

    Taken names are cut into stem and number first, so that each asked stem meets its own numbers only; of
    those at most TRIES matter.
    """
    dot = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    parts = asked.withColumn("_ext", dot).withColumn("_stem", fx.effective_output_name(F.substring(F.col(name), F.lit(1), F.length(name) - F.length(dot))))
    tail = r"(?s)^(.*)-(0|[1-9][0-9]{0,8})(\.[^.]*)?$"
    cut = taken.select(F.regexp_extract(name, tail, 1).alias("_stem"), F.regexp_extract(name, tail, 2).cast("int").alias("_n"), F.regexp_extract(name, tail, 3).alias("_ext"))
    used = cut.where(F.col("_n").between(start, start + TRIES - 1)).groupBy("_stem", "_ext").agg(F.collect_set("_n").alias("_used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(start), F.lit(start + TRIES - 1)), F.coalesce("_used", F.array().cast("array<int>"))))
    out = parts.join(used, ["_stem", "_ext"], "left").withColumn("_free", free)
    return out.select(*asked.columns, F.when(F.col("_free").isNotNull(), F.concat("_stem", F.lit("-"), F.col("_free").cast("string"), "_ext")).alias("free"))


def repaired_settings(settings: DataFrame) -> DataFrame:
    """Container, include_video, include_audio and audio_codec with defaults for nulls and no impossible mix."""
    audio_only = F.col("container").isin("mp3_audio", "aac_audio")
    video = F.when(audio_only, False).otherwise(F.coalesce("include_video", F.lit(True)))
    audio = F.when(audio_only, True).otherwise(F.coalesce("include_audio", F.lit(True)))
    codec = F.when(F.col("container") == "mp3_audio", "mp3").when(F.col("container") == "aac_audio", "aac").otherwise(F.col("audio_codec"))
    defaults = {"destination": "specified", "use_subfolder": False, "subfolder_name": "", "rename_rule": "filename", "custom_name": "", "start_number": 1, "extension_case": "lower", "existing_file_mode": "ask", "hardware_acceleration": "auto"}
    fixed = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in settings.columns}
    return settings.withColumns({**fixed, "include_video": video | ~audio, "include_audio": audio, "audio_codec": codec})


def sorted_siblings(nodes: DataFrame, value: str, ascending: bool = True, order: str = "ord") -> DataFrame:
    """(id, parent, place): siblings from 0 on; nodes without a value come first, folders among them by name.

    nodes: (id, parent, ord, name, is_folder, value). Ties keep their order.
    """
    column = F.col(value)
    key = [column.isNotNull(), column.asc() if ascending else column.desc(), F.when(column.isNull() & F.col("is_folder"), fx.natural_key(F.col("name"))), order]
    return nodes.select("id", "parent", (F.row_number().over(Window.partitionBy("parent").orderBy(*key)) - 1).cast("long").alias("place"))
