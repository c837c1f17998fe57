"""Row filters, annotation columns and rule tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import blank_to_null

_WORD = r"[\p{L}\p{N}_]"


def with_annotation_columns(rows: DataFrame) -> DataFrame:
    """Flag, edited, label and visual from rating, retained, excluded, color and custom; nulls are defaults."""
    kept, out = F.coalesce("retained", F.lit(False)), F.coalesce("excluded", F.lit(False))
    custom, color = blank_to_null(F.col("custom")), blank_to_null(F.col("color"))
    edited = (F.coalesce("rating", F.lit(0)) > 0) | kept | out | custom.isNotNull() | color.isNotNull()
    return rows.withColumns({
        "flag": F.when(kept, "retained").when(out, "excluded").otherwise("none"),
        "edited": edited,
        "label": F.coalesce(custom, color, F.lit("")),
        "visual": F.when(custom.isNotNull(), "custom").otherwise(F.coalesce(color, F.lit("none"))),
    })


def matches_all(hay: Column, text: str) -> Column:
    """Every blank-separated part of text is in hay, whatever the case; a blank text fits all."""
    out = F.lit(True)
    for token in text.lower().split():
        out = out & F.contains(F.lower(hay), F.lit(token))
    return out


def attributes(rating: tuple[str, int] | None = None, flags: Sequence[str] = (), edited: Sequence[bool] = (), colors: Sequence[str] = ()) -> Column:
    """All of the given constraints; an empty one, or a rating of 0, is none."""
    out = F.lit(True)
    if rating and rating[1]:
        r, n = F.coalesce("rating", F.lit(0)), rating[1]
        out = out & {"gte": r >= n, "lte": r <= n, "eq": r == n}[rating[0]]
    for name, values in (("flag", flags), ("edited", edited), ("visual", colors)):
        if values:
            out = out & F.col(name).isin(list(values))
    return out


def terms_of(text: str) -> list[str]:
    plain = text.strip().lower()
    return re.findall(r"\w+", plain) or ([plain] if plain else [])


def text_rule(values: Column, rule: str, text: str) -> Column:
    """A rule over the non-blank values of a row. A blank text fits all but the rules for emptiness.

    contains: any term in the joined values; containsAll: all terms; containsWords: all as whole words;
    doesNotContain: none; startsWith, endsWith: any value does, with the whole text; isEmpty, isNotEmpty.
    """
    if rule == "isEmpty":
        return F.size(values) == 0
    if rule == "isNotEmpty":
        return F.size(values) > 0
    terms, whole = terms_of(text), text.strip().lower()
    if not terms:
        return F.lit(True)
    joined = F.lower(F.array_join(values, " "))
    if rule in ("startsWith", "endsWith"):
        test = F.startswith if rule == "startsWith" else F.endswith
        return F.exists(values, lambda v: test(F.lower(v), F.lit(whole)))
    if rule == "containsWords":
        found = [F.regexp_like(joined, F.lit(f"(?:^|(?!{_WORD}).){re.escape(t)}(?:$|(?!{_WORD}).)")) for t in terms]
    else:
        found = [F.contains(joined, F.lit(t)) for t in terms]
    out = found[0]
    for x in found[1:]:
        out = out | x if rule in ("contains", "doesNotContain") else out & x
    if rule == "doesNotContain":
        return ~out
    if rule not in ("contains", "containsAll", "containsWords"):
        raise ValueError(f"unknown rule {rule!r}")
    return out


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, or an empty text."""
    out = F.lit("")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row for every rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))


# fixed values: audio codecs of each container
CODECS = {"webm_vp9": ["opus"], "mp3_audio": ["mp3"], "aac_audio": ["aac"], "mp4_h264": ["aac", "mp2", "mp3"], "mp4_hevc": ["aac", "mp2", "mp3"], "mov_prores": ["aac", "mp2", "mp3"]}


def export_rules() -> dict[str, Column]:
    """What must not hold of export options; include_video and include_audio are not null."""
    video, audio = F.col("include_video"), F.col("include_audio")
    allowed = F.lit(False)
    for container, codecs in CODECS.items():
        allowed = allowed | ((F.col("container") == container) & F.coalesce(F.col("audio_codec").isin(codecs), F.lit(False)))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return {
        "directory": blank("output_dir"),
        "stem": blank("output_stem"),
        "streams": ~video & ~audio,
        "container": F.col("container").isin("mp3_audio", "aac_audio") & video,
        "dimensions": video & (F.col("resolution") == "custom") & ((F.col("custom_width") < 2) | (F.col("custom_height") < 2)),
        "frame rate": video & (F.isnan("frame_rate") | ~F.col("frame_rate").between(1, 120)),
        "codec": audio & ~allowed,
        "sample rate": ~F.col("sample_rate").between(8000, 192000),
    }


def output_fault(expected_us: Column, tolerance: int = 200_000) -> Column:
    """C27: 'streams' for a stream too many or too few, 'no duration', 'duration' if it is off by more, or empty."""
    off = F.abs(F.col("duration_us") - F.greatest(expected_us, F.lit(0)))
    rules = [("streams", (F.col("has_video") != F.col("want_video")) | (F.col("has_audio") != F.col("want_audio"))), ("no duration", F.col("duration_us") <= 0), ("duration", off > tolerance)]
    return first_reason(rules)


# fixed values: quality codes, profiles and speed arguments of the encoders
CRF = {"mp4_h264": (28, 23, 20, 17), "mp4_hevc": (28, 23, 20, 17), "webm_vp9": (40, 34, 28, 24)}
PROFILE = (0, 2, 3, 3)
SPEED = {
    "mp4": ("-preset veryfast", "-preset medium", "-preset slow"),
    "webm": ("-deadline good -cpu-used 8", "-deadline good -cpu-used 4", "-deadline best -cpu-used 2"),
}
QUALITIES, SPEEDS = ("low", "medium", "high", "very_high"), ("fast", "balanced", "quality")


def encoder_codes(rows: DataFrame) -> DataFrame:
    """Rows (container, quality, speed) with crf (0 where a container has none), profile and speed_args."""
    spark = rows.sparkSession
    quality = [(c, q, codes[n]) for c, codes in CRF.items() for n, q in enumerate(QUALITIES)]
    profile = [("mov_prores", q, PROFILE[n]) for n, q in enumerate(QUALITIES)]
    speed = [(c, s, args[n]) for c, args in SPEED.items() for n, s in enumerate(SPEEDS)]
    out = rows.withColumn("_family", F.substring_index("container", "_", 1))
    # a dozen rows each
    out = out.join(F.broadcast(spark.createDataFrame(quality, "container string, quality string, crf int")), ["container", "quality"], "left")
    out = out.join(F.broadcast(spark.createDataFrame(profile, "container string, quality string, profile int")), ["container", "quality"], "left")
    out = out.join(F.broadcast(spark.createDataFrame(speed, "_family string, speed string, speed_args string")), ["_family", "speed"], "left")
    return out.drop("_family").na.fill(0, ["crf"]).na.fill("", ["speed_args"])


def with_item_state(rows: DataFrame) -> DataFrame:
    """Usable, shown, offline and virtual of items (enabled, hidden, path_exists, kind, bound_to); nulls are defaults.

    Items are enabled and shown unless told otherwise; an item without its file is offline, unless it has none of
    its own because it is a stream of another; only enabled items that are not offline are usable.
    """
    virtual = F.col("bound_to").isNotNull() & (F.col("kind") != "video")
    offline = ~virtual & ~F.coalesce("path_exists", F.lit(True))
    enabled, hidden = F.coalesce("enabled", F.lit(True)), F.coalesce("hidden", F.lit(False))
    return rows.withColumns({"usable": enabled & ~offline, "shown": ~hidden, "offline": offline, "virtual": virtual})
