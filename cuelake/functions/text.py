"""String functions: cleaning, search terms, keyword paths, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that file names may not hold, and the length limits of names
ILLEGAL_NAME = r'[<>:"/\\|?*\x00-\x1f\x7f]'
NAME_LIMIT, PROJECT_LIMIT = 120, 80
# fixed values: what separates keywords, and the levels of a keyword's path
LIST_SEPARATORS, PATH_SEPARATORS = "[,，]", (">", "<", "|")
_KEYWORD_JUNK = "[,，<>|*]"

# fixed values: the parts of each naming rule
RENAME_RULES = {
    "label": ("label",),
    "label_keywords": ("label", "label_keywords"),
    "time": ("time",),
    "time_label": ("time", "label"),
    "filename": ("filename",),
    "filename_label": ("filename", "label"),
    "filename_time": ("filename", "time"),
    "custom": ("custom",),
    "custom_label": ("custom", "label"),
    "custom_time": ("custom", "time"),
    "custom_filename": ("custom", "filename"),
}


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def clean_plain_text(raw: Column) -> Column:
    """Markup and escapes removed, blanks collapsed within lines, blank lines dropped."""
    text = F.regexp_replace(raw, r"\\[Nn]", "\n")
    text = F.regexp_replace(text, r"\\h|&nbsp;", " ")
    text = F.regexp_replace(text, r"\{[^}]*\}", "")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def append_unique_line(text: Column, line: Column) -> Column:
    """The trimmed line as a new last line, unless it is blank or already there."""
    extra = F.trim(line)
    return F.when((extra == "") | F.array_contains(F.split(text, "\n"), extra), text).when(text == "", extra).otherwise(F.concat_ws("\n", text, extra))


def merge_distinct(values: Column, by: str = " / ") -> Column:
    """The distinct non-blank values of an array, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), by)


def normalize_newlines(text: Column) -> Column:
    """I4: no byte order mark, one kind of line end."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def search_terms(query: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased query, or the query itself."""
    q = F.lower(F.trim(query))
    terms = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(terms) > 0, terms).when(q == "", F.array().cast("array<string>")).otherwise(F.array(q))


def sanitize_keyword(name: Column) -> Column:
    """A keyword's name without separators and markers."""
    return F.trim(F.regexp_replace(name, _KEYWORD_JUNK, ""))


def _path_separator(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(">")), ">").when(F.contains(value, F.lit("<")), "<").when(F.contains(value, F.lit("|")), "|")


def _path_names(value: Column) -> Column:
    parts = F.split(value, "[<>|]")
    return F.transform(parts, sanitize_keyword)


def parse_keywords(text: Column) -> Column:
    """struct(paths, error). A path is root-first; < lists leaf first. The first error empties all.

    Errors: 'mixed' for more than one kind of path separator in a value, 'empty' for an empty name.
    """
    values = F.filter(F.transform(F.split(text, LIST_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")

    def one(v: Column) -> Column:
        kinds = sum((F.contains(v, F.lit(s)).cast("int") for s in PATH_SEPARATORS[1:]), F.contains(v, F.lit(">")).cast("int"))
        names = _path_names(v)
        error = F.when(kinds > 1, "mixed").when(F.exists(names, lambda n: n == ""), "empty")
        return F.struct(F.when(F.contains(v, F.lit("<")), F.reverse(names)).otherwise(names).alias("names"), error.alias("error"))

    parsed = F.transform(values, one)
    error = F.element_at(F.filter(F.transform(parsed, lambda p: p["error"]), lambda e: e.isNotNull()), 1)
    error = F.when(F.exists(parsed, lambda p: p["error"].isNotNull()), error)
    paths = F.array_distinct(F.transform(parsed, lambda p: p["names"]))
    return F.struct(F.when(error.isNull(), paths).otherwise(F.array().cast("array<array<string>>")).alias("paths"), error.alias("error"))


def lenient_keywords(text: Column) -> Column:
    """I8: what can be kept of a keyword list, as text; only the first kind of path separator counts."""
    values = F.filter(F.transform(F.split(text, LIST_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")

    def one(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(PATH_SEPARATORS):
            names = F.filter(F.transform(F.split(v, "[" + s + "]"), sanitize_keyword), lambda n: n != "")
            out = F.when(F.contains(v, F.lit(s)), F.array_join(names, s)).otherwise(out)
        return F.coalesce(out, sanitize_keyword(v))

    return F.array_join(F.filter(F.transform(values, one), lambda x: x != ""), ", ")


def format_keyword_path(names: Column) -> Column:
    """Leaf first."""
    return F.array_join(F.reverse(names), "<")


def format_keyword_paths(paths: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(paths, format_keyword_path)), ", ")


def expand_keyword_paths(paths: Column) -> Column:
    """Every leaf-first suffix of the paths that no longer path starts with, distinct and sorted."""
    full = F.filter(paths, lambda p: ~F.exists(paths, lambda q: (F.size(q) > F.size(p)) & (F.slice(q, 1, F.size(p)) == p)))
    suffixes = F.transform(full, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: format_keyword_path(F.slice(p, 1, n))))
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(suffixes))), ", ")


def replace_illegal(name: Column) -> Column:
    return F.regexp_replace(name, ILLEGAL_NAME, "_")


def file_name_component(value: Column) -> Column:
    """I10 (shown names): illegal characters to _, trimmed, no dots or blanks at the end."""
    return F.regexp_replace(F.trim(replace_illegal(value)), r"[. ]+$", "")


def clamp_file_name(name: Column, limit: int = NAME_LIMIT) -> Column:
    """At most limit characters; an extension of 2 to 10 characters with its dot stays."""
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    keeps = F.length(extension).between(2, 10)
    stem = F.substring(name, F.lit(1), F.least(F.length(name) - F.length(extension), F.lit(limit) - F.length(extension)))
    return F.when(F.length(name) <= limit, name).when(keeps, F.concat(stem, extension)).otherwise(F.left(name, F.lit(limit)))


def clamp_base_name(name: Column, limit: Column | int) -> Column:
    """At most limit characters; a -N suffix stays."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    suffix = F.regexp_extract(name, r"-(0|[1-9][0-9]*)$", 0)
    return F.when(F.length(name) <= limit, name).otherwise(F.concat(F.substring(name, F.lit(1), limit - F.length(suffix)), suffix))


def safe_component(value: Column) -> Column:
    """I10 (written names): illegal characters to _, clamped, no dots around, never empty."""
    out = F.regexp_replace(F.trim(clamp_file_name(replace_illegal(value))), r"^\.+|\.+$", "")
    return F.when(out == "", "clip").otherwise(out)


def project_name(name: Column, extension: str = ".lcp", default: str = "untitled") -> Column:
    """I16: a snapshot's name for a project."""
    plain = F.regexp_replace(F.trim(name), f"(?:{extension.replace('.', '[.]')}|{extension.upper().replace('.', '[.]')})$", "")
    out = F.regexp_replace(F.left(replace_illegal(plain), F.lit(PROJECT_LIMIT)), r"^[ .]+|[ .]+$", "")
    return F.when(out == "", default).otherwise(out)


def log_safe(value: Column) -> Column:
    """Control characters to blanks."""
    return F.regexp_replace(value, r"[\x00-\x1f\x7f]", " ")


def rename_base(rule: str, segments: dict[str, Column], fallback: str = "export") -> Column:
    """A naming rule's trimmed segments joined by -, else the label, else the fallback."""
    parts = [blank_to_null(segments[p]) for p in RENAME_RULES[rule]]
    return F.coalesce(blank_to_null(F.concat_ws("-", *parts)), blank_to_null(segments["label"]), F.lit(fallback))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def join_path(folder: Column, name: Column) -> Column:
    """With the separator that the folder uses."""
    separator = F.when(F.contains(folder, F.lit("\\")), "\\").otherwise("/")
    return F.when(F.regexp_like(folder, F.lit(r"[/\\]$")), F.concat(folder, name)).otherwise(F.concat(folder, separator, name))


def effective_output_name(name: Column) -> Column:
    """No dots or blanks in front."""
    return F.regexp_replace(name, r"^[. ]+", "")


def copy_suffix(name: Column, taken: Column) -> Column:
    """I19: 'name copyNN' after so many copies; two digits at least."""
    n = (taken + 1).cast("string")
    return F.concat(name, F.lit(" copy"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0")))


def human_size(size: Column) -> Column:
    """Bytes in the largest unit below 1024, one decimal below ten."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        value = size / F.lit(float(1024**k))
        shown = F.floor(value + 0.5).cast("string") if k == 0 else F.when(value >= 10, F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))
        text = F.concat(shown, F.lit(" " + unit))
        out = text if k == 4 else F.when(value < 1024, text).otherwise(out)
    return F.when(size <= 0, "-").otherwise(out)


def kilohertz(rate: Column) -> Column:
    whole = (rate / 1000).cast("long").cast("string")
    return F.concat(F.when(rate % 1000 == 0, whole).otherwise(F.format_string("%.1f", rate / F.lit(1000.0))), F.lit(" kHz"))


def frame_rate_label(rate: Column) -> Column:
    rounded = F.floor(rate * 100 + 0.5) / F.lit(100.0)
    return F.when(rounded == F.floor(rounded), F.floor(rounded).cast("string")).otherwise(F.format_string("%.2f", rounded))


def has_token(line: Column, token: Column) -> Column:
    """The token is one of the line's blank-separated words."""
    return F.array_contains(F.split(F.trim(line), r"\s+"), token)


def tag_value(tags: Column, *keys: str) -> Column:
    """The first non-blank value among the keys of a map."""
    return F.coalesce(*[blank_to_null(F.try_element_at(tags, F.lit(k))) for k in keys])


def fold_path(path: Column) -> Column:
    """The key by which paths are equal."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def natural_key(text: Column) -> Column:
    """A sort key that orders numbers inside text by value, of any length, without case and accents.

    Before its digits a number has how many there are, so a longer one sorts behind.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(F.regexp_like(run, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, key), ""), "UNICODE_CI_AI")
