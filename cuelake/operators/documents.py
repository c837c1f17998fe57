"""Versioned documents and parameter files: upgrades step by step, strict keys, checked ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an upgrade reports: nothing, a newer version than known, or a version that no step leads on from.
UNSUPPORTED, NO_CHAIN = "newer than supported", "no complete migration chain"


def upgraded(rows: DataFrame, steps: Mapping[int, Mapping[str, Column]], current: int, version: str = "version") -> DataFrame:
    """P10: rows lifted from version to version; steps[v] has the columns that change from v to v + 1.

    Adds migrated and error. Rows that are newer than current, or that no step takes on, keep their columns.
    """
    first = F.col(version)
    missing = [v for v in range(min(steps, default=current), current) if v not in steps]
    lowest = max([*missing, min(steps, default=current) - 1]) + 1
    error = F.when(first > current, UNSUPPORTED).when(first.isNull() | (first < lowest), NO_CHAIN)
    out = rows.withColumns({"_from": first, "error": error})
    for v in range(lowest, current):
        due = F.col("error").isNull() & (F.col(version) == v)
        out = out.withColumns({name: F.when(due, value).otherwise(F.col(name) if name in out.columns else F.lit(None)) for name, value in steps[v].items()} | {version: F.when(due, v + 1).otherwise(F.col(version))})
    return out.withColumn("migrated", F.col("error").isNull() & (F.col("_from") < current)).drop("_from")


def unknown_keys(json: Column, known: Sequence[str]) -> Column:
    """The top-level keys of a JSON text that are not known, sorted; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, known))))


# fixed values: the keys of a detector's model file, and the names and order of its features
MODEL_KEYS = [
    "model_version", "model_origin", "epsilon", "robust_window_radius", "candidate_probability_threshold", "peak_radius", "candidate_robust_threshold", "event_probability_floor", "event_relative_floor", "event_robust_floor",
    "event_boundary_patience", "neighbor_radius", "classifier", "calibration", "false_positive_cost", "false_negative_cost", "minimum_event_distance", "short_shot_midpoint", "short_shot_softness",
]
FEATURE_ORDER = ["peak_logit", "robust_prominence", "log_event_area", "log_event_width", "concentration", "left_slope", "right_slope", "asymmetry", "background_difference", "neighbor_mass"]
_MODEL = """model_version int, model_origin string, epsilon double, robust_window_radius int, candidate_probability_threshold double, peak_radius int, candidate_robust_threshold double,
    event_probability_floor double, event_relative_floor double, event_robust_floor double, event_boundary_patience int, neighbor_radius int,
    classifier struct<feature_order: array<string>, intercept: double, coefficients: array<double>>, calibration struct<a: double, b: double, c: double>,
    false_positive_cost double, false_negative_cost double, minimum_event_distance int, short_shot_midpoint double, short_shot_softness double"""


def model_errors(rows: DataFrame, json: str = "json") -> DataFrame:
    """Rows with error, the first rule that a detector's model file breaks, or null; null text is the default.

    Keys must be known and, but for calibration, present; features must stand in their order; numbers must lie in
    their ranges.
    """
    m, text = F.col("_m"), F.col(json)
    share = lambda name: m[name].between(0, 1)
    c = m["classifier"]
    rules = [
        ("malformed", F.json_object_keys(text).isNull()),
        ("unknown key", F.size(unknown_keys(text, MODEL_KEYS)) > 0),
        ("missing key", F.size(F.array_except(F.array(*[F.lit(k) for k in MODEL_KEYS if k != "calibration"]), F.json_object_keys(text))) > 0),
        ("version", ~(m["model_version"] == 1)),
        ("origin", F.trim(m["model_origin"]) == ""),
        ("epsilon", ~((m["epsilon"] > 0) & (m["epsilon"] < 0.5))),
        ("probability", ~(share("candidate_probability_threshold") & share("event_probability_floor") & share("event_relative_floor"))),
        ("patience", m["event_boundary_patience"] < 1),
        ("features", ~(c["feature_order"] == F.array(*map(F.lit, FEATURE_ORDER)))),
        ("coefficients", F.size(c["coefficients"]) != len(FEATURE_ORDER)),
        ("cost", ~((m["false_positive_cost"] > 0) & (m["false_negative_cost"] > 0))),
        ("midpoint", m["short_shot_midpoint"] < 0),
        ("softness", ~(m["short_shot_softness"] > 0)),
    ]
    error = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        error = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(error)
    return rows.withColumn("_m", F.from_json(text, _MODEL)).withColumn("error", F.when(text.isNotNull(), error)).drop("_m")


def read_workspaces(files: DataFrame, current: int = 4) -> DataFrame:
    """(path, version, project_id, workspace, migrated, error) of JSON documents (path, content).

    Documents before the current version have no id and get one made of their path; a missing version is 1.
    """
    doc = F.from_json("content", "version int, project_id string, workspace string")
    rows = files.select("path", F.json_object_keys("content").isNull().alias("_bad"), doc.alias("_d"))
    rows = rows.select("path", "_bad", F.coalesce("_d.version", F.lit(1)).alias("version"), F.col("_d.project_id").alias("project_id"), F.col("_d.workspace").alias("workspace"))
    minted = F.sha2(F.col("path"), 256)
    steps = {1: {}, 2: {}, 3: {"project_id": minted}}
    out = upgraded(rows, steps, current)
    known = F.col("error").isNull() & ~F.col("_bad")
    return out.select("path", "version", F.when(known, F.coalesce("project_id", minted)).alias("project_id"), "workspace", (F.col("migrated") & ~F.col("_bad")).alias("migrated"), F.when(F.col("_bad"), "malformed").otherwise(F.col("error")).alias("error"))


def preferences(rows: DataFrame, defaults: Mapping[str, str], json: str = "json", lines: str = "lines") -> DataFrame:
    """Rows with a column for each default: from a JSON document, else from `key=value` lines, else the default.

    A document that can be read counts alone: what it leaves out has its default, whatever the lines say.
    """
    doc = F.from_json(json, F.lit("map<string,string>"))
    pairs = F.transform(F.filter(F.split(F.coalesce(lines, F.lit("")), r"\r?\n"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    # of repeated keys the last line counts
    told = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    out = rows.withColumn("_doc", F.when(F.json_object_keys(json).isNotNull(), doc)).withColumn("_told", told)
    pick = lambda k: F.when(F.col("_doc").isNotNull(), F.try_element_at("_doc", F.lit(k))).otherwise(F.try_element_at("_told", F.lit(k)))
    return out.withColumns({k: F.coalesce(pick(k), F.lit(v)) for k, v in defaults.items()}).drop("_doc", "_told")
