"""Event detection in per-frame probability series.

A series is (context, frame, p). The windowed medians, which cost most, are dealt out by blocks of frames; the
steps after them are partitioned by the context.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuelake.functions.mathx import beta_calibrate, logit, sigmoid
from cuelake.operators.documents import FEATURE_ORDER, MODEL_KEYS
from cuelake.session import cut

#: The features' columns here, in the order of documents.FEATURE_ORDER, which has the names of a model file.
FEATURES = ["logit", "z", "log_area", "log_width", "concentration", "left_slope", "right_slope", "asymmetry", "prominence", "neighbour_mass"]


#: Frames of a block, as a multiple of the window's radius.
BLOCK_WINDOWS = 40
#: Islands that start within so many frames are read together.
ISLAND_FRAMES = 4096
#: Numbers that a task sorts at once for windowed medians.
SLAB_CELLS = 1 << 20


#: Cells of distance frames in a block of suppression, the share of a block that is read on each side of it, and
#: how much wider the next blocks are.
SETTLE_CELLS, SETTLE_HALO, SETTLE_GROWTH = 8192, 8, 16


@dataclass(frozen=True)
class Detector:
    """Parameters of the detector."""

    # fixed values: those of the default model
    eps: float = 1e-6
    window: int = 50
    least_p: float = 0.1
    least_z: float = 2.5
    peak_radius: int = 2
    floor: float = 0.03
    relative: float = 0.15
    expand_z: float = 1.5
    patience: int = 2
    mass_radius: int = 2
    intercept: float = -2.5
    weights: tuple[float, ...] = field(default=(0.55, 0.0, -0.3, -0.6, 2.2, 0.75, 0.75, -0.4, 1.1, -0.12))
    false_positive: float = 1.0
    false_negative: float = 2.0
    distance: int = 3
    midpoint: float = 2.0
    softness: float = 2.0
    #: a, b and c of a beta calibration of scores, if there is one.
    calibration: tuple[float, float, float] | None = None

    @property
    def threshold(self) -> float:
        return self.false_positive / (self.false_positive + self.false_negative)

    @classmethod
    def from_model(cls, text: str) -> Detector:
        """From a model file's JSON; ValueError for keys, features or values that documents.model_errors refuses."""
        m = json.loads(text)
        unknown = sorted(set(m) - set(MODEL_KEYS))
        if unknown or m["model_version"] != 1 or m["classifier"]["feature_order"] != FEATURE_ORDER:
            raise ValueError(f"unknown keys {unknown}, or another version or order of features")
        calibration = m.get("calibration")
        if calibration is not None and sorted(calibration) != ["a", "b", "c"]:
            raise ValueError(f"a calibration of {sorted(calibration)}")
        return cls(
            m["epsilon"], m["robust_window_radius"], m["candidate_probability_threshold"], m["candidate_robust_threshold"], m["peak_radius"], m["event_probability_floor"], m["event_relative_floor"], m["event_robust_floor"],
            m["event_boundary_patience"], m["neighbor_radius"], m["classifier"]["intercept"], tuple(m["classifier"]["coefficients"]), m["false_positive_cost"], m["false_negative_cost"], m["minimum_event_distance"],
            m["short_shot_midpoint"], m["short_shot_softness"], calibration and tuple(float(calibration[k]) for k in "abc"),
        ).checked()

    def checked(self) -> Detector:
        """Raises ValueError for values that make no sense."""
        if len(self.weights) != len(FEATURES):
            raise ValueError(f"{len(self.weights)} weights for {len(FEATURES)} features")
        if not 0 < self.eps < 0.5 or self.window < 1 or self.patience < 1 or self.softness <= 0 or self.distance < 0:
            raise ValueError("a parameter is out of its range")
        if self.false_positive < 0 or self.false_negative < 0 or self.false_positive + self.false_negative == 0:
            raise ValueError("costs must not be negative, nor both zero")
        if self.calibration and not all(math.isfinite(x) for x in self.calibration):
            raise ValueError("the calibration is not finite")
        return self


def clean_probability(p: Column) -> Column:
    """0 if it is no number, held within 0..1."""
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def _sliding_medians(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The median of the values up to radius places away, and the median distance from it; windows shrink at the ends.

    A slab of windows is sorted at once, so that memory stays within SLAB_CELLS numbers whatever the radius.
    """
    n, width = len(values), 2 * radius + 1
    # what lies beyond the ends sorts behind every value
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(values, radius, constant_values=np.inf), width)
    at = np.arange(n)
    counts = np.minimum(at, radius) + np.minimum(n - 1 - at, radius) + 1
    middle, spread = np.empty(n), np.empty(n)
    for start in range(0, n, max(1, SLAB_CELLS // width)):
        part = slice(start, start + max(1, SLAB_CELLS // width))
        rows, low, high = np.arange(len(at[part])), (counts[part] - 1) // 2, counts[part] // 2
        held = np.sort(windows[part], axis=1)
        middle[part] = (held[rows, low] + held[rows, high]) / 2
        held = np.sort(np.abs(windows[part] - middle[part, None]), axis=1)
        spread[part] = (held[rows, low] + held[rows, high]) / 2
    return middle, spread


def robust_z(series: DataFrame, d: Detector = Detector(), context: str = "context", frame: str = "frame", p: str = "p") -> DataFrame:
    """Adds logit, base (windowed median of p) and z. Windows shrink at the ends.

    frame counts a context's rows without a gap. A context is dealt out in blocks of frames, each with the
    window's frames around it, so that one long recording makes many tasks. An input column named like a result is
    replaced.
    """
    width = BLOCK_WINDOWS * d.window
    block = F.floor(F.col(frame) / width)
    rows = series.drop("logit", "base", "z").withColumn(p, clean_probability(F.col(p)).cast("double")).withColumn("logit", logit(F.col(p), d.eps))
    spread = rows.withColumn("_own", block).withColumn("_block", F.explode(F.array_distinct(F.array(*[F.floor((F.col(frame) + k) / width) for k in (-d.window, 0, d.window)]))))
    names, radius, eps = rows.columns, d.window, d.eps

    def medians(group: pa.Table) -> pa.Table:
        group = group.sort_by(frame)
        logits = group["logit"].to_numpy()
        middle, away = _sliding_medians(logits, radius)
        base, _ = _sliding_medians(group[p].to_numpy(), radius)
        told = group.select(names).append_column("base", pa.array(base)).append_column("z", pa.array((logits - middle) / (1.4826 * away + eps)))
        return told.filter(pc.equal(group["_own"], group["_block"]))

    schema = StructType([*rows.schema.fields, StructField("base", DoubleType()), StructField("z", DoubleType())])
    return spread.groupBy(context, "_block").applyInArrow(medians, schema)


def local_peaks(rows: DataFrame, d: Detector = Detector(), context: str = "context", frame: str = "frame", p: str = "p") -> DataFrame:
    """Rows that are the largest within the radius, the earliest of equals, and above both thresholds."""
    order = Window.partitionBy(context).orderBy(frame)
    most = F.max(p).over(order.rowsBetween(-d.peak_radius, d.peak_radius))
    before = F.max(p).over(order.rowsBetween(-d.peak_radius, -1))
    marked = rows.withColumn("_peak", (F.col(p) == most) & (before.isNull() | (before < F.col(p))))
    return marked.where(F.col("_peak") & (F.col(p) >= d.least_p) & (F.col("z") >= d.least_z)).drop("_peak")


def _reach(p: np.ndarray, z: np.ndarray, need: float, d: Detector) -> int:
    """How many places outwards from a peak its event reaches; p and z are those of the rows from the peak on."""
    last, start, size = -1, 0, 64
    while start < len(p):
        part = slice(start, start + size)
        hits = np.flatnonzero((p[part] >= need) | (z[part] >= d.expand_z)) + start
        far = np.flatnonzero(np.diff(hits, prepend=last) > d.patience)
        if len(far):
            hits = hits[: far[0]]
        last = int(hits[-1]) if len(hits) else last
        start, size = min(start + size, len(p)), 2 * size
        if len(far) or start - 1 - last >= d.patience:
            break
    return last + 1


def expand_peaks(rows: DataFrame, peaks: DataFrame, d: Detector = Detector()) -> DataFrame:
    """(context, frame, start, end) of each peak: outwards while rows qualify, until `patience` misses in a row.

    A row qualifies if p reaches both the floor and a share of the peak's p, or z the floor of z. Rows below
    both floors qualify for no peak, so runs of `patience` of them cut a context into islands that no peak
    leaves. Islands with a peak are dealt out by the block of frames in which they start; there each peak looks both
    ways as far as its event goes, and no row is copied for it.
    """
    order = Window.partitionBy("context").orderBy("frame")
    weak = F.when((F.col("p") >= d.floor) | (F.col("z") >= d.expand_z), 0).otherwise(1)
    top = peaks.select("context", "frame", F.col("p").alias("_peak")).distinct()
    marked = rows.select("context", "frame", "p", "z").join(top, ["context", "frame"], "left").withColumn("_weak", weak)
    marked = marked.withColumn("_stop", (F.sum("_weak").over(order.rowsBetween(1 - d.patience, 0)) == d.patience).cast("int"))
    marked = marked.withColumn("_island", F.sum("_stop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("context", "_island")
    held = marked.withColumns({"_first": F.min("frame").over(island), "_any": F.max("_peak").over(island)}).where("_any is not null")
    held = held.select("context", "frame", "p", "z", "_peak", "_first", F.floor(F.col("_first") / ISLAND_FRAMES).alias("_block"))

    def ends(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        frames, p, z, first = (group[c].to_numpy() for c in ("frame", "p", "z", "_first"))
        at = np.flatnonzero(pc.is_valid(group["_peak"]).to_numpy())
        tops = group["_peak"].to_numpy()
        starts, stops = [], []
        for k in at:
            low, high = np.searchsorted(first, first[k], "left"), np.searchsorted(first, first[k], "right")
            need = max(d.floor, d.relative * tops[k])
            starts.append(frames[k - _reach(p[low:k][::-1], z[low:k][::-1], need, d)])
            stops.append(frames[k + _reach(p[k + 1 : high], z[k + 1 : high], need, d)])
        told = group.select(["context", "frame"]).take(pa.array(at))
        return told.append_column("start", pa.array(starts, pa.int64())).append_column("end", pa.array(stops, pa.int64()))

    kinds = dict(rows.dtypes)
    out = held.groupBy("context", "_block").applyInArrow(ends, f"context {kinds['context']}, frame {kinds['frame']}, start long, end long")
    return out.withColumns({c: F.col(c).cast(kinds["frame"]) for c in ("start", "end")})


def merge_intervals(rows: DataFrame, context: str = "context", start: str = "start", end: str = "end") -> DataFrame:
    """(context, interval_no, start, end): intervals that share a frame become one."""
    order = Window.partitionBy(context).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(context, start, end, F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0).alias("_new"))
    numbered = marked.withColumn("interval_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(context, "interval_no").agg(F.min(start).alias(start), F.max(end).alias(end))


def event_features(rows: DataFrame, events: DataFrame, d: Detector = Detector()) -> DataFrame:
    """One row per event (context, start, end) with its peak frame and features."""
    order = Window.partitionBy("context").orderBy("frame")
    wide = rows.withColumn("_mass", F.sum("p").over(order.rowsBetween(-d.mass_radius, d.mass_radius)))
    frames = events.select("context", F.col("start").alias("event_start"), F.col("end").alias("event_end"), F.explode(F.sequence("start", "end")).alias("frame"))
    inside = frames.join(wide, ["context", "frame"])
    best = F.struct(-F.col("p"), F.col("frame"))
    row = F.struct("p", "frame", "logit", "base", "_mass")
    found = inside.groupBy("context", "event_start", "event_end").agg(
        F.min_by(row, best).alias("_top"), F.max("z").alias("z"), F.sum("p").alias("_area"), F.min_by("p", "frame").alias("_first"), F.max_by("p", "frame").alias("_last")
    )
    f, peak = F.col("_top.frame"), F.col("_top.p")
    width = F.col("event_end") - F.col("event_start") + 1
    left = (peak - F.col("_first")) / F.greatest(f - F.col("event_start"), F.lit(1))
    right = (peak - F.col("_last")) / F.greatest(F.col("event_end") - f, F.lit(1))
    values = {
        "logit": F.col("_top.logit"), "z": F.col("z"), "log_area": F.log(F.col("_area") + d.eps), "log_width": F.log(width.cast("double")), "concentration": peak / (F.col("_area") + d.eps),
        "left_slope": left, "right_slope": right, "asymmetry": F.abs(left - right), "prominence": peak - F.col("_top.base"), "neighbour_mass": F.col("_top._mass"),
    }
    return found.select("context", "event_start", "event_end", f.alias("frame"), peak.alias("peak"), width.alias("width"), *[values[n].alias(n) for n in FEATURES])


def score_events(events: DataFrame, d: Detector = Detector()) -> DataFrame:
    """Adds score, calibrated if the model says how, and keeps events strictly above the threshold."""
    total = F.lit(d.intercept)
    for name, w in zip(FEATURES, d.weights, strict=True):
        total = total + F.lit(w) * F.col(name)
    score = sigmoid(total)
    if d.calibration:
        # by a lambda, as the raw score, a large expression, would be written out for each of its places otherwise
        score = F.transform(F.array(score), lambda s: beta_calibrate(F.greatest(F.least(s, F.lit(1 - d.eps)), F.lit(d.eps)), *d.calibration, d.eps))[0]
    return events.withColumn("score", score).where(F.col("score") > d.threshold)


def chains(events: DataFrame, gap: float, context: str = "context", frame: str = "frame") -> DataFrame:
    """Adds _chain: events of a context less than gap frames after the one before share a number."""
    order = Window.partitionBy(context).orderBy(frame)
    far = F.col(frame) - F.lag(frame).over(order) >= gap
    marked = events.withColumn("_far", F.when(far, 1).otherwise(0))
    return marked.withColumn("_chain", F.sum("_far").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def _settle(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows by (context, block), those known to stay (_sure) before the others, strongest first: of the others with a frame
    from _low to _high those that stay (_sure) or are open still. _edge_low, _edge_high: the nearest frames not sent here.

    An event whose stronger neighbours are all refused is kept, one with a kept neighbour is refused; whatever a row beyond the edges or
    an open event might decide stays open. Kept events are distance apart, so a cell of that many frames holds one.
    """
    of, kept, low_open, high_open = None, {}, {}, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        take, sure = [], []
        for k, (context, block, known, f, low, high, edge_low, edge_high) in enumerate(zip(*(column(n).to_pylist() for n in ("_context", "_block", "_sure", "_frame", "_low", "_high", "_edge_low", "_edge_high")), strict=True)):
            if of != (context, block):
                of, kept, low_open, high_open = (context, block), {}, {}, {}
            c = f // distance
            if known:
                kept[c] = f
                continue
            if c in kept or f - kept.get(c - 1, f - distance) < distance or kept.get(c + 1, f + distance) - f < distance:
                continue
            open_ = c in low_open or f - high_open.get(c - 1, f - distance) < distance or low_open.get(c + 1, f + distance) - f < distance
            if open_ or f - edge_low < distance or edge_high - f < distance:
                low_open[c], high_open[c] = min(f, low_open.get(c, f)), max(f, high_open.get(c, f))
                settled = False
            else:
                kept[c], settled = f, True
            if low <= f < high:
                take.append(k)
                sure.append(settled)
        told = batch.take(pa.array(take, pa.int64()))
        yield told.set_column(told.schema.get_field_index("_sure"), "_sure", pa.array(sure, pa.bool_()))


def suppress(events: DataFrame, distance: int = 3, context: str = "context", score: str = "score", peak: str = "peak", prominence: str = "prominence", frame: str = "frame") -> DataFrame:
    """Of events nearer than distance the strongest, chosen greedily; of equals the earliest. Events without a frame go.

    Whether an event stays depends on stronger ones nearby only, so a context is dealt out by blocks of frames, each with some
    of the frames around it. What these don't settle, as strengths rise on and on up to the edge, is dealt out again in
    blocks SETTLE_GROWTH times as wide, beside what stays for sure; the last block holds the open events of a rise that spans it all.
    """
    rows = events.where(F.col(frame).isNotNull())
    if distance <= 0:
        return rows
    inner = {"_context": F.col(context), "_frame": F.col(frame).cast("long"), "_sure": F.lit(False)}
    rank = [(-F.col(c)).asc_nulls_first() for c in (score, peak, prominence)]
    left = cut(rows.withColumns(inner))
    ends = left.agg(F.min("_frame"), F.max("_frame")).first()
    width, done = SETTLE_CELLS * distance, None
    while left is not None:
        whole = ends[0] is None or (ends[1] - ends[0]) < width
        halo = 0 if whole else width // SETTLE_HALO
        start = ends[0] or 0
        at = F.col("_frame") - start
        blocks = F.array(F.lit(0).cast("long")) if whole else F.array_distinct(F.array(*[F.floor((at + d) / width) for d in (-halo, 0, halo)]))
        dealt = left.withColumn("_block", F.explode(blocks)).withColumn("_low", F.col("_block") * width + start).withColumn("_high", F.col("_low") + width)
        far = F.lit(1 << 62)
        edges = {"_edge_low": -far if whole else F.col("_low") - halo - 1, "_edge_high": far if whole else F.col("_high") + halo}
        dealt = dealt.withColumns(edges).repartition("_context", "_block").sortWithinPartitions("_context", "_block", F.desc("_sure"), *rank, "_frame")
        settled = dealt.mapInArrow(lambda batches: _settle(batches, distance), dealt.schema)
        if whole:
            sure, left = settled, None
        else:
            held = cut(settled)
            sure, open_ = held.where("_sure"), held.where("not _sure")
            names = left.columns
            left = None if open_.isEmpty() else open_.select(*names)
        done = sure if done is None else done.unionByName(sure)
        if left is not None:
            left = left.unionByName(done.select(*names))
        width *= SETTLE_GROWTH
    return done.select(*[F.col(f"`{c}`") for c in events.columns])


def short_shots(events: DataFrame, d: Detector = Detector()) -> DataFrame:
    """Adds confidence; in order of frames, an event soon after the last accepted one counts less.

    At 40 times the softness past the midpoint the factor is 1.0 as a double, so chains that far apart are
    folded by themselves. Events are those of score_events: above the threshold.
    """
    at = F.struct(F.col("frame").cast("long").alias("f"), F.col("score").alias("s"), F.struct(*events.columns).alias("row"))
    parts = chains(events, d.midpoint + 40 * d.softness)
    ordered = parts.groupBy("context", "_chain").agg(F.array_sort(F.collect_list(at)).alias("_e"))
    confidence = f"e.s * coalesce(1 / (1 + exp(-(e.f - s.last - {d.midpoint}D) / {d.softness}D)), 1D)"
    fold = f"""aggregate(_e, named_struct('last', CAST(NULL AS bigint), 'out', CAST(array() AS array<double>)), (s, e) ->
        if({confidence} > {d.threshold}D, named_struct('last', e.f, 'out', concat(s.out, array({confidence}))), named_struct('last', s.last, 'out', concat(s.out, array(CAST(NULL AS double))))), s -> s.out)"""
    pairs = ordered.select(F.explode(F.arrays_zip(F.col("_e").alias("e"), F.expr(fold).alias("c"))).alias("_k"))
    return pairs.where("_k.c IS NOT NULL").select("_k.e.row.*", F.col("_k.c").alias("confidence"))


def detect(series: DataFrame, d: Detector = Detector()) -> DataFrame:
    """(context, cut_frame, confidence, event_start, event_end, score) from (context, frame, p)."""
    d = d.checked()
    rows = cut(robust_z(series, d))  # read by four steps
    peaks = local_peaks(rows, d)
    events = event_features(rows, merge_intervals(expand_peaks(rows, peaks, d)), d)
    final = short_shots(suppress(score_events(events, d), d.distance), d)
    return final.select("context", F.col("frame").alias("cut_frame"), "confidence", "event_start", "event_end", "score")


def cuts_to_shots(cuts: DataFrame, frames: DataFrame, rate: float, context: str = "context", cut: str = "cut_frame") -> DataFrame:
    """(context, shot_no, start_frame, end_frame, start_us, end_us); frames: (context, n_frames).

    Cuts at or after the last frame are ignored. A shot ends with its cut's frame; all but the last end at
    that frame's time, the last one when its last frame is over.
    """
    usable = cuts.join(frames, context).where(F.col(cut).between(0, F.col("n_frames") - 2)).select(context, F.col(cut).alias("end_frame")).distinct()
    tails = frames.where("n_frames > 0").select(context, (F.col("n_frames") - 1).alias("end_frame"))
    order = Window.partitionBy(context).orderBy("end_frame")
    shots = usable.unionByName(tails).withColumn("start_frame", F.coalesce(F.lag("end_frame").over(order) + 1, F.lit(0)))
    shots = shots.withColumn("shot_no", F.row_number().over(order)).join(frames, context)
    us = lambda frame: F.floor(frame / F.lit(rate) * 1e6 + 0.5).cast("long")
    last = F.col("end_frame") == F.col("n_frames") - 1
    end = F.when(last, F.greatest(us(F.col("end_frame") + 1), us(F.col("start_frame")) + 1)).otherwise(us(F.col("end_frame")))
    return shots.select(context, F.col("shot_no").cast("long").alias("shot_no"), F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), us(F.col("start_frame")).alias("start_us"), end.alias("end_us"))


def stitch_windows(windows: DataFrame, stride: int = 50, head: int = 25) -> DataFrame:
    """One value per frame from overlapping windows (context, window_no, values): the centre of each counts.

    A window with any value outside 0..1 holds log odds and passes through the sigmoid as a whole.
    """
    odd = F.exists("values", lambda v: (v < 0) | (v > 1))
    fixed = F.when(odd, F.transform("values", sigmoid)).otherwise(F.col("values"))
    centre = windows.select("context", "window_no", F.posexplode(F.slice(fixed, head + 1, stride)).alias("k", "p"))
    return centre.select("context", (F.col("window_no") * stride + F.col("k")).cast("long").alias("frame"), "p")


#: Windows that a task makes from one block of frames.
BLOCK_OF_WINDOWS = 40


def infer_windows(frames: DataFrame, model: Callable[[np.ndarray], np.ndarray], length: int = 100, stride: int = 50, head: int = 25) -> DataFrame:
    """(context, frame, p) of a model over overlapping windows of frames (context, frame, data).

    data: an array of numbers, of one size in a recording; frames are numbered from 0 without gaps, else ValueError.
    Window j holds the frames from j * stride - head on, `length` of them; before the first frame and after the last these
    are repeated. model: windows (n, length, size) to values (n, at least head + stride); of a window the values from
    head on count, for stride frames, none for frames that aren't there. A window with any value outside 0..1 holds log
    odds and passes through the sigmoid as a whole. Frames are dealt out by blocks of windows with the frames beside
    them, so a recording takes many tasks and each holds one block. Rows without a frame or context are left out.
    """
    size, after = BLOCK_OF_WINDOWS * stride, length - head - stride
    kind = dict(frames.dtypes)["context"]
    rows = frames.where("context is not null and frame is not null").select("context", F.col("frame").cast("long").alias("frame"), F.col("data").cast("array<float>").alias("data"))
    blocks = F.array_distinct(F.transform(F.array(F.lit(-after), F.lit(0), F.lit(head)), lambda d: F.floor((F.col("frame") + d) / size)))
    dealt = rows.select("context", F.explode(F.filter(blocks, lambda b: b >= 0)).alias("block"), "frame", "data")
    dealt = dealt.repartition("context", "block").sortWithinPartitions("context", "block", "frame")

    def one(context: object, block: int, numbers: list[np.ndarray], data: list[np.ndarray], arrow: pa.DataType) -> pa.RecordBatch:
        at, values = np.concatenate(numbers), np.concatenate(data)
        low = max(0, block * size - head)
        if at[0] != low or np.any(np.diff(at) != 1):
            raise ValueError(f"frames of {context!r} about {int(at[0])} have gaps or repeats")
        firsts = np.arange(block * size, min((block + 1) * size, at[-1] + 1), stride)
        if not len(firsts):
            return pa.RecordBatch.from_arrays([pa.array([], arrow), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["context", "frame", "p"])
        places = np.clip(firsts[:, None] - head + np.arange(length), 0, at[-1]) - low
        raw = np.asarray(model(values[places]), np.float64)
        odd = ((raw < 0) | (raw > 1)).any(axis=1)
        centre = raw[:, head : head + stride]
        p = np.where(odd[:, None], 1 / (1 + np.exp(-centre)), np.clip(centre, 0, 1)).ravel()
        frame = (firsts[:, None] + np.arange(stride)).ravel()
        there = frame <= at[-1]
        return pa.RecordBatch.from_arrays([pa.array([context] * int(there.sum()), arrow), pa.array(frame[there]), pa.array(p[there])], names=["context", "frame", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, numbers, data, arrow = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow = batch.column(0).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for i, j in zip(edges, edges[1:], strict=False):
                if keys[i] != of:
                    if of is not None:
                        yield one(*of, numbers, data, arrow)
                    of, numbers, data = keys[i], [], []
                numbers.append(batch.column(2)[i:j].to_numpy())
                flat = batch.column(3)[i:j].flatten().to_numpy(zero_copy_only=False)
                if len(flat) % (j - i):
                    raise ValueError(f"frames of {keys[i][0]!r} differ in size")
                data.append(flat.reshape(j - i, -1))
        if of is not None:
            yield one(*of, numbers, data, arrow)

    return dealt.mapInArrow(run, f"context {kind}, frame long, p double")
