"""Number functions: rounding rules, calibration, ladders, planning arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: playback speeds, bitrate ladders (from, to, step), megabits a second by codec and quality
SHUTTLE = [-16, -8, -4, -2, -1, 1, 2, 4, 8, 16]
LADDER = [(16, 32, 4), (32, 64, 8), (64, 128, 16), (128, 256, 32), (256, 512, 64)]
MP2_RATES = [128, 160, 192, 224, 256, 320, 384]
MP3_RATES = [128, 160, 192, 224, 256, 320]
H264_MBPS = {"low": 5.0, "medium": 9.0, "high": 14.0, "very_high": 24.0}
PRORES_MBPS = {"low": 45.0, "medium": 147.0, "high": 220.0, "very_high": 220.0}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def logit(p: Column, eps: float = 1e-6) -> Column:
    """K1: log odds of a probability held away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    """K1: by the sign, so that nothing overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def array_median(values: Column) -> Column:
    """K2: mean of the two middle values for even sizes, 0 for none; values hold no nulls."""
    s, n = F.sort_array(values), F.size(values)  # array_sort would compare by an interpreted lambda
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def linear_score(values: Column, weights: Sequence[float], intercept: float) -> Column:
    """K3: probability of a logistic model."""
    terms = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return sigmoid(F.aggregate(terms, F.lit(float(intercept)), lambda a, b: a + b))


def beta_calibrate(p: Column, a: float, b: float, c: float, eps: float = 1e-6) -> Column:
    """K4."""
    return sigmoid(F.lit(a) * F.log(p + eps) - F.lit(b) * F.log(1 - p + eps) - F.lit(c))


def decision_threshold(false_positive: Column, false_negative: Column) -> Column:
    """K5."""
    return false_positive / (false_positive + false_negative)


def rating(x: Column) -> Column:
    """K6: half up, held within 0..5; 0 if it is no number."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(F.least(F.greatest(half_up(x), F.lit(0).cast("long")), F.lit(5).cast("long"))).cast("int")


def sample_times(duration: Column, per_second: int = 2, most: int = 240) -> Column:
    """K8: evenly spaced times from 0 to the last millisecond, both included."""
    latest = F.greatest(duration - 1000, F.lit(0).cast("long"))
    n = F.least(F.greatest(F.ceil(duration / F.lit(1e6) * per_second), F.lit(2).cast("long")), F.lit(most).cast("long"))
    times = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor(latest * i / (n - 1)))
    return F.when(latest == 0, F.array(F.lit(0).cast("long"))).otherwise(times)


def tick_step(span: Column, width: Column, least: float = 4.0) -> Column:
    """K9: the least power of four of frames that is at least so many pixels wide."""
    each = width / F.greatest(F.lit(1.0), span)
    power = F.greatest(F.lit(0).cast("long"), F.ceil(F.log(F.lit(least) / each) / F.log(F.lit(4.0)) - 1e-12))
    return F.pow(F.lit(4.0), power).cast("long")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def least_span(width: Column, duration: Column, widest: float = 16.0) -> Column:
    """Frames that are shown at least."""
    span = F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(width, F.lit(1.0)) / widest))
    return F.when(duration > 0, F.least(duration, span)).otherwise(span)


def to_visual(x: Column, low: float, shown: float) -> Column:
    """A logical ratio on a logarithmic scale."""
    at = F.log(F.least(F.greatest(x, F.lit(low)), F.lit(1.0)) / low) / F.log(F.lit(1 / low))
    return F.lit(shown) + at * (1 - shown)


def to_logical(v: Column, low: float, shown: float) -> Column:
    at = F.least(F.greatest((v - shown) / (1 - shown), F.lit(0.0)), F.lit(1.0))
    return F.lit(low) * F.exp(at * F.log(F.lit(1 / low)))


def lookup(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def file_size(container: Column, quality: Column, width: Column, height: Column, fps: Column, audio_kbps: Column, duration: Column) -> Column:
    """Bytes that an export will have, null without a duration."""
    scale = width * height * fps / F.lit(1920.0 * 1080 * 30)
    video = F.when(container == "mov_prores", lookup(quality, PRORES_MBPS)).when(container == "mp4_h264", lookup(quality, H264_MBPS)).otherwise(lookup(quality, H264_MBPS) * 0.6)
    return F.when(duration > 0, (video * scale + audio_kbps / F.lit(1000.0)) * 1e6 * (duration / F.lit(1e6)) / 8)


def even_dimension(x: Column) -> Column:
    """K13."""
    held = F.greatest(x, F.lit(2).cast("long"))
    return held - held % 2


def next_speed(rate: Column, direction: Column) -> Column:
    """One step along the ladder of speeds; from standing, one forward or back."""
    speeds = F.array(*[F.lit(x) for x in SHUTTLE])
    at = F.array_position(speeds, rate) + F.when(direction < 0, -1).otherwise(1)
    at = F.least(F.greatest(at, F.lit(1).cast("long")), F.lit(len(SHUTTLE)).cast("long")).cast("int")
    return F.when(rate == 0, F.when(direction < 0, -1).otherwise(1)).otherwise(F.element_at(speeds, at))


def least_at_least(x: Column, steps: Sequence[int]) -> Column:
    """The smallest step that is not below x, else the largest."""
    fits = F.array_min(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s >= x))
    return F.coalesce(fits, F.lit(max(steps)))


def nearest_of(x: Column, steps: Sequence[int]) -> Column:
    """The nearest step, the first of equally near ones."""
    near = F.transform(F.array(*[F.lit(s) for s in steps]), lambda s, i: F.struct(F.abs(s - x).alias("d"), i.alias("i"), s.alias("s")))
    return F.array_min(near)["s"]


def aspect_ratio(text: Column) -> Column:
    """K17: 'w:h' as a number, null if it is none."""
    parts = F.split(text, ":")
    w, h = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & (w > 0) & (h > 0), w / h)


def stall_seconds(us: Column) -> Column:
    """2 * seconds + 8, held within 20..60."""
    return F.least(F.greatest(2 * F.ceil(us / F.lit(1e6)) + 8, F.lit(20).cast("long")), F.lit(60).cast("long"))


def thread_budget(cpus: Column, workers: Column) -> Column:
    return F.least(F.greatest(F.ceil(cpus / workers), F.lit(1).cast("long")), F.lit(16).cast("long"))


def fit_within(width: Column, height: Column, edge: Column) -> tuple[Column, Column]:
    """The longer side becomes edge, the other follows by whole division."""
    wide = width >= height
    one = F.lit(1).cast("long")
    other = F.greatest(F.floor(F.least(width, height) * edge / F.greatest(width, height)), one)
    return F.when(wide, edge).otherwise(other), F.when(wide, other).otherwise(edge)


def bitrate_ladder() -> Column:
    """K20."""
    return F.array_distinct(F.flatten(F.array(*[F.sequence(F.lit(a), F.lit(b), F.lit(s)) for a, b, s in LADDER])))


def _once(value: Column, f) -> Column:
    """f of a value that it uses several times but that is made once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def detail_score(red: Column, green: Column, blue: Column, width: int, height: int) -> Column:
    """V / (v + 1000) for the variance v of the Laplacian of a frame's luma; channels are arrays, row by row."""
    luma = F.zip_with(F.zip_with(red, green, lambda r, g: r * 77 + g * 150), blue, lambda x, b: F.shiftright(x + b * 29, 8))
    inner = [r * width + c for r in range(1, height - 1) for c in range(1, width - 1)]

    def edges(y: Column) -> Column:
        at = lambda k: F.get(y, k)
        return F.transform(F.array(*map(F.lit, inner)), lambda k: at(k - width) + at(k - 1) + at(k + 1) + at(k + width) - at(k) * 4)

    def variance(xs: Column) -> Column:
        total = lambda f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
        mean = total(lambda x: x) / len(inner)
        return F.greatest(total(lambda x: x * x) / len(inner) - mean * mean, F.lit(0.0))

    return _once(_once(_once(luma, edges), variance), lambda v: v / (v + 1000))


def colour_score(red: Column, green: Column, blue: Column) -> Column:
    """Entropy of the frame's 4096 colours (four bits a channel) as a share of 12 bits."""
    bins = F.zip_with(F.zip_with(red, green, lambda r, g: F.shiftright(r, 4) * 256 + F.shiftright(g, 4) * 16), blue, lambda x, b: x + F.shiftright(b, 4))
    shares = _once(bins, lambda b: F.transform(F.array_distinct(b), lambda v: F.size(F.filter(b, lambda w: w == v)) / F.size(b)))
    entropy = -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p))
    return F.least(F.greatest(entropy / 12, F.lit(0.0)), F.lit(1.0))


def frame_score(red: Column, green: Column, blue: Column, width: int, height: int) -> Column:
    """K7: how much a frame shows: 0.6 for its detail and 0.4 for its colours."""
    return F.lit(0.6) * detail_score(red, green, blue, width, height) + F.lit(0.4) * colour_score(red, green, blue)
