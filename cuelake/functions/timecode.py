"""Time functions. Times are whole microseconds or frame numbers; there is no calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
SECOND = 1_000_000
# fixed values: the frame rates that stand in for missing ones
SHOWN_RATE, DETECTED_RATE = 24.0, 25.0


def _long(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("long"), F.lit(0).cast("long"))


def _fraction(seconds: Column) -> Column:
    """Whole seconds and up to six digits behind the dot, in microseconds."""
    parts = F.split(seconds, r"\.")
    return _long(F.get(parts, F.lit(0))) * SECOND + _long(F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 1, 6), 6, "0"))


def parse_subtitle_time(text: Column) -> Column:
    """[H:]M:S with , or . before the fraction; anything else is 0."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    two = _long(F.get(parts, F.lit(0))) * 60 * SECOND + _fraction(F.get(parts, F.lit(1)))
    three = (_long(F.get(parts, F.lit(0))) * 3600 + _long(F.get(parts, F.lit(1))) * 60) * SECOND + _fraction(F.get(parts, F.lit(2)))
    return F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three).otherwise(F.lit(0)).cast("long")


def parse_ass_time(text: Column) -> Column:
    """H:M:S only."""
    parts = F.split(F.trim(text), ":")
    three = (_long(F.get(parts, F.lit(0))) * 3600 + _long(F.get(parts, F.lit(1))) * 60) * SECOND + _fraction(F.get(parts, F.lit(2)))
    return F.when(F.size(parts) == 3, three).otherwise(F.lit(0)).cast("long")


def seconds_to_us(text: Column) -> Column:
    """Signed decimal seconds cut off after six digits, held within the bounds of a long."""
    value = F.trim(text)
    negative = F.startswith(value, F.lit("-"))
    digits = F.regexp_replace(value, r"^[-+]", "")
    whole = F.regexp_replace(F.regexp_extract(digits, r"^([0-9]*)", 1), "^0+", "")
    part = F.rpad(F.substring(F.regexp_extract(digits, r"^[0-9]*\.([0-9]*)", 1), 1, 6), 6, "0")
    exact = F.concat(whole, part).try_cast("decimal(38,0)")
    size = F.when(F.length(whole) > 20, F.lit(str(10**30)).cast("decimal(38,0)")).otherwise(F.coalesce(exact, F.lit(0).cast("decimal(38,0)")))
    up = F.when(size > LONG_MAX, F.lit(LONG_MAX)).otherwise(size.try_cast("long"))
    down = F.when(size > LONG_MAX, F.lit(LONG_MIN)).otherwise((-size).try_cast("long"))
    return F.when(negative, down).otherwise(up)


def actual_rate(rate: Column) -> Column:
    bad = F.isnull(rate) | F.isnan(rate) | (F.abs(rate) == float("inf"))
    return F.when(bad, F.lit(SHOWN_RATE)).otherwise(F.greatest(rate, F.lit(1.0)))


def nominal_rate(rate: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(actual_rate(rate) + 0.5))


def us_to_frame(us: Column, rate: Column) -> Column:
    """Half up."""
    return F.floor(F.greatest(us, F.lit(0).cast("long")) / F.lit(1e6) * actual_rate(rate) + 0.5)


def frame_to_us(frame: Column, rate: Column) -> Column:
    return F.floor(F.greatest(frame, F.lit(0).cast("long")) / actual_rate(rate) * F.lit(1e6) + 0.5)


def snap_us(us: Column, rate: Column) -> Column:
    """To the frame grid and back."""
    return frame_to_us(us_to_frame(us, rate), rate)


def frame_to_us_within(frame: Column, rate: Column, duration: Column) -> Column:
    """Half away from zero, held within the duration; 0 for a rate that makes no sense."""
    us = F.round(frame / rate * F.lit(1e6)).cast("long")
    return F.when((rate > 0) & ~F.isnan(rate), F.greatest(F.lit(0).cast("long"), F.least(us, F.greatest(duration, F.lit(0).cast("long"))))).otherwise(F.lit(0).cast("long"))


def expected_frames(duration: Column, rate: Column) -> Column:
    return F.when((duration > 0) & (rate > 0), F.ceil(duration / F.lit(1e6) * rate)).otherwise(F.lit(0).cast("long"))


def _padded(x: Column, n: Column | int = 2) -> Column:
    text = x.cast("string")
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.repeat(F.lit("0"), F.greatest(n - F.length(text), F.lit(0))), text)


def format_duration(us: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.greatest(F.lit(0).cast("long"), F.floor(us / F.lit(1000.0) + 0.5))
    s = F.floor(ms / 1000)
    return F.concat(_padded(F.floor(s / 3600)), F.lit(":"), _padded(F.floor(s / 60) % 60), F.lit(":"), _padded(s % 60), F.lit("."), _padded(ms % 1000, 3))


def format_frame(frame: Column, rate: Column) -> Column:
    """HH:MM:SS:FF."""
    fps = nominal_rate(rate)
    total = F.greatest(F.lit(0).cast("long"), frame)
    s = F.floor(total / fps)
    digits = F.greatest(F.lit(2), F.length((fps - 1).cast("string")))
    return F.concat(_padded(F.floor(s / 3600)), F.lit(":"), _padded(F.floor(s / 60) % 60), F.lit(":"), _padded(s % 60), F.lit(":"), _padded(total % fps, digits))


def format_time(us: Column, rate: Column) -> Column:
    return format_frame(us_to_frame(us, rate), rate)


def parse_frame(text: Column, rate: Column) -> Column:
    """The frame of HH:MM:SS:FF, null if malformed or out of range."""
    value = F.trim(text)
    fields = [F.regexp_extract(value, r"^(\d{1,2}):(\d{2}):(\d{2}):(\d{2,3})$", k).try_cast("long") for k in range(1, 5)]
    fps = nominal_rate(rate)
    fine = fields[0].isNotNull() & (fields[1] <= 59) & (fields[2] <= 59) & (fields[3] < fps)
    return F.when(fine, ((fields[0] * 60 + fields[1]) * 60 + fields[2]) * fps + fields[3])


def parse_rate(text: Column) -> Column:
    """J9: 'a/b' or a number, null unless above zero."""
    value = F.trim(text)
    parts = F.split(value, "/")
    top, low = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ratio = F.when((F.size(parts) == 2) & (low > 0), top / low)
    rate = F.when(F.contains(value, F.lit("/")), ratio).otherwise(value.try_cast("double"))
    return F.when((rate > 0) & (rate < float("inf")), rate)


def first_rate(*texts: Column, default: float = SHOWN_RATE) -> Column:
    found = F.coalesce(*[parse_rate(t) for t in texts])
    return F.when(found.isNull(), F.lit(default)).otherwise(F.least(F.greatest(found, F.lit(1.0)), F.lit(240.0)))


def time_range(start: Column, end: Column, rate: Column) -> Column:
    """Two timecodes without colons."""
    return F.concat_ws("-", *[F.replace(format_time(x, rate), F.lit(":")) for x in (start, end)])


def progress_us(line: Column) -> Column:
    """out_time_us= and out_time_ms= are both microseconds, out_time= is H:M:S; else null."""
    plain = F.trim(F.regexp_extract(line, r"^out_time_[um]s=(.*)$", 1)).try_cast("long")
    clock = F.split(F.trim(F.regexp_extract(line, r"^out_time=(.*)$", 1)), ":")
    h, m, s = F.get(clock, F.lit(0)).try_cast("long"), F.get(clock, F.lit(1)).try_cast("long"), F.get(clock, F.lit(2)).try_cast("double")
    timed = F.when((F.size(clock) == 3) & (h >= 0) & (m >= 0) & (s >= 0), F.round((h * 3600 + m * 60 + s) * F.lit(1e6)).cast("long"))
    return F.when(F.regexp_like(line, F.lit("^out_time_[um]s=")), plain).when(F.startswith(line, F.lit("out_time=")), timed)


def clamp_range(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Both within the duration; an end of zero or less means its end."""
    zero = F.lit(0).cast("long")
    most = F.greatest(duration, zero)
    first = F.least(F.greatest(start, zero), most)
    last = F.least(F.greatest(F.when(end <= 0, most).otherwise(end), zero), most)
    return first, F.greatest(first, last)


def short_timecode(code: Column) -> Column:
    """Without leading fields of zero, the first field unpadded."""
    rest = F.regexp_replace(code, r"^(?:0+:)+", "")
    return F.when(F.regexp_like(code, F.lit(r"^[0:]*$")), F.regexp_extract(code, r"([^:]*)$", 1)).otherwise(F.regexp_replace(rest, r"^0+(?=[1-9])", ""))


def bucket(us: Column, duration: Column, width: int = 100_000) -> Column:
    """The nearest bucket of a time held within the duration less a millisecond."""
    held = F.least(F.greatest(us, F.lit(0).cast("long")), F.greatest(duration - 1000, F.lit(0).cast("long")))
    return F.floor((held + width // 2) / width)


def bucket_us(number: Column, duration: Column, width: int = 100_000) -> Column:
    return F.least(F.greatest(number, F.lit(0).cast("long")) * width, F.greatest(duration - 1000, F.lit(0).cast("long")))
