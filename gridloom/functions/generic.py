"""Generic column expressions: time, packing, quantising, colour, bins and ticks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low, high) -> Column:
    """x between low and high; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(lit(low), F.least(lit(high), x)))


def iso_to_epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO date or date and time in UTC; a missing time is midnight; else null."""
    t = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")))
    return F.unix_timestamp(t)


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def long_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "MMMM dd, yyyy, HH'h UTC'")


def day_hour(seconds: Column) -> Column:
    """'Day dd  Hour hh' of elapsed seconds, with floor division for negative times."""
    day = F.floor(seconds / F.lit(86400))
    hour = F.floor(F.pmod(seconds, F.lit(86400)) / F.lit(3600))
    return F.concat(F.lit("Day "), F.when(day.between(-9, -1), F.concat(F.lit("-"), F.abs(day))).otherwise(F.lpad(day.cast("string"), 2, "0")), F.lit("  Hour "), F.lpad(hour.cast("string"), 2, "0"))


def hours_1950_to_epoch(hours: Column) -> Column:
    """Hours since 1950-01-01 to seconds since 1970, truncated."""
    return (hours * 3600).cast("long") - 631_152_000


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def unpack_cf(raw: Column, scale: float, offset: float, fill: float, mode: str = "zero") -> Column:
    """Packed value to physical value. mode zero: fill and absurd values are 0; null: they are null (relative
    tolerance 1e-4); exact: only the fill value itself is null."""
    value = raw * scale + offset
    if mode == "zero":
        return F.when((F.abs(raw - fill) < 1e-5) | (F.abs(raw) > 1e30), F.lit(0.0)).otherwise(value)
    bad = raw == fill if mode == "exact" else F.abs(raw - fill) < 1e-4 * max(1.0, abs(fill))
    return F.when(~bad, value)


def wrap_degrees(d: Column) -> Column:
    """To within 180 degrees of 0, by the nearest multiple of 360."""
    return d - F.lit(360.0) * F.round(d / 360.0)


def unwrap_longitude(lon: Column, near: Column) -> Column:
    """The longitude equal to lon that lies within 180 degrees of near (distance 180 stays as it is)."""
    d = lon - near
    return F.when(d > 180.0, lon - F.lit(360.0) * F.ceil((d - 180.0) / 360.0)).when(d < -180.0, lon + F.lit(360.0) * F.ceil((-d - 180.0) / 360.0)).otherwise(lon)


def to_0_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def nearest_cell(x: Column) -> Column:
    """(int)(x + 0.5): truncation, so half up for positive values."""
    return (x + 0.5).cast("int")


def pack_cell(x: Column, y: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long"))


def cell_of(key: Column) -> tuple[Column, Column]:
    return key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright(key, 32).cast("int")


def cell_index(x: Column, y: Column, size_y: int) -> Column:
    return x.cast("long") * size_y + y


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit).cast("long")) != 0


def partition_id(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(0xFFFF).cast("long"))


def rgb(flags: Column) -> Column:
    byte = lambda n: F.shiftright(flags, n).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return F.struct(byte(24).alias("r"), byte(32).alias("g"), byte(40).alias("b"))


def quantise_truncated(x: Column) -> Column:
    """[0, 1] to a byte by truncation."""
    return (x * 255.0).cast("int")


def quantise_rounded(x: Column) -> Column:
    """[0, 1] clipped, to a byte by rounding."""
    return F.rint(clamp(x, 0.0, 1.0) * 255.0).cast("int")


def normalise(x: Column, low, high) -> Column:
    return (x - lit(low)) / F.nullif(lit(high) - lit(low), F.lit(0.0))


def byte_to_range(x: Column, low: float, high: float, noise: Column | None = None) -> Column:
    """A byte mapped linearly to [low, high], with noise, clamped."""
    y = low + (high - low) * x / 255.0
    return clamp(y + noise if noise is not None else y, low, high)


def _channel(a: Column, b: Column, t: Column) -> Column:
    return (a + (b - a) * t).cast("int")


def palette_colour(palette: list[tuple[int, int, int]], value: Column) -> Column:
    """Colour of value in [0, 1] on a ramp: clamped, linear between neighbours, truncated to bytes."""
    n = len(palette) - 1
    pos = clamp(value, 0.0, 1.0) * n
    i = F.least(pos.cast("int"), F.lit(max(n - 1, 0)))
    t = pos - i
    out = []
    for k, name in enumerate("rgb"):
        ramp = F.array(*[F.lit(c[k]) for c in palette])
        out.append(_channel(F.element_at(ramp, i + 1), F.element_at(ramp, F.least(i + 2, F.lit(n + 1))), t).alias(name))
    return F.struct(*out)


def merge_colours(a: Column, b: Column, alpha: Column) -> Column:
    t = clamp(alpha, 0.0, 1.0)
    return F.struct(*[_channel(a[c], b[c], t).alias(c) for c in "rgb"])


def bearing_from(vx: Column, vy: Column) -> Column:
    """Direction a vector comes from, degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(-vx, -vy)), F.lit(360.0))


def direction_bin(bearing: Column, bins: int = 16) -> Column:
    return F.pmod(F.floor(bearing / (360.0 / bins) + 0.5), F.lit(bins)).cast("int")


# Steps of a graticule, in degrees.
STEPS = (1 / 60, 2 / 60, 5 / 60, 10 / 60, 15 / 60, 20 / 60, 30 / 60, 1, 2, 3, 4, 5, 10, 15, 20, 30)


def graticule_step(span: float, lines: int = 6) -> float:
    """The step nearest to span / lines, the smaller of equals."""
    return sorted(STEPS, key=lambda c: (abs(c * lines - span), c))[0]


def graticule(low: float, high: float, step: float) -> list[float]:
    """The multiples of step from low to high, ends included up to rounding."""
    k = math.ceil(low / step - 1e-9)
    out = []
    while k * step <= high + 1e-9:
        out.append(round(k * step, 10))
        k += 1
    return out


def degree_label(value: float, step: float, positive: str, negative: str) -> str:
    """Whole degrees, or degrees and arc minutes where the step is under a degree; the side instead of a sign."""
    side = negative if value < 0 else positive
    if step > 1 - 1e-9:
        return f"{abs(value):g}°{side}"
    degrees, minutes = divmod(round(abs(value) * 60), 60)
    return f"{degrees}°{minutes:02d}'{side}" if degrees else f"{minutes}'{side}"


def linspace(low: float, high: float, n: int) -> Column:
    """Array of n values from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) + (F.lit(high) - F.lit(low)) * k / F.lit(float(max(n - 1, 1))))


def parse_braces(text: Column) -> Column:
    """'{{a,b},{c,d}}' to an array of arrays of doubles."""
    return F.from_json(F.translate(text, "{}", "[]"), "array<array<double>>")


def parse_state_line(line: Column) -> Column:
    """A settings line of 4 tokens (name, on, from, to), else of 3 (name, from, to); comments are null."""
    t = F.split(F.trim(line), r"\s+")
    four = F.size(t) == 4
    at = lambda k: F.get(t, F.lit(k))
    row = F.struct(at(0).alias("name"), F.when(four, at(1)).otherwise(F.lit("1")).cast("int").alias("enabled"), F.when(four, at(2)).otherwise(at(1)).cast("double").alias("low"), F.when(four, at(3)).otherwise(at(2)).cast("double").alias("high"))
    return F.when(~F.trim(line).startswith("#") & (F.size(t) >= 3), row)
