"""Report and summary operators: region diagnostics, roses, hexbins, ranges."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generic import bearing_from, direction_bin, epoch_to_iso
from ..functions.physics import drag
from ..params import RHO_AIR, RHO_WATER


def region_diagnostics(cells: DataFrame, mask: DataFrame, wind_drag: float, water_drag: float, start: int = 0, frame_seconds: int = 300) -> DataFrame:
    """One row a frame over the masked cells (i, j): means and maxima of strength and speeds, cracked share, and
    the magnitude of the mass-weighted mean drag vector.

    cells: frame, i, j, mass, vx, vy, ice_strength, cracked, wx, wy, cx, cy. Means divide by all masked cells
    of the mask, also those a frame has no row for; only cells with mass carry drag; maxima start at 0.
    """
    speed = lambda x, y: F.sqrt(x * x + y * y)
    c = cells.join(mask.select("i", "j").distinct(), ["i", "j"], "left_semi")
    v = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("mass", "vx", "vy", "ice_strength", "cracked", "wx", "wy", "cx", "cy")}
    c = c.select("frame", *[e.alias(n) for n, e in v.items()])
    has = F.col("mass") > 0
    air = drag(wind_drag, RHO_AIR, F.col("wx"), F.col("wy"), F.col("vx"), F.col("vy"))
    sea = drag(water_drag, RHO_WATER, F.col("cx"), F.col("cy"), F.col("vx"), F.col("vy"))
    n = F.lit(mask.select("i", "j").distinct().count())
    top = lambda e: F.greatest(F.lit(0.0), F.coalesce(F.max(e), F.lit(0.0)))

    def mean_vector(d):
        sx, sy = F.sum(F.when(has, F.col("mass") * d[0])), F.sum(F.when(has, F.col("mass") * d[1]))
        return F.coalesce(F.sqrt(sx * sx + sy * sy) / F.nullif(F.sum(F.when(has, F.col("mass"))), F.lit(0.0)), F.lit(0.0))

    wind, current, ice = speed(F.col("wx"), F.col("wy")), speed(F.col("cx"), F.col("cy")), speed(F.col("vx"), F.col("vy"))
    out = c.groupBy("frame").agg(
        (F.sum("ice_strength") / n).alias("ice_strength_mean"),
        top(F.col("ice_strength")).alias("ice_strength_max"),
        (F.sum(wind) / n).alias("wind_speed_mean"),
        top(wind).alias("wind_speed_max"),
        (F.sum(current) / n).alias("current_speed_mean"),
        top(current).alias("current_speed_max"),
        (F.sum(ice) / n).alias("ice_speed_mean"),
        top(ice).alias("ice_speed_max"),
        (F.sum("cracked") / n).alias("fractured_fraction"),
        mean_vector(air).alias("wind_drag_mean"),
        top(F.when(has, speed(*air))).alias("wind_drag_max"),
        mean_vector(sea).alias("current_drag_mean"),
        top(F.when(has, speed(*sea))).alias("current_drag_max"),
    )
    epoch = F.lit(start).cast("long") + F.col("frame").cast("long") * frame_seconds
    return out.select("frame", epoch.alias("epoch_utc"), epoch_to_iso(epoch).alias("datetime_utc"), *[x for x in out.columns if x != "frame"])


def grouped_vector_mean(df: DataFrame, by: Sequence[str], mass: str, x: Column, y: Column) -> DataFrame:
    """Magnitude of the mass-weighted mean vector by group."""
    m = F.col(mass)
    sx, sy = F.sum(F.when(m > 0, m * x)), F.sum(F.when(m > 0, m * y))
    return df.groupBy(*by).agg(F.coalesce(F.sqrt(sx * sx + sy * sy) / F.nullif(F.sum(F.when(m > 0, m)), F.lit(0.0)), F.lit(0.0)).alias("mean_vector"))


def rose(df: DataFrame, vx: str, vy: str, edges: Sequence[float], directions: int = 16, calm: float = 1e-6) -> DataFrame:
    """(dir_bin, speed_bin, n, share): counts with zeros filled in; speed bins are split at `edges`.

    Rows slower than `calm` are bin -1 and rows without value bin -2, both outside the total.
    """
    size = F.sqrt(F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy))
    missing = F.col(vx).isNull() | F.col(vy).isNull() | F.isnan(vx) | F.isnan(vy)
    speed_bin = F.lit(0)
    for e in edges:
        speed_bin = speed_bin + F.when(size >= e, 1).otherwise(0)
    d = F.when(missing, -2).when(size < calm, -1).otherwise(direction_bin(bearing_from(F.col(vx), F.col(vy)), directions))
    counts = df.select(d.alias("dir_bin"), F.when(missing | (size < calm), -1).otherwise(speed_bin).alias("speed_bin")).groupBy("dir_bin", "speed_bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(directions * (len(edges) + 1)).select((F.col("id") % directions).cast("int").alias("dir_bin"), F.expr(f"CAST(id DIV {directions} AS INT)").alias("speed_bin"))
    extra = df.sparkSession.createDataFrame([(-1, -1), (-2, -1)], "dir_bin int, speed_bin int")
    out = bins.union(extra).join(counts, ["dir_bin", "speed_bin"], "left").fillna(0, ["n"])
    total = counts.agg(F.sum(F.when(F.col("dir_bin") >= 0, F.col("n"))).alias("total"))
    return out.join(F.broadcast(total)).select("dir_bin", "speed_bin", "n", F.when(F.col("dir_bin") >= 0, F.col("n") / F.nullif("total", F.lit(0))).alias("share"))  # one row


def hexbin(df: DataFrame, x: str, y: str, extent: tuple[float, float, float, float], grid: int = 150, least: int = 1) -> DataFrame:
    """(cx, cy, n, log_n): counts in hexagons, the lattice that is nearer of two staggered ones."""
    x0, x1, y0, y1 = extent
    sx, sy = (x1 - x0) / grid, (y1 - y0) / int(grid / math.sqrt(3))
    u, v = (F.col(x) - x0) / sx, (F.col(y) - y0) / sy
    i1, j1, i2, j2 = F.rint(u), F.rint(v), F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + (v - j1) * (v - j1) * 3
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + (v - j2 - 0.5) * (v - j2 - 0.5) * 3
    first = d1 < d2
    cx, cy = F.when(first, i1).otherwise(i2 + 0.5) * sx + x0, F.when(first, j1).otherwise(j2 + 0.5) * sy + y0
    inside = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    out = inside.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.withColumn("log_n", F.log10("n"))


def histogram2d(df: DataFrame, x: str, y: str, step_x: float, step_y: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / step_x).alias("bx"), F.floor(F.col(y) / step_y).alias("by")).agg(F.count("*").alias("n"))


def value_range(df: DataFrame, modes: Mapping[str, str], fixed: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """(name, low, high) of each variable: diverging (plus and minus the largest size), sequential, or fixed."""
    out = []
    for name, mode in modes.items():
        v = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        if mode == "fixed":
            low, high = ((F.lit(float(b))) for b in (fixed or {})[name])
        elif mode == "diverging":
            high = F.max(F.abs(v))
            low = -high
        else:
            low, high = F.min(v), F.max(v)
        out.append(F.struct(F.lit(name).alias("name"), low.alias("low"), high.alias("high")))
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def statistics(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, median, valid count and coverage in percent; NaN and null are not valid."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.count(v).alias("valid"), (F.avg(v.isNotNull().cast("int")) * 100).alias("coverage"))


def totals(points: DataFrame, area: float) -> DataFrame:
    """Ice volume, mean strength, mean temperature and the recommended step's smallest thickness; empty gives 0."""
    zero = F.lit(0.0)
    return points.agg(F.coalesce(F.sum(F.col("thickness") * area), zero).alias("volume"), F.coalesce(F.avg("xi"), zero).alias("strength_mean"), F.coalesce(F.avg("ts_old"), zero).alias("temperature_mean"), F.coalesce(F.min("thickness"), zero).alias("thickness_min"))


def error_bits(df: DataFrame, checks: Mapping[str, int]) -> DataFrame:
    """Bitwise or of the codes of columns that hold a NaN anywhere."""
    bits = F.lit(0)
    for c, code in checks.items():
        bits = bits.bitwiseOR(F.when(F.isnan(c), F.lit(code)).otherwise(F.lit(0)))
    return df.agg(F.coalesce(F.bit_or(bits), F.lit(0)).alias("errors"))
