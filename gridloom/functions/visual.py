"""Numeric part of raster rendering: default ranges, fractions, opacity and colours by variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generic import clamp, merge_colours, normalise, palette_colour

# Default range of each variable's colour scale.
RANGES = {
    "jpinv": (-0.1, 0.1),
    "p": (-562341.3, 562341.3),
    "q": (0.0, 562341.3),
    "mass": (0.0, 5623.4),
    "pts_density": (0.0, 1.0),
    "speed": (0.0, 1.0),
    "strain_vm": (0.0, 0.001),
    "strain_eqv": (0.0, 0.001),
    "thickness": (0.7, 4.0),
    "ice_strength": (0.0, 1.76e6),
    "gamma_p": (0.0, 1.0),
    "jp_inv_max": (1.0, 2.0),
    "wind": (0.0, 17.78),
    "current": (0.0, 0.56),
    "temperature": (-25.0, 10.0),
    "ocean_thickness": (0.0, 3.0),
}


def fraction(name: str, value: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """0 at the range's low end, 1 at its high end; not clamped, as the colour scale does that."""
    low, high = (RANGES | (ranges or {}))[name]
    return normalise(value, low, high)


def opacity(density: Column, full: float = 1.0) -> Column:
    """Opacity of a cell by the density of its points."""
    return clamp(density / full, 0.0, 1.0)


def dilation_fade(j: Column) -> Column:
    """Fades out as the material thins: 0 at 0.75, 1 at 1."""
    return clamp((j - 0.75) / 0.25, 0.0, 1.0)


def compose(cells: DataFrame, name: str, value: Column, palette: list[tuple[int, int, int]], density: Column, background: tuple[int, int, int] = (255, 255, 255), ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """cells with frac, alpha and rgb: the scale's colour blended over the background by opacity."""
    ground = F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", background, strict=True)])
    out = cells.withColumn("frac", fraction(name, value, ranges)).withColumn("alpha", opacity(density))
    return out.withColumn("rgb", merge_colours(ground, palette_colour(palette, F.col("frac")), F.col("alpha")))


def recolour(cells: DataFrame, region: str, modelled: tuple[int, int, int] = (100, 150, 200)) -> DataFrame:
    """Modelled and open cells get one colour, others keep theirs."""
    colour = F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", modelled, strict=True)])
    return cells.withColumn("rgb", F.when(F.col(region) > 0, colour).otherwise(F.col("rgb")))


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)
