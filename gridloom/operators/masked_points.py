"""Poisson-disk points inside a mask that is a table, of any shape and any number of components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

LEVELS = 40
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _close(d: DataFrame, points: DataFrame, radius: float, which: Column) -> DataFrame:
    """Keys (i, j) of rows of d that a point meets `which` with; points are (i2, j2, x2, y2, rank2), binned by the radius."""
    bins = lambda x, y: [F.floor(F.col(x) / radius).alias("bx"), F.floor(F.col(y) / radius).alias("by")]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])).alias("s")
    e = points.select("*", *bins("x2", "y2"), around).withColumns({"bx": F.col("bx") + F.col("s.i"), "by": F.col("by") + F.col("s.j")}).drop("s")
    return d.select("*", *bins("px", "py")).join(e, ["bx", "by"]).filter(which).select("i", "j").distinct()


def _as_points(c: DataFrame) -> DataFrame:
    return c.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("px").alias("x2"), F.col("py").alias("y2"), F.col("rank").alias("rank2"))


def _thinned(c: DataFrame, radius: float) -> DataFrame | None:
    """A maximal set of candidates no two of which are within the radius: those of least rank among their neighbours stay,
    what is near them goes, until none is in play."""
    dx, dy = F.col("px") - F.col("x2"), F.col("py") - F.col("y2")
    near = dx * dx + dy * dy < radius * radius
    before = F.expr("(i2 <> i OR j2 <> j) AND struct(rank2, i2, j2) < struct(rank, i, j)")
    stay = None
    while not c.isEmpty():
        won = cut(c.join(_close(c, _as_points(c), radius, near & before), ["i", "j"], "left_anti"))
        stay = won if stay is None else stay.unionByName(won)
        c = cut(c.join(_close(c, _as_points(won), radius, near), ["i", "j"], "left_anti"))
    return stay


def masked_poisson_disk(cells: DataFrame, radius: float, seed: int = 0, candidates: int = 4) -> DataFrame:
    """Points (x, y) inside good cells, no two within the radius, and every place of every good cell within it of one.

    cells (x, y; others are ignored) are the good ones: cell (x, y) is the square around it with sides of 1. Where
    they lie and whether they hang together does not matter. The cells are the first squares of a quadtree: a square leaves
    when one disk covers it; of those left, `candidates` a bin of the radius' size play a random place each,
    thinned to a maximal set; what is still uncovered is cut into four. No square is left at the end, so the set is
    maximal without a bound on rounds; squares grow few as the gaps close, and outside the mask there are none.

    Cells without x or y are left out, repeated ones count once, an empty table gives no points. The same seed gives
    the same points at any partitioning.
    """
    if radius <= 0:
        raise ValueError("the radius is above 0")
    parts = max(1, math.ceil(1 / radius))
    steps = F.explode(F.sequence(F.lit(0), F.lit(parts * parts - 1))).alias("k")
    squares = cells.select(F.col("x").cast("long"), F.col("y").cast("long")).dropna().distinct().select("x", "y", steps)
    squares = cut(squares.select((F.col("x") * parts + F.col("k") % parts).alias("i"), (F.col("y") * parts + F.floor(F.col("k") / parts)).alias("j")))
    side, stay = 1.0 / parts, None
    dx, dy = F.col("px") - F.col("x2"), F.col("py") - F.col("y2")
    half = lambda d: F.abs(d) + side / 2
    for level in range(LEVELS):
        if squares.isEmpty():
            break
        u = lambda k: F.pmod(F.xxhash64("i", "j", F.lit(level), F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
        c = squares.select("i", "j", ((F.col("i") + u(1)) * side).alias("px"), ((F.col("j") + u(2)) * side).alias("py"), F.xxhash64("i", "j", F.lit(level), F.lit(seed), F.lit(3)).alias("rank"))
        if stay is not None:
            c = c.join(_close(c, _as_points(stay), radius, dx * dx + dy * dy < radius * radius), ["i", "j"], "left_anti")
        few = c.groupBy(F.floor(F.col("px") / radius), F.floor(F.col("py") / radius), F.pmod("rank", F.lit(candidates))).agg(F.min(F.struct("rank", "i", "j", "px", "py")).alias("m"))
        new = _thinned(cut(few.select("m.*")), radius)
        if new is not None:
            stay = cut(new if stay is None else stay.unionByName(new))
        middle = squares.withColumns({"px": (F.col("i") + 0.5) * side, "py": (F.col("j") + 0.5) * side})
        covered = _close(middle, _as_points(stay), radius, half(dx) * half(dx) + half(dy) * half(dy) < radius * radius)
        quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
        left = squares.join(covered, ["i", "j"], "left_anti").select("i", "j", quarter)
        squares = cut(left.select((F.col("i") * 2 + F.col("k") % 2).alias("i"), (F.col("j") * 2 + F.floor(F.col("k") / 2)).alias("j")))
        side /= 2
    else:
        raise RuntimeError(f"gaps are left at a side of {side}")
    if stay is None:
        return squares.select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return stay.select((F.col("px") - 0.5).alias("x"), (F.col("py") - 0.5).alias("y"))
