"""Raster operators: look-ups, bilinear blends, blur, stencils, quads."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distance import nearest_known

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def regular_lookup(points: DataFrame, raster: DataFrame, lat: str, lon: str, value: Sequence[str], origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int], mode: str = "masked", on: Sequence[str] = (), inclusive: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """Bilinear values of a regular raster (r, c, values) at points, joined on cell keys.

    mode masked: null corners drop out and the other weights are renormalised; strict: any null corner gives null;
    zero: a point outside gives 0; clamped: a point outside takes the nearest edge's value and `outside` is true. `on` joins further keys (a frame); `inclusive` counts a point in the last row
    or column as inside. `key` identifies a point (all columns if not given). The raster is exploded to the four
    points' cells, not searched: the join is an equi-join on (r, c), whatever the sizes.
    """
    y = (F.col(lat) - origin[0]) / step[0]
    x = (F.col(lon) - origin[1]) / step[1]
    rows, cols = shape
    key = list(key) or points.columns
    if mode == "clamped":
        points = points.withColumn("outside", ~(y.between(0, rows - 1) & x.between(0, cols - 1)))
        key, inclusive = [*key, "outside"], True
        y, x = F.greatest(F.lit(0.0), F.least(F.lit(rows - 1.0), y)), F.greatest(F.lit(0.0), F.least(F.lit(cols - 1.0), x))
    r0, c0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    inside = (r0 >= 0) & (c0 >= 0) & ((y <= rows - 1) & (x <= cols - 1) if inclusive else (r0 < rows - 1) & (c0 < cols - 1))
    if inclusive:
        r0, c0 = F.least(r0, F.lit(rows - 2)), F.least(c0, F.lit(cols - 2))
    dr, dc = y - r0, x - c0
    weights = {(0, 0): (1 - dr) * (1 - dc), (0, 1): (1 - dr) * dc, (1, 0): dr * (1 - dc), (1, 1): dr * dc}
    fan = F.when(inside, F.array(*[F.struct((r0 + a).alias("r"), (c0 + b).alias("c"), weights[a, b].alias("w")) for a, b in CORNERS]))
    at = points.withColumn("_k", F.explode_outer(fan)).select("*", "_k.*").drop("_k")
    joined = at.join(raster.select(*on, "r", "c", *[F.col(v).alias(f"_{v}") for v in value]), [*on, "r", "c"], "left")
    out = []
    for v in value:
        good = F.col(f"_{v}").isNotNull()
        total = F.sum(F.when(good, F.col("w") * F.col(f"_{v}")))
        weight = F.sum(F.when(good, F.col("w")))
        blend = total / F.nullif(weight, F.lit(0.0))
        if mode == "strict":
            blend = F.when(F.count_if(good) == 4, total)
        elif mode == "zero":
            blend = F.coalesce(total, F.lit(0.0))
        out.append(blend.alias(v))
    return joined.groupBy(*key).agg(*out)


def box_blur(raster: DataFrame, value: str, out: str, radius: int = 4, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Separable mean over 2 radius + 1 cells each way; at edges over the cells that exist. Needs dense rows."""
    rows = Window.partitionBy(*by, y).orderBy(x).rowsBetween(-radius, radius)
    cols = Window.partitionBy(*by, x).orderBy(y).rowsBetween(-radius, radius)
    return raster.withColumn("_h", F.avg(value).over(rows)).withColumn(out, F.avg("_h").over(cols)).drop("_h")


def densify(df: DataFrame, x: str, y: str, size_x: int, size_y: int, fill: dict[str, float]) -> DataFrame:
    """Every cell of the grid, missing values filled. The grid is generated, so its rows follow its size."""
    spark = df.sparkSession
    grid = spark.range(size_x * size_y).select((F.col("id") / size_y).cast("int").alias(x), (F.col("id") % size_y).cast("int").alias(y))
    return grid.join(df, [x, y], "left").fillna(fill)


def central_difference(df: DataFrame, value: str, x: str = "i", y: str = "j", by: Sequence[str] = ()) -> DataFrame:
    """gx, gy: next minus previous neighbour each way; null at the outermost cells. Needs dense rows."""
    wx = Window.partitionBy(*by, y).orderBy(x)
    wy = Window.partitionBy(*by, x).orderBy(y)
    return df.withColumn("gx", F.lead(value).over(wx) - F.lag(value).over(wx)).withColumn("gy", F.lead(value).over(wy) - F.lag(value).over(wy))


def quads(raster: DataFrame, x: str = "x", y: str = "y", extra: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Quads of a curvilinear raster (r, c, x, y): corners 00, 01, 10, 11 by lead over c and r."""
    body = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *extra)
    right = Window.partitionBy(*by, "r").orderBy("c")
    down = Window.partitionBy(*by, "c").orderBy("r")
    q = raster.select(*by, "r", "c", body.alias("p00"))
    q = q.withColumn("p01", F.lead("p00").over(right)).withColumn("p10", F.lead("p00").over(down))
    return q.withColumn("p11", F.lead("p01").over(down)).filter("p01 IS NOT NULL AND p10 IS NOT NULL AND p11 IS NOT NULL")


def _cross(a: Column, b: Column, px: Column, py: Column) -> Column:
    return (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])


def inside_quad(p00: Column, p01: Column, p10: Column, p11: Column, px: Column, py: Column) -> Column:
    """Whether a point lies in a quad, its boundary included, for either orientation."""
    sides = [_cross(a, b, px, py) for a, b in ((p00, p01), (p01, p11), (p11, p10), (p10, p00))]
    left = _cross(p00, p01, p11["x"], p11["y"]) > 0
    every = lambda f: f(sides[0]) & f(sides[1]) & f(sides[2]) & f(sides[3])
    return F.when(left, every(lambda s: s >= 0)).otherwise(every(lambda s: s <= 0))


def cells_in_quads(q: DataFrame, size_x: int, size_y: int, by: Sequence[str] = (), most: int = 1_000_000) -> DataFrame:
    """(i, j, r, c): the quad of each grid cell, of several the last by (r, c).

    A quad is exploded to the integer cells of its bounding box and tested there, so no pair of a cell and a
    far quad is made. A quad whose box has over `most` cells is taken for a fault of the mesh and fails.
    """
    xs, ys = ([F.col(f"{p}.{a}") for p in ("p00", "p01", "p10", "p11")] for a in "xy")
    lo_i, hi_i = F.greatest(F.lit(0), F.floor(F.least(*xs))).cast("int"), F.least(F.lit(size_x - 1), F.ceil(F.greatest(*xs))).cast("int")
    lo_j, hi_j = F.greatest(F.lit(0), F.floor(F.least(*ys))).cast("int"), F.least(F.lit(size_y - 1), F.ceil(F.greatest(*ys))).cast("int")
    at = q.withColumn("_a", lo_i).withColumn("_b", hi_i).withColumn("_c", lo_j).withColumn("_d", hi_j).filter("_a <= _b AND _c <= _d")
    cells = (F.col("_b") - F.col("_a") + 1).cast("long") * (F.col("_d") - F.col("_c") + 1)
    at = at.withColumn("_b", F.when(cells > most, F.raise_error(F.lit(f"a quad covers over {most} cells")).cast("int")).otherwise(F.col("_b")))
    at = at.withColumn("i", F.explode(F.sequence("_a", "_b"))).withColumn("j", F.explode(F.sequence("_c", "_d")))
    hit = at.filter(inside_quad(F.col("p00"), F.col("p01"), F.col("p10"), F.col("p11"), F.col("i").cast("double"), F.col("j").cast("double")))
    return hit.groupBy(*by, "i", "j").agg(F.max(F.struct("r", "c")).alias("_q")).select(*by, "i", "j", "_q.r", "_q.c")


def inverse_bilinear(p00: Column, p01: Column, p10: Column, p11: Column, px: Column, py: Column, steps: int = 8) -> Column:
    """(s, t) of a point in a quad by Newton's method from the middle, clamped to [0, 1]."""

    def blend(a, s, t):
        return p00[a] * (1 - s) * (1 - t) + p01[a] * s * (1 - t) + p10[a] * (1 - s) * t + p11[a] * s * t

    def step(st, _):
        s, t = st["s"], st["t"]
        rx, ry = px - blend("x", s, t), py - blend("y", s, t)
        sx, sy = ((p01[a] - p00[a]) * (1 - t) + (p11[a] - p10[a]) * t for a in "xy")
        tx, ty = ((p10[a] - p00[a]) * (1 - s) + (p11[a] - p01[a]) * s for a in "xy")
        det = F.nullif(sx * ty - tx * sy, F.lit(0.0))
        done = (rx * rx + ry * ry < 1e-10) | det.isNull()
        return F.struct(F.when(done, s).otherwise(s + (ty * rx - tx * ry) / det).alias("s"), F.when(done, t).otherwise(t + (sx * ry - sy * rx) / det).alias("t"))

    start = F.struct(F.lit(0.5).alias("s"), F.lit(0.5).alias("t"))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda st: F.struct(clip(st["s"]).alias("s"), clip(st["t"]).alias("t")))


def bilinear(v00: Column, v01: Column, v10: Column, v11: Column, s: Column, t: Column) -> Column:
    return v00 * (1 - s) * (1 - t) + v01 * s * (1 - t) + v10 * (1 - s) * t + v11 * s * t


def nearest_lonlat(cells: DataFrame, lat: float, lon: float) -> DataFrame:
    """The one cell (r, c, lat, lon) nearest in unweighted degrees, longitude wrapped; the first of equals."""
    d = F.col("lon") - lon
    d = d - F.lit(360.0) * F.round(d / 360.0)
    d2 = (F.col("lat") - lat) * (F.col("lat") - lat) + d * d
    return cells.agg(F.min(F.struct(d2.alias("d2"), "r", "c", "lat", "lon")).alias("m")).select("m.*")


def add_rasters(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Elementwise sum on equal index keys; a cell missing in b adds 0."""
    other = b.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return a.join(other, list(keys), "left").select(*keys, *[(F.coalesce(F.col(v), F.lit(0.0)) + F.coalesce(F.col(f"_{v}"), F.lit(0.0))).alias(v) for v in values])


def snapped(df: DataFrame, coordinate: str, index: str, origin: float, step: float) -> DataFrame:
    """Adds the integer index of a coordinate that is nearly a multiple of step from origin; half a step off fails."""
    at = (F.col(coordinate) - origin) / step
    off = F.abs(at - F.round(at)) > 0.25
    return df.withColumn(index, F.when(off, F.raise_error(F.lit(f"{coordinate} is not on the grid")).cast("int")).otherwise(F.round(at).cast("int")))


def mean_over(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of a value over the other axes (depth); nulls and NaN don't count, and all of them give null."""
    return df.groupBy(*by).agg(F.avg(F.when(~F.isnan(F.col(value)), F.col(value))).alias(value))


def with_missing(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Absent variables are added as 0, nulls become 0."""
    for v in values:
        df = df.withColumn(v, F.coalesce(F.col(v), F.lit(0.0)) if v in df.columns else F.lit(0.0))
    return df


def resample_nearest(raster: DataFrame, source: tuple[int, int], target: tuple[int, int], value: str) -> DataFrame:
    """Nearest-neighbour resample: target cell (x, y) takes source cell (trunc(x sx), trunc(y sy))."""
    sw, sh = source
    tw, th = target
    grid = raster.sparkSession.range(tw * th).select((F.col("id") % tw).cast("int").alias("tx"), (F.col("id") / tw).cast("int").alias("ty"))
    grid = grid.withColumn("x", (F.col("tx") * (sw / tw)).cast("int")).withColumn("y", (F.col("ty") * (sh / th)).cast("int"))
    return grid.join(raster.select("x", "y", value), ["x", "y"], "left").select(F.col("tx").alias("x"), F.col("ty").alias("y"), value)


def fill_nearest(cells: DataFrame, value: str, radius: int, tile: int = 512) -> DataFrame:
    """Null cells take the value of the nearest cell with one, at most `radius` away; ties to the least (x, y).

    See `nearest_known`: an exact distance transform, so the radius may be large.
    """
    filled = nearest_known(cells, value, radius, tile).select("x", "y", F.col("v").alias("_v"))
    return cells.join(filled, ["x", "y"], "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def crop(raster: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    inside = raster.filter(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def camera_crop(x: Column, y: Column, half_height: Column, cell: float, aspect: float = 16 / 9) -> Column:
    """Struct (x0, y0, width, height): the smallest 16:9 rectangle of cells, in whole 16 x 9 steps, about a camera's view.

    x, y: the point looked at; half_height: half of the visible height, in the units of `cell`; steps are rounded to the nearest.
    """
    rows = half_height * 2 / cell
    k = F.greatest(F.round(rows / 9), F.round(rows * aspect / 16), F.lit(1.0)).cast("int")
    x0 = F.round(x / cell).cast("int") - k * 8
    y0 = F.round(y / cell).cast("int") - F.floor(k * 9 / 2).cast("int")
    return F.struct(x0.alias("x0"), y0.alias("y0"), (k * 16).alias("width"), (k * 9).alias("height"))


def resize(raster: DataFrame, source: tuple[int, int], target: tuple[int, int], value: str, lobes: int = 3) -> DataFrame:
    """Windowed-sinc resize of a dense raster (x, y, value), one axis after the other; shrinking widens the window.

    Weights are normalised over the taps inside the raster; cells without row or value count as missing and
    leave the weights to the others, and a target cell without any tap has no row.
    """
    for axis, other, have, want in (("x", "y", source[0], target[0]), ("y", "x", source[1], target[1])):
        step = have / want
        reach = lobes * max(step, 1.0)
        mid = (F.col("_to") + 0.5) * step
        low, high = F.greatest(F.lit(0), F.floor(mid - reach + 0.5)), F.least(F.lit(have), F.floor(mid + reach + 0.5)) - 1
        taps = raster.sparkSession.range(want).select(F.col("id").cast("int").alias("_to"))
        taps = taps.select("_to", mid.alias("_mid"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias(axis))
        u = (F.col(axis) + 0.5 - F.col("_mid")) / max(step, 1.0)
        pu = u * math.pi
        weight = F.when(F.abs(u) < 1e-12, F.lit(1.0)).when(F.abs(u) < lobes, F.sin(pu) * F.sin(pu / lobes) * lobes / (pu * pu)).otherwise(F.lit(0.0))
        taps = taps.select("_to", axis, weight.alias("_w"))
        w = F.when(F.col(value).isNotNull(), F.col("_w"))
        out = raster.select("x", "y", value).join(taps, axis).groupBy("_to", other).agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))
        raster = out.select(F.col("_to").alias(axis), other, value)
    return raster.select("x", "y", value)
