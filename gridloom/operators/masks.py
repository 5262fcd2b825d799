"""Masks, flags, regions and extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.generic import has


def layer(raster: DataFrame, flag: int, threshold: int = 128, invert: bool = False, red: str = "r") -> DataFrame:
    """(x, y, flags): the flag where the red channel is under the threshold (not under it if invert)."""
    hit = (F.col(red) < threshold) != F.lit(invert)
    return raster.select("x", "y", F.when(hit, F.lit(flag)).otherwise(F.lit(0)).alias("flags"))


def merge_layers(layers: Sequence[DataFrame]) -> DataFrame:
    both = layers[0]
    for d in layers[1:]:
        both = both.unionByName(d)
    return both.groupBy("x", "y").agg(F.bit_or("flags").alias("flags"))


def region(flags: Column) -> Column:
    """Open boundary before water before land."""
    return F.when(has(flags, S.MASK_OPEN), F.lit(S.REGION_OPEN)).when(has(flags, S.WATER), F.lit(S.REGION_MODELLED)).otherwise(F.lit(S.REGION_LAND))


def status(flags: Column) -> Column:
    return F.when(has(flags, S.DISABLED), "disabled").when(has(flags, S.CRUSH), "crushed").when(has(flags, S.CRACKED), "cracked").otherwise("intact")


def enabled(points: DataFrame) -> DataFrame:
    return points.filter(~has(F.col("flags"), S.DISABLED))


def candidate_points(points: DataFrame, mask: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """Points in inner cells whose mask is water and ice and not open boundary."""
    good = mask.filter(has(F.col("flags"), S.WATER) & has(F.col("flags"), S.ICE) & ~has(F.col("flags"), S.MASK_OPEN))
    inner = points.filter((F.col("cell_x") > 1) & (F.col("cell_x") < size_x - 2) & (F.col("cell_y") > 1) & (F.col("cell_y") < size_y - 2))
    return inner.join(good.select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y")), ["cell_x", "cell_y"], "left_semi")


def masked(cells: DataFrame, mask: DataFrame, on: Sequence[str] = ("i", "j")) -> DataFrame:
    return cells.join(mask.select(*on).distinct(), list(on), "left_semi")


def analysis_cells(mask: DataFrame) -> DataFrame:
    return mask.filter(has(F.col("flags"), S.MASK_ANALYSIS)).select(F.col("x").alias("i"), F.col("y").alias("j"))


def has_any(mask: DataFrame, flag: int) -> DataFrame:
    return mask.agg(F.coalesce(F.bool_or(has(F.col("flags"), flag)), F.lit(False)).alias("found"))


def bounding_box(mask: DataFrame, which: Column, pad: int = 2, size: tuple[int, int] | None = None, required: bool = True) -> DataFrame:
    """(x0, x1, y0, y1) of the cells where `which` holds, padded and clamped to size; empty fails or is all 0."""
    some = F.count("*") > 0
    low = lambda c: F.when(some, F.greatest(F.min(c) - pad, F.lit(0)))
    high = lambda c, n: F.when(some, F.least(F.max(c) + pad, F.lit(n - 1)) if n else F.max(c) + pad)
    nx, ny = size or (0, 0)
    out = mask.filter(which).agg(low("x").alias("x0"), high("x", nx).alias("x1"), low("y").alias("y0"), high("y", ny).alias("y1"))
    empty = F.raise_error(F.lit("no cell has the flag")).cast("int") if required else F.lit(0)
    return out.select(*[F.coalesce(F.col(c), empty).alias(c) for c in out.columns])


def ice_region(mask: DataFrame) -> DataFrame:
    f = F.col("flags")
    return bounding_box(mask, has(f, S.ICE) & has(f, S.WATER) & ~has(f, S.MASK_OPEN), pad=0, required=False)


def coverage(mask: DataFrame, cell_area: float, points: int) -> DataFrame:
    """Ice cells, points a cell and area a point."""
    n = F.count_if(has(F.col("flags"), S.ICE) & has(F.col("flags"), S.WATER) & ~has(F.col("flags"), S.MASK_OPEN))
    return mask.agg(n.alias("ice_cells"), (F.lit(float(points)) / F.nullif(n, F.lit(0))).alias("points_a_cell"), (n * cell_area / float(max(points, 1))).alias("area_a_point"))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def verify_points(points: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """The points unchanged; fails at run time on a position or cell out of bounds or a value that is not finite."""
    bad = ~(F.col("posx").between(-0.5, 0.5) & F.col("posy").between(-0.5, 0.5) & F.col("cell_x").between(0, size_x - 1) & F.col("cell_y").between(0, size_y - 1)) | F.isnan("velx") | F.isnan("vely")
    return points.withColumn("flags", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a point is out of bounds")).cast("long")).otherwise(F.col("flags")))


def without(a: DataFrame, b: DataFrame, on: Sequence[str] = ("x", "y")) -> DataFrame:
    """Mask difference: cells of a that b lacks."""
    return a.join(b.select(*on), list(on), "left_anti")


def radius_anti(a: DataFrame, b: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of a without a row of b within the radius: an equi-join on bins of that width and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius)
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ref = b.select(F.col(x).alias("_x"), F.col(y).alias("_y"), (cell(x)).alias("_cx"), cell(y).alias("_cy"))
    ref = ref.withColumn("s", F.explode(shift)).select("_x", "_y", (F.col("_cx") + F.col("s.i")).alias("_cx"), (F.col("_cy") + F.col("s.j")).alias("_cy"))
    near = (F.col(x) - F.col("_x")) * (F.col(x) - F.col("_x")) + (F.col(y) - F.col("_y")) * (F.col(y) - F.col("_y")) <= radius * radius
    left = a.withColumn("_ax", cell(x)).withColumn("_ay", cell(y))
    return left.join(ref, (F.col("_ax") == F.col("_cx")) & (F.col("_ay") == F.col("_cy")) & near, "left_anti").drop("_ax", "_ay")
