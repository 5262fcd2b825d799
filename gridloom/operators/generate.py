"""Generators: tiles, curves, random fields and points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import geo
from ..functions.generic import byte_to_range, clamp, graticule, nearest_cell
from ..params import Projection
from .lineage import cut


def tiles(spark: SparkSession, width: int, height: int, size: int) -> DataFrame:
    """(tx, ty, x0, y0, x1, y1) of a raster cut into tiles."""
    nx, ny = math.ceil(width / size), math.ceil(height / size)
    t = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("tx"), F.expr(f"CAST(id DIV {nx} AS INT)").alias("ty"))
    return t.select("tx", "ty", (F.col("tx") * size).alias("x0"), (F.col("ty") * size).alias("y0"), F.least((F.col("tx") + 1) * size, F.lit(width)).alias("x1"), F.least((F.col("ty") + 1) * size, F.lit(height)).alias("y1"))


def mosaic_extent(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The box around all boxes, by mosaic if `by` names columns, and the finest resolution."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("resolution").alias("resolution"))


def poisson_disk(spark: SparkSession, radius: float, width: float = 1.0, height: float = 1.0, seed: int = 0, candidates: int = 4, rounds: int = 4, keep: Column | None = None) -> DataFrame:
    """Points (x, y) no two of which are within the radius, and none could be added, by thinning.

    Candidates are hashed into cells; a candidate stays if its random priority is the least among the
    candidates within the radius that are still in play and none that stayed is within it, until none is in play
    (a maximal independent set, each step one binned equi-join). Then the squares that no single disk covers are cut
    into 16, those still uncovered get a fresh candidate each, and so on until no square is left; statistically
    like sequential dart throwing until nothing fits. With `keep`, where squares may never be covered, at
    most `rounds` times.
    """
    nx, ny = math.ceil(width / radius), math.ceil(height / radius)
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40))
    inside = lambda d: d.filter((F.col("x") < width) & (F.col("y") < height) & (F.lit(True) if keep is None else keep))
    cell = F.expr(f"id DIV {candidates}")
    c = inside(spark.range(nx * ny * candidates).select("id", ((cell % nx + u(1)) * radius).alias("x"), ((F.floor(cell / nx) + u(2)) * radius).alias("y"), u(3).alias("rank")))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    binned = lambda d: d.withColumn("bx", F.floor(F.col("x") / radius)).withColumn("by", F.floor(F.col("y") / radius))

    def near(d, e, extra):
        e = binned(e).withColumn("s", F.explode(around)).select((F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by") + F.col("s.j")).alias("by"), F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("rank").alias("rank2"))
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        return binned(d).join(e, ["bx", "by"]).filter((dx * dx + dy * dy < radius * radius) & extra).select("id").distinct()

    def thinned(c, stay):
        while not c.isEmpty():
            beaten = near(c, c, (F.col("id") != F.col("id2")) & ((F.col("rank2") < F.col("rank")) | ((F.col("rank2") == F.col("rank")) & (F.col("id2") < F.col("id")))))
            won = cut(c.join(beaten, "id", "left_anti"))
            stay = won if stay is None else stay.union(won)
            c = c.join(won.select("id"), "id", "left_anti")
            c = cut(c.join(near(c, won, F.lit(True)), "id", "left_anti"))
        return stay if stay is None else cut(stay)

    stay = thinned(c, None)
    if stay is None:
        return c.select("id", "x", "y")
    squares = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.expr(f"id DIV {nx}").alias("j"))
    begin, parts, level = nx * ny * candidates, 1, 0
    while (keep is None or level < rounds) and begin + nx * ny * (4 * parts) ** 2 < 1 << 62:
        parts, level = 4 * parts, level + 1
        side = radius / parts
        squares = squares.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).select((F.col("i") * 4 + F.col("k") % 4).alias("i"), (F.col("j") * 4 + F.floor(F.col("k") / 4)).alias("j"))
        squares = squares.filter((F.col("i") * side < width) & (F.col("j") * side < height)).select("i", "j", (F.col("j") * (nx * parts) + F.col("i") + begin).alias("id"), ((F.col("i") + 0.5) * side).alias("x"), ((F.col("j") + 0.5) * side).alias("y"))
        far = lambda b, k, end: F.greatest(F.abs(F.col(k) * side - F.col(b)), F.abs(F.least((F.col(k) + 1) * side, F.lit(end)) - F.col(b)))
        dx, dy = far("x2", "i", width), far("y2", "j", height)
        squares = cut(squares.join(near(squares, stay, dx * dx + dy * dy < radius * radius), "id", "left_anti"))
        if squares.isEmpty():
            break
        begin += nx * ny * parts * parts
        c = inside(squares.select("id", ((F.col("i") + u(1)) * side).alias("x"), ((F.col("j") + u(2)) * side).alias("y"), u(3).alias("rank")))
        stay = thinned(cut(c.join(near(c, stay, F.lit(True)), "id", "left_anti")), stay)
    return stay.select("id", "x", "y")


def sample_radius(points_a_cell: float, size_x: int) -> float:
    return math.sqrt(0.6 / (points_a_cell * size_x * size_x))


def random_thickness(cells: DataFrame, low: float, high: float, seed: int = 0) -> DataFrame:
    """Thickness from a normal byte field (mean 127.5, deviation 63.75), clipped and mapped to [low, high]."""
    return cells.withColumn("thickness", byte_to_range(clamp(F.randn(seed) * 63.75 + 127.5, 0.0, 255.0).cast("int"), low, high))


def populate_points(samples: DataFrame, mask: DataFrame, thickness: DataFrame, p: Projection, size_x: int, size_y: int, colours: DataFrame | None = None) -> DataFrame:
    """Point rows from unit-box samples (id, x, y): cell, position, thickness, distortion and flags.

    Cells are the nearest ones; samples outside water and ice are dropped by an equi-join on the cell.
    """
    gx, gy = F.col("x") * size_x, F.col("y") * size_x
    s = samples.withColumn("cell_x", nearest_cell(gx)).withColumn("cell_y", nearest_cell(gy)).withColumn("posx", gx - F.col("cell_x")).withColumn("posy", gy - F.col("cell_y"))
    good = mask.filter(F.col("flags").bitwiseAND(F.lit(S.WATER | S.ICE | S.MASK_OPEN)) == (S.WATER | S.ICE)).select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"))
    s = s.filter((F.col("cell_x") > 1) & (F.col("cell_x") < size_x - 2) & (F.col("cell_y") > 1) & (F.col("cell_y") < size_y - 2)).join(good, ["cell_x", "cell_y"])
    s = s.join(thickness.select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), "thickness"), ["cell_x", "cell_y"], "left")
    lat, lon = geo.pixel_to_lonlat(p, F.col("cell_x") + F.col("posx"), F.col("cell_y") + F.col("posy"))
    s = s.withColumn("m_squared", geo.area_scale_factor(p, F.radians(lat), F.radians(lon)))
    fill = {"velx": 0.0, "vely": 0.0, "jp_inv": 1.0, "a1": 0.0, "a2": 0.0, "a3": 0.0, "ts_old": 0.0, "xi": 0.0, "fe00": 1.0, "fe01": 0.0, "fe10": 0.0, "fe11": 1.0, "bp00": 0.0, "bp01": 0.0, "bp10": 0.0, "bp11": 0.0, "stored_p": 0.0, "stored_q": 0.0, "gamma_p": 0.0, "jp_inv_max": 1.0}
    s = s.withColumns({k: F.lit(v) for k, v in fill.items()}).withColumn("point_id", F.col("id").cast("long"))
    flags = F.lit(0).cast("long")
    if colours is not None:
        s = s.join(colours.select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), "r", "g", "b"), ["cell_x", "cell_y"], "left")
        for c, n in (("r", 24), ("g", 32), ("b", 40)):
            flags = flags.bitwiseOR(F.shiftleft(F.coalesce(F.col(c), F.lit(0)).cast("long"), n))
    return s.withColumn("flags", flags).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.POINTS])


def cell_numbers(points: DataFrame) -> DataFrame:
    """Points a cell."""
    return points.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


def sample_curve(spark: SparkSession, fixed_is_lat: bool, value: float, low: float, high: float, n: int, p: Projection) -> DataFrame:
    """(k, lat, lon, px, py): n points of a parallel or meridian in pixels."""
    d = spark.range(n).select(F.col("id").alias("k"), (F.lit(low) + F.col("id") * ((high - low) / max(n - 1, 1))).alias("v"))
    lat, lon = (F.lit(value), F.col("v")) if fixed_is_lat else (F.col("v"), F.lit(value))
    px, py = geo.lonlat_to_pixel(p, lat, lon)
    return d.select("k", lat.alias("lat"), lon.alias("lon"), px.alias("px"), py.alias("py")).withColumn("seq", F.row_number().over(Window.orderBy("k")))


def tick_anchors(spark: SparkSession, lats: tuple[float, float], lons: tuple[float, float], steps: tuple[float, float], offsets: tuple[float, float], p: Projection) -> DataFrame:
    """(side, at, px, py): where the labels of the southern edge's longitudes and the western edge's latitudes go, in pixels.

    Labels stand off the edge along its normal, on the side away from the box's centre; `offsets` are those of
    latitudes and of longitudes. The minimum and maximum of px and py are the labels' extent.
    """
    rows = [("south", float(v)) for v in graticule(*lons, steps[1])] + [("west", float(v)) for v in graticule(*lats, steps[0])]
    d = spark.createDataFrame(rows, "side string, at double")
    south = F.col("side") == "south"
    small = F.when(south, F.lit((lons[1] - lons[0]) * 1e-4)).otherwise(F.lit((lats[1] - lats[0]) * 1e-4))

    def place(v):
        return geo.lonlat_to_pixel(p, F.when(south, F.lit(lats[0])).otherwise(v), F.when(south, v).otherwise(F.lit(lons[0])))

    for name, v in (("here", F.col("at")), ("back", F.col("at") - small), ("ahead", F.col("at") + small)):
        x, y = place(v)
        d = d.withColumn(name, F.struct(x.alias("x"), y.alias("y")))
    mx, my = geo.lonlat_to_pixel(p, F.lit(sum(lats) / 2), F.lit(sum(lons) / 2))
    tx, ty = F.col("ahead.x") - F.col("back.x"), F.col("ahead.y") - F.col("back.y")
    # the sign tells on which side of the edge's direction the centre lies; labels go to the other one
    turn = F.signum(tx * (my - F.col("here.y")) - ty * (mx - F.col("here.x")))
    stand = F.when(south, F.lit(float(offsets[1]))).otherwise(F.lit(float(offsets[0]))) * turn / F.sqrt(tx * tx + ty * ty)
    return d.select("side", "at", (F.col("here.x") + ty * stand).alias("px"), (F.col("here.y") - tx * stand).alias("py"))
