"""Regridding through stored tables: frames and the mapping bucketed alike, so that a frame is made without an exchange.

The raster is cut into blocks of `block` by `block` quads. A stored frame has one row a block, which holds the values of its
(block + 1) squared corners as arrays; corners on a border are in the blocks on both sides. A stored mapping has one row a grid
cell with its block, the places of its quad's corners in these arrays and what the cell needs of the geometry: four weights and the
two-by-two matrix that turns the quad's vector components to the grid's axes. Both tables are bucketed by the block's number, so
a grid frame is one join of co-located buckets and expressions over arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..params import Projection
from .raster import CORNERS

VALUES = ("u10", "v10", "skt")


def _across(cols: int, block: int) -> int:
    """Blocks in a row of blocks of a raster with so many columns."""
    return max(1, -(-(cols - 1) // block))


def _write(df: DataFrame, name: str, folder: str, buckets: int) -> None:
    df.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").option("path", folder).option("compression", "zstd").mode("append").saveAsTable(name)


def attach(spark: SparkSession, name: str, folder: str, buckets: int) -> DataFrame:
    """A table stored by an earlier session, under a name of this one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def store_frames(frames: DataFrame, shape: tuple[int, int], name: str, folder: str, buckets: int, block: int = 16, values: Sequence[str] = VALUES) -> None:
    """Adds frames (t, r, c, values) of a raster of `shape` rows and columns to the table `name` in `folder`.

    Cells that are absent are null in the arrays; cells outside the shape are left out; of a cell given twice the least values count.
    """
    rows, cols = shape
    across, down = _across(cols, block), _across(rows, block)

    def owners(c: str, most: int) -> Column:
        own = F.expr(f"CAST(least({c} DIV {block}, {most - 1}) AS INT)")
        return F.when((F.col(c) % block == 0) & (F.col(c) > 0) & (own * block == F.col(c)), F.array(own - 1, own)).otherwise(F.array(own))

    inside = frames.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    dealt = inside.withColumn("br", F.explode(owners("r", down))).withColumn("bc", F.explode(owners("c", across)))
    place = ((F.col("r") - F.col("br") * block) * (block + 1) + F.col("c") - F.col("bc") * block).cast("int")
    dealt = dealt.select("t", (F.col("br") * across + F.col("bc")).cast("long").alias("block"), place.alias("k"), *values)
    one = dealt.groupBy("t", "block", "k").agg(F.struct(*[F.min(v).alias(v) for v in values]).alias("v"))
    held = one.groupBy("t", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # (block + 1) squared at most
    # each frame has all blocks, so that a cell whose corners are absent is null rather than left out
    every = inside.select("t").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across * down - 1).cast("long"))))
    held = every.join(held, ["t", "block"], "left")
    full = F.transform(F.sequence(F.lit(0), F.lit((block + 1) ** 2 - 1)), lambda k: F.try_element_at(F.col("m"), k))
    _write(held.withColumn("m", full).select("t", "block", *[F.col(f"m.{v}").alias(v) for v in values]), name, folder, buckets)


def store_mapping(mapping: DataFrame, shape: tuple[int, int], name: str, folder: str, buckets: int, p: Projection | None = None, block: int = 16, cells: DataFrame | None = None) -> None:
    """Stores a mapping (see `curvilinear_mapping`); the matrix needs the projection.

    With `cells` (i, j), those without a quad are stored too, dealt over the blocks that there are, and get 0.
    """
    across, down = _across(shape[1], block), _across(shape[0], block)
    s, t = F.col("st.s"), F.col("st.t")
    inner = lambda c: F.expr(f"CAST({c} % {block} AS INT)")
    columns: list[Column] = []
    for (a, b), w in zip(CORNERS, ((1 - s) * (1 - t), s * (1 - t), (1 - s) * t, s * t), strict=True):
        columns += [((inner("r") + a) * (block + 1) + inner("c") + b + 1).alias(f"k{a}{b}"), w.alias(f"w{a}{b}")]
    if p is not None:
        rot = geo.rotation(p, F.radians("lat"), F.radians("lon"))
        quad = (F.col("q00.y"), F.col("q00.x"), F.col("q01.y"), F.col("q01.x"), F.col("q10.y"), F.col("q10.x"))
        for k, unit in enumerate(((1.0, 0.0), (0.0, 1.0))):
            x, y = geo.to_grid(*geo.local_to_geographic(F.lit(unit[0]), F.lit(unit[1]), *quad), rot)
            columns += [x.alias(f"x{k}"), y.alias(f"y{k}")]
    number = (F.floor(F.col("r") / block) * across + F.floor(F.col("c") / block)).cast("long")
    out = mapping.select("i", "j", number.alias("block"), *columns)
    if cells is not None:
        bare = cells.select("i", "j").distinct().join(mapping.select("i", "j"), ["i", "j"], "left_anti")
        out = out.unionByName(bare.withColumn("block", F.pmod(F.xxhash64("i", "j"), F.lit(across * down))), allowMissingColumns=True)
    _write(out, name, folder, buckets)


def regrid_stored(frames: DataFrame, mapping: DataFrame, wind: bool = True, temperature: bool = True) -> DataFrame:
    """(t, i, j, vx, vy, temperature) of a stored table of frames, or some of its frames, and a stored mapping.

    A cell with a null corner is null; one without a quad is 0. Only the columns that are asked for are read.
    """

    def blend(v: str) -> Column:
        return sum((F.element_at(F.col(v), F.col(f"k{a}{b}")) * F.col(f"w{a}{b}") for a, b in CORNERS[1:]), F.element_at(F.col(v), F.col("k00")) * F.col("w00"))

    def or_zero(x: Column) -> Column:
        return F.when(F.col("w00").isNull(), F.lit(0.0)).otherwise(x)

    both = frames.join(mapping.hint("merge"), "block")
    columns: list[Column] = []
    if wind:
        u, v = blend("u10"), blend("v10")
        columns += [or_zero(u * F.col("x0") + v * F.col("x1")).alias("vx"), or_zero(u * F.col("y0") + v * F.col("y1")).alias("vy")]
    if temperature:
        columns.append(or_zero(blend("skt")).alias("temperature"))
    return both.select("t", "i", "j", *columns)
