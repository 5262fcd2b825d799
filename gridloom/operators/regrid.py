"""Regridding pipelines: a curvilinear or regular frame onto the simulation grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.generic import hours_1950_to_epoch, unpack_cf, unwrap_longitude
from ..params import Projection
from . import raster as R
from .timeseries import nearest_in_time


def grid_positions(df: DataFrame, p: Projection, offset_x: int, offset_y: int, image_height: int) -> DataFrame:
    """Adds lat, lon to cells (i, j)."""
    x, y = geo.grid_to_pixel(F.col("i"), F.col("j"), offset_x, offset_y, image_height)
    lat, lon = geo.pixel_to_lonlat(p, x, y)
    return df.withColumn("lat", lat).withColumn("lon", lon)


def curvilinear_mapping(mesh: DataFrame, p: Projection, size_x: int, size_y: int, offset_x: int, offset_y: int, image_height: int) -> DataFrame:
    """The index reused for all frames: i, j, r, c and (s, t) in the quad, and the quad's corners in degrees.

    mesh: r, c, lat, lon of one frame. Unmapped cells have no row.
    """
    gx, gy = geo.lonlat_to_grid(p, F.col("lat"), F.col("lon"), offset_x, offset_y, image_height)
    q = R.quads(mesh.withColumn("x", gx).withColumn("y", gy), extra=("lat", "lon"))
    at = R.cells_in_quads(q, size_x, size_y).join(q, ["r", "c"])
    at = grid_positions(at, p, offset_x, offset_y, image_height)
    ref = F.col("p00.lon")
    corner = lambda name: F.struct(unwrap_longitude(F.col(f"{name}.lon"), ref).alias("x"), F.col(f"{name}.lat").alias("y"))
    p00, p01, p10, p11 = (corner(n) for n in ("p00", "p01", "p10", "p11"))
    st = R.inverse_bilinear(p00, p01, p10, p11, unwrap_longitude(F.col("lon"), ref), F.col("lat"))
    return at.select("i", "j", "r", "c", "lat", "lon", st.alias("st"), p00.alias("q00"), p01.alias("q01"), p10.alias("q10"))


def regrid_curvilinear(frames: DataFrame, mapping: DataFrame, p: Projection, wind: bool = True, temperature: bool = True) -> DataFrame:
    """(t, i, j, vx, vy, temperature) of frames (t, r, c, u10, v10, skt): four corner joins on (r, c), blended in
    the quad, wind turned from the quad's axes to geographic to grid axes. Cells outside the mesh have no row; `densify`
    a frame with 0 where a dense grid is needed."""
    values = (["u10", "v10"] if wind else []) + (["skt"] if temperature else [])
    corner = frames.select("t", "r", "c", *values)
    out = mapping
    for k, (a, b) in enumerate(R.CORNERS):
        side = corner.select(*(["t"]), (F.col("r") - a).alias("r"), (F.col("c") - b).alias("c"), F.struct(*values).alias(f"v{k}"))
        out = out.join(side, ["r", "c"] if k == 0 else ["t", "r", "c"])
    s, t = F.col("st.s"), F.col("st.t")
    blend = lambda name: R.bilinear(*[F.col(f"v{k}.{name}") for k in range(4)], s, t)
    columns: list[Column] = []
    if wind:
        east, north = geo.local_to_geographic(blend("u10"), blend("v10"), F.col("q00.y"), F.col("q00.x"), F.col("q01.y"), F.col("q01.x"), F.col("q10.y"), F.col("q10.x"))
        vx, vy = geo.to_grid(east, north, geo.rotation(p, F.radians("lat"), F.radians("lon")))
        columns += [vx.alias("vx"), vy.alias("vy")]
    if temperature:
        columns.append(blend("skt").alias("temperature"))
    return out.select("t", "i", "j", *columns)


def regrid_regular(frames: DataFrame, cells: DataFrame, p: Projection, origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int], blur: int = 4, values: Sequence[str] = ("uo", "vo", "sithick"), on: Sequence[str] = ("t",)) -> DataFrame:
    """(t, i, j, vx, vy, thickness) of frames (t, r, c, values): missing is 0, currents are blurred, looked up with
    0 outside and turned to grid axes. cells: t, i, j, lat, lon."""
    frames = R.with_missing(frames, values)
    for v in values:
        if blur and v in ("uo", "vo"):
            frames = R.box_blur(frames, v, v, blur, "c", "r", by=on)
    out = R.regular_lookup(cells, frames, "lat", "lon", values, origin, step, shape, mode="zero", on=on, key=[*on, "i", "j", "lat", "lon"])
    vx, vy = geo.to_grid(F.col("uo"), F.col("vo"), geo.rotation(p, F.radians("lat"), F.radians("lon")))
    return out.select(*on, "i", "j", vx.alias("vx"), vy.alias("vy"), F.col("sithick").alias("thickness"))


def ocean_frames(currents: DataFrame, tides: DataFrame | None, thickness: DataFrame | None, scale: float = 1.0, offset: float = 0.0, fill: float = -32767.0) -> DataFrame:
    """(t, r, c, uo, vo, sithick) of three ocean tables with packed values and time axes of their own.

    currents: hours_1950, r, c, uo, vo; tides: hours_1950, r, c, utide, vtide; thickness: hours_1950, r, c, sithick.
    Values are unpacked, missing ones 0; tides are added at equal times; each frame takes the thickness nearest in time.
    """
    def plain(d: DataFrame, values: Sequence[str]) -> DataFrame:
        out = d.select(hours_1950_to_epoch(F.col("hours_1950")).alias("t"), "r", "c", *[unpack_cf(F.col(v), scale, offset, fill).alias(v) for v in values])
        return R.with_missing(out, values)

    out = plain(currents, ["uo", "vo"])
    if tides is not None:
        out = R.add_rasters(out, plain(tides, ["utide", "vtide"]).withColumnsRenamed({"utide": "uo", "vtide": "vo"}), ["t", "r", "c"], ["uo", "vo"])
    if thickness is None:
        return out.withColumn("sithick", F.lit(0.0))
    ice = plain(thickness, ["sithick"])
    times = nearest_in_time(out.select("t").distinct(), ice.select(F.col("t").alias("ts")).distinct().withColumn("_", F.lit(0)), "t", "ts", ["_"]).select("t", "nearest_ts")  # one row a frame
    near = times.join(ice.withColumnRenamed("t", "nearest_ts"), "nearest_ts").drop("nearest_ts")
    return R.with_missing(out.join(near, ["t", "r", "c"], "left"), ["sithick"]).select("t", "r", "c", "uo", "vo", "sithick")


def register_image(image: DataFrame, pixels: DataFrame, source: Projection, width: int, height: int, band: str = "v") -> DataFrame:
    """A source image (r, c, band) sampled at target pixels (x, y, lat, lon), bilinear, null outside."""
    px, py = geo.lonlat_to_pixel(source, F.col("lat"), F.col("lon"))
    at = pixels.withColumn("_y", py).withColumn("_x", px)
    return R.regular_lookup(at, image, "_y", "_x", [band], (0.0, 0.0), (1.0, 1.0), (height, width), mode="strict", inclusive=True, key=["x", "y"])


def footprint(pixels: DataFrame, source: Projection, width: int, height: int) -> DataFrame:
    """Whether each target pixel (x, y, lat, lon) lies in the source image."""
    px, py = geo.lonlat_to_pixel(source, F.col("lat"), F.col("lon"))
    return pixels.select("x", "y", (px.between(0, width - 1) & py.between(0, height - 1)).alias("inside"))
