"""Nearest cells of many sites, and their series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generic import celsius, epoch_to_iso

TOP, SPLIT, DEEPEST = 22.5, 4, 7


def _side(level: int) -> float:
    return TOP / SPLIT**level


def _bin(lat: Column, lon: Column, level: int) -> list[Column]:
    turned = F.pmod(lon, F.lit(360.0))
    return [F.floor(turned / _side(level)).alias("bx"), F.floor(lat / _side(level)).alias("by")]


def _wrapped(d: Column) -> Column:
    return d - F.lit(360.0) * F.round(d / 360.0)


def _bounds(bx: Column, by: Column, level: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Least and greatest squared distance, in degrees, of a place to a bin."""
    side = _side(level)
    x = F.abs(_wrapped((bx + 0.5) * side - lon))
    y = F.abs((by + 0.5) * side - lat)
    near = [F.greatest(d - side / 2, F.lit(0.0)) for d in (x, y)]
    return near[0] * near[0] + near[1] * near[1], (x + side / 2) * (x + side / 2) + (y + side / 2) * (y + side / 2)


def _may_be_nearest(low: Column, least_high: Column) -> Column:
    return low <= least_high * (1 + 1e-9) + 1e-12  # bounds are rounded


def nearest_cells(sites: DataFrame, cells: DataFrame, on: Sequence[str] = ("r", "c"), full: int = 16) -> DataFrame:
    """sites (lat, lon and more) with the nearest of cells (on, lat, lon): `on`, cell_lat, cell_lon, d2.

    Distance is in unweighted degrees with longitude wrapped, whichever of 0..360 and -180..180 either side uses; of
    equally near cells the first by `on` is taken. Cells are put into bins that hold some `full` of them where there are any; from
    bins of 22.5 degrees (at most 160) down, only those stay for a site that can hold its nearest cell, as the least distance to
    them is not above the greatest to another. So one pass serves any number of sites, far from all cells as well,
    and no site meets more than a few bins. Places that occur twice are looked up once.
    Cells or sites without a finite place, or beyond a pole, are left out and get nulls; so do all sites where there are no cells.
    """
    sane = (F.abs("lat") <= 90) & (F.abs("lon") < 1e6)  # false or null for NaN, infinite and null
    one = cells.filter(sane).groupBy(F.col("lat").cast("double").alias("cell_lat"), F.col("lon").cast("double").alias("cell_lon")).agg(F.min(F.struct(*on)).alias("key"))
    lat, lon = F.col("lat"), F.col("lon")
    counts = one.agg(F.count("*").alias("n"), *(F.approx_count_distinct(F.struct(*_bin(F.col("cell_lat"), F.col("cell_lon"), k))).alias(f"n{k}") for k in range(DEEPEST + 1))).first()
    deepest = next((k for k in range(DEEPEST + 1) if counts["n"] <= full * counts[f"n{k}"]), DEEPEST)
    places = sites.filter(sane).select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).distinct()
    if counts["n"] == 0:
        found = places.limit(0).select("lat", "lon", F.lit(None).cast(one.schema["key"].dataType).alias("key"), lat.alias("cell_lat"), lon.alias("cell_lon"), lat.alias("d2"))
    else:
        top = [(int(r["bx"]), int(r["by"])) for r in one.select(*_bin(F.col("cell_lat"), F.col("cell_lon"), 0)).distinct().collect()]  # at most 16 by 10
        bins = F.array(*[F.struct(F.lit(x).cast("long").alias("bx"), F.lit(y).cast("long").alias("by")) for x, y in sorted(top)])

        def ranged(b):
            low, high = _bounds(b["bx"], b["by"], 0, lat, lon)
            return F.struct(b["bx"].alias("bx"), b["by"].alias("by"), low.alias("low"), high.alias("high"))

        near = places.withColumn("b", F.transform(bins, ranged)).withColumn("least", F.array_min(F.transform("b", lambda b: b["high"])))
        near = near.select("lat", "lon", F.explode(F.filter("b", lambda b: _may_be_nearest(b["low"], F.col("least")))).alias("b")).select("lat", "lon", "b.bx", "b.by")
        for level in range(1, deepest + 1):
            child = F.explode(F.sequence(F.lit(0), F.lit(SPLIT * SPLIT - 1))).alias("k")
            near = near.select("lat", "lon", "bx", "by", child).select("lat", "lon", (F.col("bx") * SPLIT + F.col("k") % SPLIT).alias("bx"), (F.col("by") * SPLIT + F.floor(F.col("k") / SPLIT)).alias("by"))
            low, high = _bounds(F.col("bx"), F.col("by"), level, lat, lon)
            held = one.select(*_bin(F.col("cell_lat"), F.col("cell_lon"), level)).distinct()
            near = near.join(held, ["bx", "by"]).withColumns({"low": low, "high": high})
            packed = near.groupBy("lat", "lon").agg(F.min("high").alias("least"), F.collect_list(F.struct("bx", "by", "low")).alias("b"))  # a few bins a place
            near = packed.select("lat", "lon", F.explode(F.filter("b", lambda b: _may_be_nearest(b["low"], F.col("least")))).alias("b")).select("lat", "lon", "b.bx", "b.by")
        inside = one.select(*_bin(F.col("cell_lat"), F.col("cell_lon"), deepest), "*")
        dy, dx = F.col("cell_lat") - lat, _wrapped(F.col("cell_lon") - lon)
        met = near.join(inside, ["bx", "by"]).select("lat", "lon", F.struct((dy * dy + dx * dx).alias("d2"), "key", "cell_lat", "cell_lon").alias("m"))
        found = met.groupBy("lat", "lon").agg(F.min("m").alias("m")).select("lat", "lon", "m.key", "m.cell_lat", "m.cell_lon", "m.d2")
    found = found.withColumnsRenamed({"lat": "_at_lat", "lon": "_at_lon", "key": "_at_key"})
    joined = sites.join(found, (sites["lat"].cast("double") == F.col("_at_lat")) & (sites["lon"].cast("double") == F.col("_at_lon")), "left")
    return joined.select(*[sites[c] for c in sites.columns], *[F.col(f"_at_key.{c}").alias(c) for c in on], *[found[c] for c in ("cell_lat", "cell_lon", "d2")])


def site_series(placed: DataFrame, frames: DataFrame, keep: Sequence[str], t: str = "t", kelvin: str = "skt", on: Sequence[str] = ("r", "c")) -> DataFrame:
    """`keep` of each placed site with timestamp_utc, epoch_unix and temperature_C of its cell in all frames (t, on, kelvin).

    Sites of one cell share its rows; a site without a cell has none.
    """
    series = frames.select(*on, F.col(t).cast("long").alias("epoch_unix"), celsius(F.col(kelvin).cast("double")).alias("temperature_C"))
    out = placed.select(*keep, *on).join(series, list(on))
    return out.select(*keep, epoch_to_iso(F.col("epoch_unix")).alias("timestamp_utc"), "epoch_unix", "temperature_C")
