"""Map projection, rotation and vector expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Projection
from .generic import lit

RAD = math.pi / 180.0


def pixel_to_lonlat(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of an image pixel."""
    a, b, c, d, e, f = p.affine
    px, py = x * p.resize, y * p.resize
    xg, yg = px * a + py * b + c, px * d + py * e + f
    rho = F.sqrt(xg * xg + yg * yg)
    angle = F.atan2(rho, F.lit(2.0 * p.radius)) * 2.0
    sin0, cos0 = math.sin(p.lat0 * RAD), math.cos(p.lat0 * RAD)
    safe = F.nullif(rho, F.lit(0.0))
    near = rho < 1e-9
    arg = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(angle) * sin0 + yg * F.sin(angle) * cos0 / safe))
    lat = F.when(near, F.lit(float(p.lat0))).otherwise(F.degrees(F.asin(arg)))
    lon = F.when(near, F.lit(float(p.lon0))).otherwise(F.degrees(F.atan2(xg * F.sin(angle), rho * cos0 * F.cos(angle) - yg * sin0 * F.sin(angle)) + p.lon0 * RAD))
    return lat, lon


def plane(p: Projection, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Plane metres of a position given in radians."""
    sin0, cos0, lam0 = math.sin(p.lat0 * RAD), math.cos(p.lat0 * RAD), p.lon0 * RAD
    k = F.lit(2.0 * p.radius) / (F.lit(1.0) + F.sin(lat) * sin0 + F.cos(lat) * F.cos(lon - lam0) * cos0)
    return k * F.cos(lat) * F.sin(lon - lam0), k * (F.sin(lat) * cos0 - F.cos(lat) * F.cos(lon - lam0) * sin0)


def lonlat_to_pixel(p: Projection, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Image pixel of a position in degrees; -1e9 if the affine transform can't be inverted."""
    a, b, c, d, e, f = p.affine
    det = a * e - b * d
    if abs(det) < 1e-9:
        return F.lit(-1e9), F.lit(-1e9)
    x, y = plane(p, F.radians(lat), F.radians(lon))
    x, y = x - c, y - f
    return (x * e - y * b) / (det * p.resize), (y * a - x * d) / (det * p.resize)


def lonlat_to_grid(p: Projection, lat: Column, lon: Column, offset_x: int, offset_y: int, image_height: int) -> tuple[Column, Column]:
    """Grid coordinates: origin bottom-left, offset by the modelled region."""
    x, y = lonlat_to_pixel(p, lat, lon)
    return x - offset_x, F.lit(image_height - 1.0) - y - offset_y


def grid_to_pixel(i: Column, j: Column, offset_x: int, offset_y: int, image_height: int) -> tuple[Column, Column]:
    return i + offset_x, F.lit(image_height - 1) - (j + offset_y)


def rotation(p: Projection, lat: Column, lon: Column, delta: float = 1e-5) -> Column:
    """Unit vectors (ex, ey) of east and (nx, ny) of north in the plane, by forward differences; radians in."""
    x, y = plane(p, lat, lon)

    def unit(x1, y1):
        dx, dy = x1 - x, y1 - y
        size = F.sqrt(dx * dx + dy * dy)
        size = F.when(size < 1e-9, F.lit(1.0)).otherwise(size)
        return dx / size, dy / size

    nx, ny = unit(*plane(p, lat + delta, lon))
    ex, ey = unit(*plane(p, lat, lon + delta))
    return F.struct(ex.alias("ex"), ey.alias("ey"), nx.alias("nx"), ny.alias("ny"))


def scale_factor(p: Projection, lat: Column, lon: Column) -> Column:
    """Point scale at a position in radians."""
    sin0, cos0 = math.sin(p.lat0 * RAD), math.cos(p.lat0 * RAD)
    return F.lit(2.0) / (F.lit(1.0) + F.sin(lat) * sin0 + F.cos(lat) * F.cos(lon - p.lon0 * RAD) * cos0)


def area_scale_factor(p: Projection, lat: Column, lon: Column) -> Column:
    k = scale_factor(p, lat, lon)
    return k * k


def to_grid(u: Column, v: Column, rot: Column) -> tuple[Column, Column]:
    """Geographic (east, north) vector to plane components."""
    return u * rot["ex"] + v * rot["nx"], u * rot["ey"] + v * rot["ny"]


def to_geographic(x: Column, y: Column, rot: Column) -> tuple[Column, Column]:
    return x * rot["ex"] + y * rot["ey"], x * rot["nx"] + y * rot["ny"]


def local_to_geographic(u: Column, v: Column, lat00: Column, lon00: Column, lat01: Column, lon01: Column, lat10: Column, lon10: Column) -> tuple[Column, Column]:
    """Components along a quad's own axes to (east, north)."""
    shrink = F.cos(F.radians(lat00))

    def axis(lat, lon):
        north, east = lat - lat00, (lon - lon00) * shrink
        size = F.sqrt(north * north + east * east)
        size = F.when(size < 1e-9, F.lit(1.0)).otherwise(size)
        return east / size, north / size

    xe, xn = axis(lat01, lon01)
    ye, yn = axis(lat10, lon10)
    return u * xe + v * ye, u * xn + v * yn


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Radians clockwise from north; degrees in."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def forcing_magnitude(t: Column, start: float, initial: float, per_day: float, clamped: bool = True) -> Column:
    """Synthetic forcing, linear in elapsed time; wind is clamped before the start, currents are not."""
    elapsed = t - lit(start)
    return F.lit(initial) + (F.greatest(F.lit(0.0), elapsed) if clamped else elapsed) * (per_day / 86400.0)


def web_mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional tile x, y."""
    n = float(2**zoom)
    y = (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n
    return (lon + 180.0) / 360.0 * n, y


def sphere_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
