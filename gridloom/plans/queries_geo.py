"""Projection, scalar and colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generic as X
from ..functions import geo
from ..functions import physics as P
from ..params import Material, Projection
from .registry import query, rounded, table

PROJECTION = Projection(80.5, -67.5, (50.0, 0.0, -400000.0, 0.0, -50.0, 400000.0), 1.0)
MATERIAL = Material(dp_threshold=0.0, c_start=0.9, c_residual=0.5)
_POS = "SELECT c_custkey AS k, 78.0 + (c_custkey % 500) / 100.0 AS lat, -72.0 + (c_custkey % 900) / 100.0 AS lon FROM customer"
_PLANE = f"""p AS ({_POS}), r AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam, radians(80.5) AS phi0, radians(-67.5) AS lam0 FROM p),
    q AS (SELECT *, 2.0 / (1.0 + sin(phi0) * sin(phi) + cos(phi0) * cos(phi) * cos(lam - lam0)) AS sc FROM r),
    xy AS (SELECT *, 6371000.0 * sc * cos(phi) * sin(lam - lam0) AS x, 6371000.0 * sc * (cos(phi0) * sin(phi) - sin(phi0) * cos(phi) * cos(lam - lam0)) AS y FROM q)"""


def _positions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), (F.lit(78.0) + (F.col("c_custkey") % 500) / 100.0).alias("lat"), (F.lit(-72.0) + (F.col("c_custkey") % 900) / 100.0).alias("lon"))


@query(f"WITH {_PLANE} SELECT k, round((x + 400000) / 50, 5) AS px, round((400000 - y) / 50, 5) AS py, round(lat, 7) AS lat, round(lon, 7) AS lon FROM xy")
def project_roundtrip(spark, sf_dir):
    d = _positions(spark, sf_dir)
    px, py = geo.lonlat_to_pixel(PROJECTION, F.col("lat"), F.col("lon"))
    d = d.select("k", px.alias("px"), py.alias("py"))
    lat, lon = geo.pixel_to_lonlat(PROJECTION, F.col("px"), F.col("py"))
    return d.select("k", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"WITH {_PLANE} SELECT k, round(sc, 9) AS scale, round(sc * sc, 9) AS area_scale FROM xy")
def scale_factor(spark, sf_dir):
    d = _positions(spark, sf_dir)
    lat, lon = F.radians("lat"), F.radians("lon")
    return d.select("k", F.round(geo.scale_factor(PROJECTION, lat, lon), 9).alias("scale"), F.round(geo.area_scale_factor(PROJECTION, lat, lon), 9).alias("area_scale"))


def _shift(dphi: str, dlam: str) -> str:
    k = f"(2.0 / (1.0 + sin(phi0) * sin(phi + {dphi}) + cos(phi0) * cos(phi + {dphi}) * cos(lam + {dlam} - lam0)))"
    return f"6371000.0 * {k} * cos(phi + {dphi}) * sin(lam + {dlam} - lam0) - x AS dx, 6371000.0 * {k} * (cos(phi0) * sin(phi + {dphi}) - sin(phi0) * cos(phi + {dphi}) * cos(lam + {dlam} - lam0)) - y AS dy"


@query(f"WITH {_PLANE}, n AS (SELECT k, {_shift('1e-5', '0.0')} FROM xy), e AS (SELECT k, {_shift('0.0', '1e-5')} FROM xy) SELECT n.k, round(e.dx / sqrt(e.dx * e.dx + e.dy * e.dy), 4) AS ex, round(e.dy / sqrt(e.dx * e.dx + e.dy * e.dy), 4) AS ey, round(n.dx / sqrt(n.dx * n.dx + n.dy * n.dy), 4) AS nx, round(n.dy / sqrt(n.dx * n.dx + n.dy * n.dy), 4) AS ny FROM n JOIN e USING (k)")
def rotation(spark, sf_dir):
    d = _positions(spark, sf_dir)
    return rounded(d.select("k", geo.rotation(PROJECTION, F.radians("lat"), F.radians("lon")).alias("r")).select("k", "r.*"), 4)


@query(f"WITH {_PLANE} SELECT k, round(atan2(sin(lam0 - lam) * cos(phi0), cos(phi) * sin(phi0) - sin(phi) * cos(phi0) * cos(lam0 - lam)), 9) AS bearing FROM xy WHERE NOT (lat = 80.5 AND lon = -67.5)")
def bearing(spark, sf_dir):
    d = _positions(spark, sf_dir).filter("NOT (lat = 80.5 AND lon = -67.5)")
    return d.select("k", F.round(geo.initial_bearing(F.col("lat"), F.col("lon"), F.lit(80.5), F.lit(-67.5)), 9).alias("bearing"))


@query(f"WITH p AS ({_POS}) SELECT k, CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 256) AS BIGINT) AS ty FROM p")
def tile_xy(spark, sf_dir):
    x, y = geo.web_mercator_tile(F.col("lat"), F.col("lon"), 8)
    return _positions(spark, sf_dir).select("k", F.floor(x).alias("tx"), F.floor(y).alias("ty"))


@query("SELECT event_id, round(5.0 + 2.0 / 86400 * greatest(0, epoch(date_trunc('second', ts))::BIGINT - 1704499200), 6) AS wind, round(5.0 + 2.0 / 86400 * (epoch(date_trunc('second', ts))::BIGINT - 1704499200), 6) AS current FROM events")
def forcing_magnitude(spark, sf_dir):
    t = F.unix_seconds("ts").cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.round(geo.forcing_magnitude(t, 1704499200.0, 5.0, 2.0), 6).alias("wind"), F.round(geo.forcing_magnitude(t, 1704499200.0, 5.0, 2.0, clamped=False), 6).alias("current"))


_F = "SELECT l_orderkey, l_linenumber, l_partkey, 1.0 + l_discount AS a, l_tax AS b, l_discount - 0.03 AS c, 1.0 - l_tax AS d FROM lineitem"


@query(
    f"""
    WITH f AS ({_F}), m AS (SELECT 3.7e9 / 2.6 AS mu, 3.7e9 / 2.6 * 2 / 3 + 3.7e9 * 0.3 / (1.3 * 0.4) AS kappa), g AS (SELECT *, a * d - b * c AS j, a * a + b * b AS xx, a * c + b * d AS xy, c * c + d * d AS yy FROM f, m)
    SELECT l_orderkey, l_linenumber, l_partkey, round(-kappa / 2 * (j * j - 1) / 1e6, 5) AS p, round(sqrt(2) * mu / j * sqrt((xx - yy) * (xx - yy) / 2 + 2 * xy * xy) / 1e6, 5) AS q,
           round((mu / j * (xx - yy) / 2 + kappa * 0.5 * (j * j - 1)) / 1e6, 5) AS s00, round(mu / j * xy / 1e6, 5) AS s01 FROM g
    """
)
def stress_pq(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") + 1.0).alias("a"), F.col("l_tax").alias("b"), (F.col("l_discount") - 0.03).alias("c"), (F.lit(1.0) - F.col("l_tax")).alias("d"))
    f = [F.col(c) for c in "abcd"]
    k = P.kirchhoff_stress(MATERIAL, f)
    mega = lambda c: F.round(c / 1e6, 5)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", mega(P.pressure(MATERIAL, f)).alias("p"), mega(P.shear_stress(MATERIAL, f)).alias("q"), mega(k[0]).alias("s00"), mega(k[1]).alias("s01"))


@query(
    f"""
    WITH f AS ({_F}), e AS (SELECT *, (a * a + c * c - 1) / 2 AS xx, (a * b + c * d) / 2 AS xy, (b * b + d * d - 1) / 2 AS yy FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(xx * xx + 2 * xy * xy + yy * yy), 8) AS eqv, round(sqrt(2.0 / 3 * ((xx - yy) * (xx - yy) / 2 + 2 * xy * xy)), 8) AS vm FROM e
    """
)
def strain_measures(spark, sf_dir):
    f = [F.col("l_discount") + 1.0, F.col("l_tax"), F.col("l_discount") - 0.03, F.lit(1.0) - F.col("l_tax")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.equivalent_strain(f), 8).alias("eqv"), F.round(P.von_mises_strain(f), 8).alias("vm"))


@query(
    """
    WITH p AS (SELECT p_partkey, p_retailprice * 100 - 100000 AS p FROM part), c AS (SELECT *, 1e5 + 0.3 * (1e5 / (1.2 - 0.3)) AS qi FROM p), k AS (SELECT *, qi * 0.9 AS qc FROM c)
    SELECT p_partkey, round(CASE WHEN p <= 0 THEN 1e5 / 5e4 * (p + 5e4) ELSE 1e5 + 0.3 * p END, 4) AS intact,
           round(CASE WHEN p < 0 THEN 0 ELSE least(p * 1.2, qc + 0.2 * (p - qc / 1.2)) END, 4) AS yielding FROM k
    """
)
def yield_envelope(spark, sf_dir):
    p = F.col("p_retailprice") * 100 - 100000
    c = P.crossover(MATERIAL.shear, MATERIAL, F.lit(0.9))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.intact_envelope(p, MATERIAL.shear, -MATERIAL.tensile, MATERIAL.fracture_tan), 4).alias("intact"), F.round(P.yield_surface(p, c, MATERIAL), 4).alias("yielding"))


@query("SELECT p_partkey, round(0.5 + 0.4 * exp(-(p_size / 1000.0) / 0.02), 9) AS cf FROM part")
def cf_softening(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.softening(F.col("p_size") / 1000.0, MATERIAL), 9).alias("cf"))


@query("SELECT p_partkey, round(CASE WHEN abs((p_size - 25.0) / 25.0) <= 1 THEN 10 * sqrt(1 - power((p_size - 25.0) / 25.0, 2)) END, 8) AS q FROM part")
def ellipse_q(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.ellipse(F.col("p_size").cast("double"), 50.0, 10.0), 8).alias("q"))


@query(
    """
    WITH t AS (SELECT p_partkey, -CAST(p_size AS DOUBLE) AS t FROM part),
    f AS (SELECT *, CASE WHEN t > -2 AND t <= 0 THEN -0.041221 - 18.407 * t + 0.58402 * t * t + 0.21454 * t * t * t WHEN t <= -2 AND t >= -22.9 THEN -4.732 - 22.45 * t - 0.6397 * t * t - 0.01074 * t * t * t WHEN t < -22.9 AND t >= -30 THEN 9899.0 + 1309.0 * t + 55.27 * t * t + 0.7160 * t * t * t END AS f1,
      CASE WHEN t > -2 AND t <= 0 THEN 0.090312 - 0.016111 * t + 1.2291e-4 * t * t + 1.3603e-4 * t * t * t WHEN t <= -2 AND t >= -22.9 THEN 0.08903 - 0.01763 * t - 5.330e-4 * t * t - 8.801e-6 * t * t * t WHEN t < -22.9 AND t >= -30 THEN 8.547 + 1.089 * t + 0.04518 * t * t + 5.819e-4 * t * t * t END AS f2 FROM t)
    SELECT p_partkey, round((917.0 - 0.1403 * t) / 1000 * 6 / (f1 - (917.0 - 0.1403 * t) / 1000 * 6 * f2), 8) AS brine FROM f
    """
)
def brine_cubic(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.brine_cubic((-F.col("p_size")).cast("double"), 6.0), 8).alias("brine"))


@query("SELECT p_partkey, CASE WHEN p_size = 20 THEN 0.0 ELSE round(p_size * 0.01::DOUBLE - 5, 9) END AS value, CASE WHEN p_size <> 20 THEN round(p_size * 0.01::DOUBLE - 5, 9) END AS strict FROM part")
def cf_unpack_fill(spark, sf_dir):
    raw = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.unpack_cf(raw, 0.01, -5.0, 20.0), 9).alias("value"), F.round(X.unpack_cf(raw, 0.01, -5.0, 20.0, mode="exact"), 9).alias("strict"))


@query(
    """
    WITH v AS (SELECT DISTINCT l_discount AS d, greatest(0.0, least(1.0, l_discount * 9.7)) * 2 AS pos FROM lineitem), i AS (SELECT *, least(CAST(trunc(pos) AS INTEGER), 1) AS i, pos - least(CAST(trunc(pos) AS INTEGER), 1) AS t FROM v)
    SELECT d, CAST(trunc([0, 255, 255][i + 1] + ([0, 255, 255][i + 2] - [0, 255, 255][i + 1]) * t) AS INTEGER) AS r, CAST(trunc([0, 255, 0][i + 1] + ([0, 255, 0][i + 2] - [0, 255, 0][i + 1]) * t) AS INTEGER) AS g, CAST(trunc([255, 255, 0][i + 1] + ([255, 255, 0][i + 2] - [255, 255, 0][i + 1]) * t) AS INTEGER) AS b FROM i
    """
)
def palette_lookup(spark, sf_dir):
    ramp = [(0, 0, 255), (255, 255, 255), (255, 0, 0)]
    d = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("d")).distinct()
    return d.withColumn("c", X.palette_colour(ramp, F.col("d") * 9.7)).select("d", "c.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_discount * 9.1 * 255.0) AS INTEGER) AS truncated, CAST(round_even(greatest(0.0, least(1.0, l_discount * 9.1)) * 255.0, 0) AS INTEGER) AS rounded FROM lineitem")
def quantise_u8(spark, sf_dir):
    x = F.col("l_discount") * 9.1
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.quantise_truncated(x).alias("truncated"), X.quantise_rounded(x).alias("rounded"))


@query("SELECT c_custkey, round(c_custkey * 7.3 - 360 * round(c_custkey * 7.3 / 360), 6) AS wrapped, (c_custkey % 1000) AS x, (c_custkey % 77) AS y, (c_custkey % 77) * 4294967296 + (c_custkey % 1000) AS packed FROM customer")
def wrap_pack(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = X.pack_cell(F.col("c_custkey") % 1000, F.col("c_custkey") % 77)
    c = c.withColumn("packed", key)
    x, y = X.cell_of(F.col("packed"))
    return c.select("c_custkey", F.round(X.wrap_degrees(F.col("c_custkey") * 7.3), 6).alias("wrapped"), x.cast("long").alias("x"), y.cast("long").alias("y"), "packed")


@query(f"WITH p AS ({_POS}), a AS (SELECT k, radians(lat) AS a, radians(80.5) AS b, radians(lon + 67.5) AS d FROM p) SELECT k, round(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin((b - a) / 2), 2) + cos(a) * cos(b) * power(sin(d / 2), 2)))), 3) AS metres FROM a")
def sphere_distance(spark, sf_dir):
    return _positions(spark, sf_dir).select("k", F.round(geo.sphere_distance(F.col("lat"), F.col("lon"), F.lit(80.5), F.lit(-67.5)), 3).alias("metres"))


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS a, 1.5::DOUBLE AS b FROM customer")
def brace_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v = X.parse_braces(F.format_string("{{%d,%d},{1.5,2}}", "c_custkey", "c_nationkey"))
    return c.select("c_custkey", v[0][0].alias("a"), v[1][0].alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity + 0.5) AS INTEGER) AS cell, round((l_extendedprice - 900) / 100000, 9) AS share FROM lineitem")
def normalise_range(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.nearest_cell(F.col("l_quantity")).alias("cell"), F.round(X.normalise(F.col("l_extendedprice"), 900.0, 100900.0), 9).alias("share"))


@query(
    """
    WITH f AS (SELECT p_partkey, (p_size / 10.0 - 0.7) / (4.0 - 0.7) AS f, greatest(0.0, least(1.0, p_retailprice / 2000)) AS a FROM part),
    i AS (SELECT *, greatest(0.0, least(1.0, f)) AS t FROM f)
    SELECT p_partkey, round(f, 9) AS frac, round(a, 9) AS alpha, CAST(trunc(255 + (CAST(trunc(0 + 255 * t) AS INTEGER) - 255) * a) AS INTEGER) AS r FROM i
    """
)
def raster_compose(spark, sf_dir):
    from ..functions import visual as V

    p = table(spark, sf_dir, "part")
    out = V.compose(p, "thickness", F.col("p_size") / 10.0, [(0, 0, 0), (255, 255, 255)], F.col("p_retailprice") / 2000)
    return out.select("p_partkey", F.round("frac", 9).alias("frac"), F.round("alpha", 9).alias("alpha"), F.col("rgb.r").alias("r"))
