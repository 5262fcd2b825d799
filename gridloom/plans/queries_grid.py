"""Raster, stencil and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.generic import has
from ..operators import masks as M
from ..operators import raster as R
from ..operators import scatter as SC
from ..schemas import ICE, WATER
from .registry import query, rounded, table

_GRID = "SELECT x, y, count(event_id) AS n FROM (SELECT d AS x, h AS y FROM range(1, 31) a(d), range(24) b(h)) g LEFT JOIN (SELECT event_id, day(ts) AS x, hour(ts) AS y FROM events {where}) e USING (x, y) GROUP BY x, y"


def _grid(spark, sf_dir, where="true"):
    g = spark.range(30 * 24).select((F.expr("id DIV 24") + 1).cast("int").alias("x"), (F.col("id") % 24).cast("int").alias("y"))
    e = table(spark, sf_dir, "events").filter(where).groupBy(F.dayofmonth("ts").alias("x"), F.hour("ts").alias("y")).agg(F.count("*").alias("n"))
    return g.join(e, ["x", "y"], "left").fillna(0, ["n"])


@query(
    f"""
    WITH g AS ({_GRID.format(where='')}), h AS (SELECT x, y, avg(n) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS a FROM g)
    SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(avg(a) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 8) AS blurred FROM h
    """
)
def box_blur_2d(spark, sf_dir):
    return R.box_blur(_grid(spark, sf_dir), "n", "blurred").select("x", "y", F.round("blurred", 8).alias("blurred"))


@query(
    f"""
    WITH a AS ({_GRID.format(where="WHERE event_type = 'click'")}), b AS ({_GRID.format(where="WHERE event_type = 'view'")}), d AS (SELECT x, y, a.n - b.n AS d FROM a JOIN b USING (x, y))
    SELECT CAST(x AS INTEGER) AS i, CAST(y AS INTEGER) AS j, lead(d) OVER (PARTITION BY y ORDER BY x) - lag(d) OVER (PARTITION BY y ORDER BY x) AS gx, lead(d) OVER (PARTITION BY x ORDER BY y) - lag(d) OVER (PARTITION BY x ORDER BY y) AS gy FROM d
    """
)
def central_difference(spark, sf_dir):
    a, b = (_grid(spark, sf_dir, f"event_type = '{t}'").select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("n").alias(n)) for t, n in (("click", "a"), ("view", "b")))
    d = a.join(b, ["i", "j"]).withColumn("d", F.col("a") - F.col("b"))
    return R.central_difference(d, "d").select("i", "j", "gx", "gy")


@query(
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS m0, CAST(l_suppkey % 40 AS DOUBLE) AS m1, l_discount * 1.0123457 AS v0x, l_tax * 1.0234567 AS v0y, l_tax / 2.0123457 AS v1x, l_discount / 3 AS v1y, CAST(l_partkey % 5 AS DOUBLE) - 2 AS gx, CAST(l_orderkey % 7 AS DOUBLE) - 3 AS gy FROM lineitem),
    q AS (SELECT *, m0 + m1 AS mt, sqrt(gx * gx + gy * gy) AS gn FROM p),
    r AS (SELECT *, -gx / nullif(gn, 0) AS nx, -gy / nullif(gn, 0) AS ny, (m0 * v0x + m1 * v1x) / nullif(mt, 0) AS cx, (m0 * v0y + m1 * v1y) / nullif(mt, 0) AS cy FROM q),
    s AS (SELECT *, (v0x - cx) * nx + (v0y - cy) * ny AS dn FROM r),
    t AS (SELECT *, v0x - cx - dn * nx AS tx, v0y - cy - dn * ny AS ty FROM s), u AS (SELECT *, sqrt(tx * tx + ty * ty) AS tn FROM t),
    w AS (SELECT *, coalesce(m0 >= mt * 1e-3 AND m1 >= mt * 1e-3 AND gn >= 1e-10 AND dn > 0, false) AS meets, CASE WHEN tn <= 0.3 * dn THEN cx ELSE v0x - dn * nx - 0.3 * dn * tx / nullif(tn, 0) END AS ax, CASE WHEN tn <= 0.3 * dn THEN cy ELSE v0y - dn * ny - 0.3 * dn * ty / nullif(tn, 0) END AS ay FROM u)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN meets THEN ax ELSE v0x END, 8) AS v0x, round(CASE WHEN meets THEN ay ELSE v0y END, 8) AS v0y, round(CASE WHEN meets THEN v1x - m0 * (ax - v0x) / m1 ELSE v1x END, 8) AS v1x, round(CASE WHEN meets THEN v1y - m0 * (ay - v0y) / m1 ELSE v1y END, 8) AS v1y FROM w
    """
)
def contact_impulse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, d, t = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax"))
    out = SC.with_contact(li, q, (F.col("l_suppkey") % 40).cast("double"), (F.col("l_partkey") % 5).cast("double") - 2, (F.col("l_orderkey") % 7).cast("double") - 3, (d * 1.0123457, t * 1.0234567), (t / 2.0123457, d / 3), 0.3)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "v0x", "v0y", "v1x", "v1y"), 8)


@query("SELECT CAST(greatest(min(c_nationkey) - 2, 0) AS INTEGER) AS x0, CAST(least(max(c_nationkey) + 2, 24) AS INTEGER) AS x1, CAST(greatest(min(CAST(trunc(c_acctbal) AS INTEGER)) - 2, 0) AS INTEGER) AS y0, CAST(least(max(CAST(trunc(c_acctbal) AS INTEGER)) + 2, 9000) AS INTEGER) AS y1 FROM customer WHERE c_mktsegment = 'BUILDING'")
def bbox_pad(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("x"), F.col("c_acctbal").cast("int").alias("y"), "c_mktsegment")
    return M.bounding_box(c, F.col("c_mktsegment") == "BUILDING", 2, (25, 9001))


@query(
    """
    WITH l AS (SELECT l_partkey AS x, l_suppkey AS y, bit_or((CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) | (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) | (CASE WHEN l_linestatus = 'F' AND l_discount > 0.08 THEN 16 ELSE 0 END)) AS f FROM lineitem GROUP BY ALL)
    SELECT x, y, CAST(f AS INTEGER) AS flags, CAST(CASE WHEN f & 16 <> 0 THEN 128 WHEN f & 1 <> 0 THEN 255 ELSE 0 END AS INTEGER) AS region FROM l
    """
)
def flag_layers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    water = M.layer(li.withColumn("r", F.when(F.col("l_quantity") < 25, 0).otherwise(255)), 1)
    ice = M.layer(li.withColumn("r", F.when(F.col("l_returnflag") == "R", 255).otherwise(0)), 2, invert=True)
    open_ = M.layer(li.withColumn("r", F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08), 0).otherwise(255)), 16)
    return M.merge_layers([water, ice, open_]).withColumn("region", M.region(F.col("flags").cast("long")))


@query(
    """
    WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_returnflag = 'R' THEN 131072 ELSE 0 END) | (CASE WHEN l_linestatus = 'F' THEN 2097152 ELSE 0 END) | (CASE WHEN l_tax > 0.07 THEN 262144 ELSE 0 END) | CAST(l_suppkey % 16 AS INTEGER) AS f FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f & 262144 <> 0 THEN 'disabled' WHEN f & 2097152 <> 0 THEN 'crushed' WHEN f & 131072 <> 0 THEN 'cracked' ELSE 'intact' END AS status, CAST(f & 65535 AS BIGINT) AS partition FROM f
    """
)
def status_class(spark, sf_dir):
    from ..functions.generic import partition_id

    bit = lambda c, v: F.when(c, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long"))
    f = bit(F.col("l_returnflag") == "R", 131072).bitwiseOR(bit(F.col("l_linestatus") == "F", 2097152)).bitwiseOR(bit(F.col("l_tax") > 0.07, 262144)).bitwiseOR(F.col("l_suppkey") % 16)
    li = table(spark, sf_dir, "lineitem").withColumn("f", f)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", M.status(F.col("f")).alias("status"), partition_id(F.col("f")).alias("partition"))


_RASTER = "SELECT CAST(n_nationkey % 5 AS INTEGER) AS r, CAST(n_nationkey // 5 AS INTEGER) AS c, avg(s_acctbal) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > {low} GROUP BY 1, 2"
_CORNERS = """p AS (SELECT c_custkey AS k, (c_custkey % 53) / 10.0 AS lat, (c_custkey % 47) / 10.0 AS lon FROM customer), q AS (SELECT *, CAST(floor(lat) AS INTEGER) AS r0, CAST(floor(lon) AS INTEGER) AS c0 FROM p),
    i AS (SELECT * FROM q WHERE r0 < 4 AND c0 < 4), f AS (SELECT k, r0 + a AS r, c0 + b AS c, (CASE a WHEN 0 THEN 1 - (lat - r0) ELSE lat - r0 END) * (CASE b WHEN 0 THEN 1 - (lon - c0) ELSE lon - c0 END) AS w FROM i, range(2) x(a), range(2) y(b)),
    j AS (SELECT f.*, v FROM f LEFT JOIN g USING (r, c))"""


def _lookup(spark, sf_dir, low, mode):
    s = table(spark, sf_dir, "supplier").filter(f"s_acctbal > {low}")
    n = table(spark, sf_dir, "nation")
    g = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy((F.col("n_nationkey") % 5).cast("int").alias("r"), F.expr("CAST(n_nationkey DIV 5 AS INT)").alias("c")).agg(F.avg("s_acctbal").alias("v"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 53) / 10.0).alias("lat"), ((F.col("c_custkey") % 47) / 10.0).alias("lon"))
    return rounded(R.regular_lookup(p, g, "lat", "lon", ["v"], (0.0, 0.0), (1.0, 1.0), (5, 5), mode, key=["k"]), 5)


@query(f"WITH g AS ({_RASTER.format(low=-1e9)}), {_CORNERS} SELECT p.k, round(coalesce(s, 0.0), 5) AS v FROM p LEFT JOIN (SELECT k, sum(w * v) AS s FROM j GROUP BY k) USING (k)")
def bilinear_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir, -1e9, "zero")


@query(f"WITH g AS ({_RASTER.format(low=8000)}), {_CORNERS} SELECT p.k, round(s, 5) AS v FROM p LEFT JOIN (SELECT k, sum(w * v) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS s FROM j GROUP BY k) USING (k)")
def masked_bilinear(spark, sf_dir):
    return _lookup(spark, sf_dir, 8000, "masked")


@query(f"WITH g AS ({_RASTER.format(low=8000)}), {_CORNERS} SELECT p.k, round(s, 5) AS v FROM p LEFT JOIN (SELECT k, CASE WHEN count(v) = 4 THEN sum(w * v) END AS s FROM j GROUP BY k) USING (k)")
def strict_bilinear(spark, sf_dir):
    return _lookup(spark, sf_dir, 8000, "strict")


@query(
    """
    WITH c AS (SELECT s_suppkey AS r, s_nationkey AS c, 70 + s_acctbal / 1000 AS lat, s_nationkey * 14.0 AS lon FROM supplier), d AS (SELECT *, lon - 350 - 360 * round((lon - 350) / 360) AS dl FROM c)
    SELECT arg_min(r, ((lat - 75) * (lat - 75) + dl * dl, r, c)) AS r, round(min((lat - 75) * (lat - 75) + dl * dl), 6) AS d2 FROM d
    """
)
def nearest_cell(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r"), F.col("s_nationkey").alias("c"), (F.col("s_acctbal") / 1000 + 70).alias("lat"), (F.col("s_nationkey") * 14.0).alias("lon"))
    return R.nearest_lonlat(c, 75.0, 350.0).select("r", F.round("d2", 6).alias("d2"))


_MESH = "SELECT r, c, c * 3.0 + r * 0.7 + 0.2537 AS x, r * 3.0 - c * 0.4 + 5.3171 AS y FROM range(12) a(r), range(12) b(c)"


@query(
    f"""
    WITH m AS ({_MESH}), q AS (SELECT a.r, a.c, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2, e.x AS x3, e.y AS y3 FROM m a JOIN m b ON b.r = a.r AND b.c = a.c + 1 JOIN m e ON e.r = a.r + 1 AND e.c = a.c JOIN m d ON d.r = a.r + 1 AND d.c = a.c + 1),
    p AS (SELECT DISTINCT CAST(o_custkey % 40 AS INTEGER) AS i, CAST(o_orderkey % 40 AS INTEGER) AS j FROM orders),
    h AS (SELECT i, j, r, c FROM p, q WHERE (x1 - x0) * (j - y0) - (y1 - y0) * (i - x0) >= 0 AND (x2 - x1) * (j - y1) - (y2 - y1) * (i - x1) >= 0 AND (x3 - x2) * (j - y2) - (y3 - y2) * (i - x2) >= 0 AND (x0 - x3) * (j - y3) - (y0 - y3) * (i - x3) >= 0)
    SELECT i, j, CAST((max((r, c)))[1] AS INTEGER) AS r, CAST((max((r, c)))[2] AS INTEGER) AS c FROM h GROUP BY i, j
    """
)
def point_in_quad(spark, sf_dir):
    mesh = spark.range(144).select(F.expr("CAST(id DIV 12 AS INT)").alias("r"), (F.col("id") % 12).cast("int").alias("c"))
    mesh = mesh.withColumn("x", F.col("c") * 3.0 + F.col("r") * 0.7 + 0.2537).withColumn("y", F.col("r") * 3.0 - F.col("c") * 0.4 + 5.3171)
    cells = R.cells_in_quads(R.quads(mesh), 40, 40)
    p = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("int").alias("i"), (F.col("o_orderkey") % 40).cast("int").alias("j")).distinct()
    return p.join(cells, ["i", "j"])


@query("WITH d AS (SELECT day(ts) AS t, event_type AS e, sum(value) AS v FROM events GROUP BY ALL), a AS (SELECT t, v FROM d WHERE e = 'view'), b AS (SELECT t, v FROM d WHERE e = 'click' AND t % 2 = 0) SELECT CAST(a.t AS INTEGER) AS t, round(a.v + coalesce(b.v, 0), 4) AS v FROM a LEFT JOIN b USING (t)")
def tide_sum(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("t"), "event_type").agg(F.sum("value").alias("v"))
    return rounded(R.add_rasters(d.filter("event_type = 'view'"), d.filter("event_type = 'click' AND t % 2 = 0"), ["t"], ["v"]), 4)


@query(f"WITH g AS ({_GRID.format(where='')}) SELECT CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, n FROM range(10) a(tx), range(12) b(ty) JOIN g ON g.x - 1 = CAST(trunc(tx * 3.0) AS INTEGER) AND g.y = CAST(trunc(ty * 2.0) AS INTEGER)")
def resample_nearest(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("x", F.col("x") - 1)
    return R.resample_nearest(g, (30, 24), (10, 12), "n").select("x", "y", "n")


@query(
    f"""
    WITH g AS ({_GRID.format(where='')}), v AS (SELECT x, y, CASE WHEN n % 3 <> 0 THEN n END AS n FROM g),
    b AS (SELECT a.x, a.y, arg_min(s.n, ((a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y), s.x, s.y)) AS f FROM v a JOIN v s ON s.n IS NOT NULL AND (a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y) <= 9 WHERE a.n IS NULL GROUP BY a.x, a.y)
    SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, coalesce(v.n, b.f) AS n FROM v LEFT JOIN b USING (x, y)
    """
)
def fill_nearest(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("n", F.when(F.col("n") % 3 != 0, F.col("n")))
    return R.fill_nearest(g, "n", 3)


@query(
    """
    WITH a AS (SELECT vec_id, trunc(embedding[1] * 1000) AS x, trunc(embedding[2] * 1000) AS y FROM embeddings WHERE label < 5), b AS (SELECT trunc(embedding[1] * 1000) AS x, trunc(embedding[2] * 1000) AS y FROM embeddings WHERE label >= 5)
    SELECT vec_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64)
    """
)
def radius_anti(spark, sf_dir):
    at = lambda k: (F.element_at("embedding", k) * 1000).cast("int").cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"))
    return M.radius_anti(e.filter("label < 5"), e.filter("label >= 5"), 8.0).select("vec_id")


@query("WITH m AS (SELECT p_partkey AS x, (CASE WHEN p_size < 30 THEN 1 ELSE 0 END) | (CASE WHEN p_size > 10 THEN 2 ELSE 0 END) AS f FROM part) SELECT count(*) FILTER (f = 3) AS ice_cells, round(1000.0 / nullif(count(*) FILTER (f = 3), 0), 8) AS points_a_cell, round(count(*) FILTER (f = 3) * 4.0 / 1000, 8) AS area_a_point FROM m")
def ice_coverage(spark, sf_dir):
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), bit(F.col("p_size") < 30, WATER).bitwiseOR(bit(F.col("p_size") > 10, ICE)).cast("long").alias("flags"))
    return rounded(M.coverage(m, 4.0, 1000), 8)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_nationkey BETWEEN 3 AND 9")
def bbox_predicate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter(M.in_box(F.col("c_acctbal"), F.col("c_nationkey"), (1000, 5000, 3, 9))).select("c_custkey", "c_nationkey")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def mask_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return M.without(table(spark, sf_dir, "part").filter("p_size > 20"), li, ["p_partkey"]).select("p_partkey")


@query("SELECT bool_or(f & 2 <> 0) AS found FROM (SELECT CASE WHEN p_size > 49 THEN 2 ELSE 0 END AS f FROM part)")
def any_flag(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 49, F.lit(2)).otherwise(F.lit(0)).cast("long").alias("flags"))
    return m.agg(F.bool_or(has(F.col("flags"), 2)).alias("found"))
