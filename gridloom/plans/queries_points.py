"""Point, particle-grid, partition and generator queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import generate as G
from ..operators import layout as L
from ..operators import scatter as SC
from ..operators.plasticity import plastic_update
from ..params import Grid, Material
from .registry import query, rounded, table

GRID = Grid(64, 64, 1.0, 0.01, particle_area=0.25)
SOFT = Material(young=1e6, dp_threshold=-1e2, shear=2e3, tensile=1e3, compressive=2e4, c_start=0.9, c_residual=0.4, tau_inv=20.0)

_PTS = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 + l_partkey % 60 AS INTEGER) AS cx, CAST(2 + l_suppkey % 60 AS INTEGER) AS cy, l_discount * 9 - 0.45 AS px, l_tax * 10 - 0.4 AS py, l_quantity AS m, l_discount AS u, l_tax AS v FROM lineitem"
_FAN = f"""p AS ({_PTS}), f AS (SELECT p.*, cx + a AS i, cy + b AS j, (CASE a WHEN -1 THEN 0.5 * (0.5 - px) * (0.5 - px) WHEN 0 THEN 0.75 - px * px ELSE 0.5 * (px + 0.5) * (px + 0.5) END) * (CASE b WHEN -1 THEN 0.5 * (0.5 - py) * (0.5 - py) WHEN 0 THEN 0.75 - py * py ELSE 0.5 * (py + 0.5) * (py + 0.5) END) AS w FROM p, range(-1, 2) x(a), range(-1, 2) y(b)),
    g AS (SELECT i, j, sum(w * m) AS mass, sum(w * m * u) AS mu, sum(w * m * v) AS mv FROM f GROUP BY i, j)"""


def _points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 60 + 2).cast("int").alias("cell_x"), (F.col("l_suppkey") % 60 + 2).cast("int").alias("cell_y"), (F.col("l_discount") * 9 - 0.45).alias("posx"), (F.col("l_tax") * 10 - 0.4).alias("posy"), F.col("l_quantity").alias("m"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v"))


def _cells(spark, sf_dir):
    m = F.col("m")
    return SC.scatter(_points(spark, sf_dir), {"mass": m, "mu": m * F.col("u"), "mv": m * F.col("v")})


@query(f"WITH {_FAN} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(mass * 1.0123457, 7) AS mass, round(mu / nullif(mass, 0), 6) AS mu, round(mv / nullif(mass, 0), 6) AS mv FROM g")
def scatter_p2g(spark, sf_dir):
    cells = SC.normalise(_cells(spark, sf_dir), "mass", ["mu", "mv"])
    return rounded(cells.withColumn("mass", F.col("mass") * 1.0123457), 6, mass=7)  # the factor keeps sums off rounding ties


@query(f"WITH {_FAN}, c AS (SELECT i, j, mu / nullif(mass, 0) AS gu, mv / nullif(mass, 0) AS gv FROM g) SELECT l_orderkey, l_linenumber, l_partkey, round(sum(w * gu), 5) AS mu, round(sum(w * gv), 5) AS mv FROM f JOIN c USING (i, j) GROUP BY ALL")
def gather_g2p(spark, sf_dir):
    cells = SC.normalise(_cells(spark, sf_dir), "mass", ["mu", "mv"])
    return rounded(SC.gather(_points(spark, sf_dir), cells, ["mu", "mv"], ["l_orderkey", "l_linenumber", "l_partkey"], most=GRID.size_x * GRID.size_y), 5)


@query(
    f"""
    WITH {_FAN}, n AS (SELECT i, j, mu / mass AS vx, mv / mass AS vy, CASE WHEN (i + j) % 11 = 0 THEN 0 ELSE 255 END AS region FROM g WHERE mass <> 0),
    d AS (SELECT *, 0.3 - vx AS ux, 0.1 - vy AS uy, 2.0 - vx AS wx, -1.0 - vy AS wy FROM n),
    k AS (SELECT *, least(0.5, sqrt(ux * ux + uy * uy) * 0.0055 * 1030 / 916 * 0.01) AS k0, least(0.5, sqrt(wx * wx + wy * wy) * 0.0015 * 1.2 / 916 * 0.01) AS k1 FROM d),
    r AS (SELECT i, j, CASE WHEN region = 0 THEN 0 ELSE vx + k0 * ux + k1 * wx END AS nx, CASE WHEN region = 0 THEN 0 ELSE vy + k0 * uy + k1 * wy END AS ny FROM k)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN nx * nx + ny * ny > 312.5 THEN 0 ELSE nx END, 8) AS vx, round(CASE WHEN nx * nx + ny * ny > 312.5 THEN 0 ELSE ny END, 8) AS vy FROM r
    """
)
def node_update_drag(spark, sf_dir):
    c = _cells(spark, sf_dir).select(F.lit(0).alias("field"), "i", "j", "mass", F.col("mu").alias("px"), F.col("mv").alias("py"), F.col("mass").alias("thickness"))
    forcing = c.select("i", "j", F.when((F.col("i") + F.col("j")) % 11 == 0, 0).otherwise(255).alias("region"), F.lit(0.3).alias("cx"), F.lit(0.1).alias("cy"), F.lit(2.0).alias("wx"), F.lit(-1.0).alias("wy"))
    out = SC.node_update(c, forcing, Material(), GRID, 1e9)
    return rounded(out.select("i", "j", "vx", "vy"), 8)


#: lineitem with one row of those that share a point's number.
_ONE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_extendedprice DESC, l_suppkey, l_discount, l_tax, l_quantity, l_returnflag) = 1)"


_POINT_ID = "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey"


def _one(spark, sf_dir):
    """One row a point, with its point_id, by which the rows stay dealt out: one exchange of the columns that are asked for."""
    order = Window.partitionBy("point_id").orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_partkey", "l_linenumber")
    li = table(spark, sf_dir, "lineitem").withColumn("point_id", F.expr(_POINT_ID))
    # the first row has none before it; a row number would also be limited, and all rows sorted, before the exchange
    return li.withColumn("_before", F.lag(F.lit(1)).over(order)).filter("_before IS NULL").drop("_before")


def _states(spark, sf_dir, li=None, more_flags=None):
    """Full point rows from lineitem, one a point_id; rows of `_one` are so already. more_flags: status bits to add, from li's columns."""
    once = li is not None
    li = li if once else table(spark, sf_dir, "lineitem").withColumn("point_id", F.expr(_POINT_ID))
    zero, one = F.lit(0.0), F.lit(1.0)
    flags = F.when(F.col("l_returnflag") == "R", S.CRACKED).otherwise(0)
    values = {
        "point_id": F.col("point_id"), "cell_x": F.col("l_partkey") % 58 + 3, "cell_y": F.col("l_suppkey") % 58 + 3,
        "flags": flags if more_flags is None else flags.bitwiseOR(more_flags), "posx": F.col("l_discount") * 9 - 0.45, "posy": F.col("l_tax") * 10 - 0.4, "velx": F.col("l_discount"), "vely": F.col("l_tax"),
        "thickness": F.col("l_quantity") / 20, "jp_inv": one, "m_squared": one, "a1": zero, "a2": zero, "a3": zero, "ts_old": F.lit(-10.0), "xi": F.lit(5e4),
        "fe00": F.col("l_discount") / 20 + 0.997, "fe01": F.col("l_tax") / 30, "fe10": zero, "fe11": F.lit(1.001) - F.col("l_tax") / 25, "bp00": zero, "bp01": zero, "bp10": zero, "bp11": zero,
        "stored_p": zero, "stored_q": zero, "gamma_p": F.col("l_discount") / 10, "jp_inv_max": one,
    }
    p = li.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in S.POINTS])
    if not once:
        p = p.dropDuplicates(["point_id"])
    from ..functions import physics as P

    f = [F.col(c) for c in ("fe00", "fe01", "fe10", "fe11")]
    return p.withColumns({"stored_p": P.pressure(SOFT, f), "stored_q": P.shear_stress(SOFT, f)})


_KINK = SOFT.shear + SOFT.fracture_tan * (SOFT.shear + SOFT.dp_tan * SOFT.dp_threshold) / (SOFT.dp_tan - SOFT.fracture_tan)


def _surface(x: str) -> str:
    return f"CASE WHEN {x} < {SOFT.dp_threshold!r} THEN 0.0 ELSE least(({x} - {SOFT.dp_threshold!r}) * {SOFT.dp_tan!r}, kink + {SOFT.yield_tan!r} * ({x} - {SOFT.dp_threshold!r} - kink / {SOFT.dp_tan!r})) END"


@query(
    f"""
    WITH s AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS point_id, CASE WHEN l_returnflag = 'R' THEN {S.CRACKED} ELSE 0 END::BIGINT AS f0, l_discount / 20 + 0.997 AS a, l_tax / 30 AS b, 0.0::DOUBLE AS c, 1.001 - l_tax / 25 AS d, l_discount / 10 AS g0 FROM {_ONE}),
    t AS (SELECT *, a * d - b * c AS j, a * a + b * b AS xx, a * c + b * d AS xy, c * c + d * d AS yy FROM s),
    u AS (SELECT *, {-SOFT.kappa / 2!r} * (j * j - 1) AS p, sqrt(2) * {SOFT.mu!r} / j * sqrt((xx - yy) * (xx - yy) / 2 + 2 * xy * xy) AS q, {SOFT.c_residual!r} + {SOFT.c_start - SOFT.c_residual!r} * exp(-g0 / {SOFT.gamma_star!r}) AS soft FROM t),
    v AS (SELECT *, {SOFT.compressive!r} * soft AS cap, {_KINK!r} * soft AS kink, CASE WHEN p <= 0 THEN {SOFT.shear / SOFT.tensile!r} * (p + {SOFT.tensile!r}) ELSE {SOFT.shear!r} + {SOFT.fracture_tan!r} * p END AS env FROM u),
    w AS (SELECT *, f0 = 0 AND (p < {-SOFT.tensile!r} OR NOT (q <= env AND p <= {SOFT.compressive!r})) AS breaks FROM v),
    x AS (SELECT *, CASE WHEN breaks THEN {S.CRACKED} | CASE WHEN p < 0 THEN {S.TENSION} WHEN p > {SOFT.compressive!r} THEN {S.CRUSH} ELSE {S.SHEAR} END ELSE f0 END AS f1, (f0 <> 0 OR breaks) AND p < {SOFT.dp_threshold!r} AS pulled, (f0 <> 0 OR breaks) AND p >= {SOFT.dp_threshold!r} AND q > {_surface("p")} AS flow FROM w),
    y AS (SELECT *, CASE WHEN pulled THEN {S.CRACKED} | {S.TENSION} WHEN flow AND p > cap THEN {S.CRACKED} | {S.CRUSH} WHEN flow THEN {S.CRACKED} | {S.SHEAR} ELSE f1 END AS flags, CASE WHEN flow THEN least(p, cap) ELSE 0.0 END AS pn FROM x),
    z AS (SELECT *, CASE WHEN pulled THEN q * {SOFT.relaxation(GRID.dt)!r} WHEN flow THEN least({_surface("pn")} + (q - ({_surface("pn")})) * {SOFT.relaxation(GRID.dt)!r}, env) ELSE 0.0 END AS qn, sqrt(greatest(1 - 2 * pn / {SOFT.kappa!r}, 0)) AS jn,
      (atan2(c + b, a - d) + atan2(c - b, a + d)) / 2 AS tu, (atan2(c + b, a - d) - atan2(c - b, a + d)) / 2 AS tv, sqrt((a + d) / 2 * (a + d) / 2 + (c - b) / 2 * (c - b) / 2) AS big, sqrt((a - d) / 2 * (a - d) / 2 + (c + b) / 2 * (c + b) / 2) AS small FROM y),
    r AS (SELECT *, CASE WHEN q > 1e-12 THEN qn / q ELSE 0.0 END * ((big + small) * (big + small) - (big - small) * (big - small)) / 2 AS dev FROM z),
    o AS (SELECT *, sqrt(greatest(sqrt(jn * jn + dev * dev) + dev, 1e-12)) AS t0, sqrt(greatest(sqrt(jn * jn + dev * dev) - dev, 1e-12)) * CASE WHEN big - small < 0 THEN -1 ELSE 1 END AS t1, pulled OR flow AS moved FROM r)
    SELECT point_id, flags::BIGINT AS flags, round(CASE WHEN moved THEN least(jn / j, 100.0) ELSE 1.0 END, 8) AS jp_inv, round(CASE WHEN flow THEN g0 + (q - qn) / {2 * SOFT.mu!r} ELSE g0 END, 8) AS gamma_p,
      round(CASE WHEN moved THEN cos(tu) * t0 * cos(tv) + sin(tu) * t1 * sin(tv) ELSE a END, 8) AS fe00, round(CASE WHEN moved THEN cos(tu) * t0 * sin(tv) - sin(tu) * t1 * cos(tv) ELSE b END, 8) AS fe01,
      round(CASE WHEN moved THEN sin(tu) * t0 * cos(tv) - cos(tu) * t1 * sin(tv) ELSE c END, 8) AS fe10, round(CASE WHEN moved THEN sin(tu) * t0 * sin(tv) + cos(tu) * t1 * cos(tv) ELSE d END, 8) AS fe11 FROM o
    """
)
def plastic_return(spark, sf_dir):
    out = plastic_update(_states(spark, sf_dir, _one(spark, sf_dir)), SOFT, GRID.dt)
    return rounded(out.select("point_id", "flags", "jp_inv", "gamma_p", "fe00", "fe01", "fe10", "fe11"), 8)


@query()
def full_step(spark, sf_dir):
    p = _states(spark, sf_dir, _one(spark, sf_dir))
    forcing = spark.range(GRID.size_x * GRID.size_y).select(F.expr(f"CAST(id DIV {GRID.size_y} AS INT)").alias("i"), (F.col("id") % GRID.size_y).cast("int").alias("j"))
    forcing = forcing.withColumns({"region": F.lit(255), "cx": F.lit(0.2), "cy": F.lit(0.0), "wx": F.lit(5.0), "wy": F.lit(1.0)})
    out = SC.step(p, forcing, SOFT, GRID, 600.0)
    return rounded(out.select("point_id", "cell_x", "cell_y", "flags", "posx", "posy", "velx", "vely"), 6)


@query(
    """
    WITH p AS (SELECT DISTINCT ON (id) * FROM (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, CAST(3 + l_partkey % 58 AS INTEGER) AS cx, CAST(3 + l_suppkey % 58 AS INTEGER) AS cy, l_discount * 9 - 0.45 AS px, l_tax * 10 - 0.4 AS py, l_quantity / 20 AS h, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS k FROM lineitem)),
    f AS (SELECT cx + a AS i, cy + b AS j, h, k, h * 916 * 0.25 * (CASE a WHEN -1 THEN 0.5 * (0.5 - px) * (0.5 - px) WHEN 0 THEN 0.75 - px * px ELSE 0.5 * (px + 0.5) * (px + 0.5) END) * (CASE b WHEN -1 THEN 0.5 * (0.5 - py) * (0.5 - py) WHEN 0 THEN 0.75 - py * py ELSE 0.5 * (py + 0.5) * (py + 0.5) END) AS w FROM p, range(-1, 2) x(a), range(-1, 2) y(b))
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(w), 4) AS mass FROM f GROUP BY i, j
    """
)
def render_mass(spark, sf_dir):
    return rounded(SC.render_frame(_states(spark, sf_dir), SOFT, GRID).select("i", "j", "mass"), 4)


@query("WITH n AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS part FROM orders) SELECT o_orderkey, CAST(part AS INTEGER) AS part FROM n")
def equal_count_split(spark, sf_dir):
    return L.equal_count_split(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 7).select("o_orderkey", "part")


@query("SELECT l_partkey % 60 * 60 + l_suppkey % 60 AS cell, count(*) AS n FROM lineitem GROUP BY 1")
def cell_sort(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("cell_x"), (F.col("l_suppkey") % 60).alias("cell_y"))
    return L.sort_by_cell(p, 60).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 4 = 0")
def strided_sample(spark, sf_dir):
    return L.strided(table(spark, sf_dir, "orders"), 4, "o_orderkey", "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_returnflag, max(l_extendedprice) AS l_extendedprice, arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY l_returnflag")
def arg_best(spark, sf_dir):
    return L.argbest(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_orderkey")


@query("SELECT count(*) FILTER (l_tax > 0.07) / count(*) > 0.05 OR (1000000000 - count(*)) / 1e9 < 0.01 AS repartition FROM lineitem")
def repartition_trigger(spark, sf_dir):
    return L.needs_repartition(table(spark, sf_dir, "lineitem"), F.col("l_tax") > 0.07, 1_000_000_000)


@query("WITH p AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem), g AS (SELECT CAST(2 + p % 20 AS INTEGER) AS cell_x, CAST(2 + k % 20 AS INTEGER) AS cell_y FROM p) SELECT cell_x, cell_y, count(*) AS n FROM g GROUP BY ALL")
def points_per_cell(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20 + 2).cast("int").alias("cell_x"), (F.col("l_orderkey") % 20 + 2).cast("int").alias("cell_y"))
    return G.cell_numbers(p)


@query("SELECT CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(least(tx * 64 + 64, 1000) - tx * 64 AS INTEGER) AS w, CAST(least(ty * 64 + 64, 500) - ty * 64 AS INTEGER) AS h FROM range(16) a(tx), range(8) b(ty)")
def tile_grid(spark, sf_dir):
    t = G.tiles(spark, 1000, 500, 64)
    return t.select("tx", "ty", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


@query()
def poisson_sample(spark, sf_dir):
    return G.poisson_disk(spark, 0.05, seed=7)


@query("SELECT l_returnflag, min(l_extendedprice) AS x0, max(l_extendedprice + l_quantity) AS x1, min(l_quantity) AS y0, max(l_quantity * 2) AS y1, min(l_discount + 0.01::DOUBLE) AS resolution FROM lineitem GROUP BY l_returnflag")
def mosaic_extent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    boxes = li.select("l_returnflag", F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") * 2).alias("y1"), (F.col("l_discount") + 0.01).alias("resolution"))
    return G.mosaic_extent(boxes, by=["l_returnflag"])


@query("SELECT CAST(bit_or((CASE WHEN l_tax > 0.079 THEN 1 ELSE 0 END) | (CASE WHEN l_discount > 5 THEN 2 ELSE 0 END)) AS INTEGER) AS errors FROM lineitem")
def error_bits(spark, sf_dir):
    from ..operators.diagnostics import error_bits as bits

    nan = lambda c: F.when(c, F.lit(float("nan"))).otherwise(0.0)
    return bits(table(spark, sf_dir, "lineitem").select(nan(F.col("l_tax") > 0.079).alias("a"), nan(F.col("l_discount") > 5).alias("b")), {"a": 1, "b": 2})


@query("WITH m AS (SELECT DISTINCT p_partkey % 300 AS x FROM part WHERE p_size < 30 AND p_size > 10), p AS (SELECT *, l_partkey % 300 AS x, l_suppkey % 50 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM p WHERE x IN (SELECT x FROM m) AND x > 1 AND x < 298 AND y > 1 AND y < 48")
def candidate_points(spark, sf_dir):
    from ..operators.masks import candidate_points as pick

    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 300).alias("cell_x"), (F.col("l_suppkey") % 50).alias("cell_y"))
    good = table(spark, sf_dir, "part").filter("p_size < 30 AND p_size > 10").select((F.col("p_partkey") % 300).alias("x")).distinct()
    mask = good.join(p.select(F.col("cell_x").alias("x"), F.col("cell_y").alias("y")).distinct(), "x").withColumn("flags", F.lit(S.MASK_ANALYSIS | 3).cast("long"))
    return pick(p, mask, 300, 50).select("l_orderkey", "l_linenumber", "l_partkey")


@query()
def populated_points(spark, sf_dir):
    from ..params import Projection

    n = 24
    grid = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.expr(f"CAST(id DIV {n} AS INT)").alias("y"))
    mask = grid.withColumn("flags", F.lit(S.WATER | S.ICE))
    return G.populate_points(G.poisson_disk(spark, G.sample_radius(2.0, n), seed=5), mask, G.random_thickness(grid, 0.5, 2.5, 3), Projection(80.0, -65.0), n, n)


@query()
def regrid_wind(spark, sf_dir):
    from ..operators import regrid as RG
    from ..params import Projection

    p = Projection(80.0, -65.0, (1000.0, 0.0, -15000.0, 0.0, -1000.0, 15000.0))
    mesh = spark.range(144).select(F.expr("CAST(id DIV 12 AS INT)").alias("r"), (F.col("id") % 12).cast("int").alias("c"))
    mesh = mesh.withColumn("lat", F.lit(79.86) + F.col("r") * 0.025).withColumn("lon", F.lit(-65.8) + F.col("c") * 0.14)
    daily = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("t")).agg(F.avg("value").alias("v"))
    frames = mesh.crossJoin(F.broadcast(daily)).select("t", "r", "c", F.col("v").alias("u10"), (-F.col("v")).alias("v10"), (F.col("v") + F.col("r")).alias("skt"))  # one row a day of the month
    return rounded(RG.regrid_curvilinear(frames, RG.curvilinear_mapping(mesh, p, 30, 30, 0, 0, 30), p), 6)
