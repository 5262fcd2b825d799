"""Queries of masked points, distance fill, nearest cells, stored regridding, ocean rasters on the grid, ordered streams and logs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.generic import epoch_to_iso
from ..operators import layout as L
from ..operators import masks as M
from ..operators import nearest as N
from ..operators import raster as R
from ..operators import regrid as RG
from ..operators import stored_index as SI
from ..operators.lineage import scratch
from ..operators.masked_points import masked_poisson_disk
from ..operators.thermal import strength_step
from ..params import KAPPA_ICE
from ..sources import frames as FR
from ..streaming import ordered as OS
from .queries_geo import _PLANE, PROJECTION, _positions, _shift
from .queries_more import _ID, ocean_fields  # noqa: F401  (its SQL is part of ocean_on_grid's)
from .queries_points import _ONE, _one, _states
from .registry import ORACLE_SQL, query, table

RADIUS = 1.7
_MASK = "SELECT DISTINCT CAST(o_custkey % 120 AS INTEGER) AS x, CAST(o_orderkey % 90 AS INTEGER) AS y FROM orders WHERE o_orderpriority < '3'"


def _pairs_within(points, radius: float):
    """Pairs of points nearer than the radius."""
    p = points.withColumn("id", F.monotonically_increasing_id()).withColumns({"bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    q = p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "bx", "by", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("ox"))
    q = q.withColumn("oy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumns({"bx": F.col("bx") + F.col("ox"), "by": F.col("by") + F.col("oy")})
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return p.join(q, ["bx", "by"]).filter((F.col("id") < F.col("id2")) & (d2 < radius * radius))


@query(f"SELECT count(*) AS n_cells, 0::BIGINT AS too_close, 0::BIGINT AS uncovered, 0::BIGINT AS outside, true AS enough FROM ({_MASK})")
def masked_points(spark, sf_dir):
    """Properties of a sample in a mask of many components: none too close, no good cell's centre uncovered, none outside."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority < '3'")
    cells = o.select((F.col("o_custkey") % 120).cast("int").alias("x"), (F.col("o_orderkey") % 90).cast("int").alias("y")).distinct()
    points = masked_poisson_disk(cells, RADIUS, seed=11)
    home = points.select(F.floor(F.col("x") + 0.5).cast("int").alias("x"), F.floor(F.col("y") + 0.5).cast("int").alias("y"))
    counts = {
        "n_cells": cells.agg(F.count("*").alias("n_cells")),
        "too_close": _pairs_within(points, RADIUS).agg(F.count("*").alias("too_close")),
        "uncovered": M.radius_anti(cells, points, RADIUS).agg(F.count("*").alias("uncovered")),
        "outside": home.join(cells, ["x", "y"], "left_anti").agg(F.count("*").alias("outside")),
        "n": points.agg(F.count("*").alias("n")),
    }
    out = counts.pop("n_cells")
    for c in counts.values():
        out = out.crossJoin(c)  # one row each
    # as disks cover all cells, so many at least are needed
    return out.withColumn("enough", F.col("n") * (math.pi * RADIUS**2) >= F.col("n_cells")).drop("n")


_CELLS = "SELECT l_partkey % 300 AS x, l_suppkey % 100 AS y, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL"


@query(
    f"""
    WITH v AS (SELECT x, y, CASE WHEN x % 100 < 3 AND y < 60 AND n % 2 = 0 THEN n END AS n FROM ({_CELLS})),
    b AS (SELECT a.x, a.y, arg_min(s.n, ((a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y), s.x, s.y)) AS f FROM v a JOIN v s ON s.n IS NOT NULL AND (a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y) <= 10000 WHERE a.n IS NULL GROUP BY a.x, a.y)
    SELECT x, y, coalesce(v.n, b.f) AS n FROM v LEFT JOIN b USING (x, y)
    """
)
def fill_far(spark, sf_dir):
    """Few known cells in narrow strips, filled up to 100 cells away, in tiles smaller than the raster."""
    keys = [(F.col("l_partkey") % 300).alias("x"), (F.col("l_suppkey") % 100).alias("y")]
    cells = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("n"))
    known = (F.col("x") % 100 < 3) & (F.col("y") < 60) & (F.col("n") % 2 == 0)
    return R.fill_nearest(cells.withColumn("n", F.when(known, F.col("n"))), "n", 100, tile=128)


@query(
    """
    WITH cells AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, 74 + (p_partkey // 50) % 40 * 0.3::DOUBLE AS lat, ((p_partkey % 50) * 7.2::DOUBLE + (p_partkey // 50) * 0.37::DOUBLE) % 360 AS lon FROM part),
    sites AS (SELECT c_custkey, c_nationkey, 70 + (c_custkey * 37) % 1600 / 100.0::DOUBLE AS lat, (c_custkey * 53) % 3600 / 10.0::DOUBLE - 180 AS lon FROM customer),
    near AS (SELECT c_custkey, c_nationkey, arg_min({'r': r, 'c': c}, ((c_lat - lat) * (c_lat - lat) + d * d, r, c)) AS m
        FROM (SELECT s.*, cells.r, cells.c, cells.lat AS c_lat, cells.lon - s.lon - 360 * round((cells.lon - s.lon) / 360) AS d FROM sites s, cells) GROUP BY ALL),
    days AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS t, avg(value) AS v FROM events GROUP BY 1)
    SELECT c_nationkey, c_custkey, m.r::BIGINT AS r, m.c::BIGINT AS c, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, t AS epoch_unix, round(v / 10 + m.r * 0.25 - m.c * 0.5 + 240 - 273.15, 6) AS temperature_C
    FROM near, days
    """
)
def site_series_written_and_read(spark, sf_dir):
    """The series of the cell nearest to each customer's place, written by nation and read back."""
    r, c = F.expr("p_partkey DIV 50"), F.col("p_partkey") % 50
    cells = table(spark, sf_dir, "part").select(r.alias("r"), c.alias("c"), (74 + r % 40 * 0.3).alias("lat"), ((c * 7.2 + r * 0.37) % 360).alias("lon"))
    key = F.col("c_custkey")
    sites = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (70 + (key * 37) % 1600 / 100.0).alias("lat"), ((key * 53) % 3600 / 10.0 - 180).alias("lon"))
    days = table(spark, sf_dir, "events").groupBy(F.unix_seconds(F.date_trunc("day", "ts")).alias("t")).agg(F.avg("value").alias("v"))
    frames = cells.select("r", "c").crossJoin(F.broadcast(days)).select("t", "r", "c", (F.col("v") / 10 + F.col("r") * 0.25 - F.col("c") * 0.5 + 240).alias("skt"))  # one row a day
    at = scratch(spark, "series")
    FR.write_site_series(N.site_series(N.nearest_cells(sites, cells), frames, ["c_nationkey", "c_custkey", "r", "c"]), at, "c_nationkey")
    back = FR.read_site_series(spark, at, "c_nationkey int, c_custkey long, r long, c long")
    return back.withColumn("temperature_C", F.round("temperature_C", 6))


@query(
    """
    WITH mesh AS (SELECT DISTINCT (l_partkey % 70)::BIGINT AS r, (l_suppkey % 45)::BIGINT AS c FROM lineitem),
    days AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS t, avg(value) AS v FROM events GROUP BY 1),
    frames AS (SELECT t, r, c, v / 10 + r * 0.5::DOUBLE - c * c * 0.01::DOUBLE AS skt FROM mesh, days),
    cells AS (SELECT DISTINCT o_custkey % 200 AS i, o_orderkey % 150 AS j FROM orders),
    quads AS (SELECT i, j, (i * 7 + j) % 69 AS r, (i + j * 3) % 44 AS c, (i % 11) / 10.0::DOUBLE AS s, (j % 9) / 8.0::DOUBLE AS t FROM cells WHERE (i + j) % 5 <> 0)
    SELECT days.t, cells.i, cells.j, CASE WHEN q.i IS NULL THEN 0.0 ELSE round(f.skt * (1 - s) * (1 - q.t) + g.skt * s * (1 - q.t) + h.skt * (1 - s) * q.t + k.skt * s * q.t, 6) END AS temperature
    FROM cells CROSS JOIN days LEFT JOIN quads q ON q.i = cells.i AND q.j = cells.j
    LEFT JOIN frames f ON f.t = days.t AND f.r = q.r AND f.c = q.c
    LEFT JOIN frames g ON g.t = days.t AND g.r = q.r AND g.c = q.c + 1
    LEFT JOIN frames h ON h.t = days.t AND h.r = q.r + 1 AND h.c = q.c
    LEFT JOIN frames k ON k.t = days.t AND k.r = q.r + 1 AND k.c = q.c + 1
    """
)
def regrid_stored(spark, sf_dir):
    """Stored frames of a raster of 70 by 45 through a stored mapping; cells without a quad are 0."""
    mesh = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 70).alias("r"), (F.col("l_suppkey") % 45).alias("c")).distinct()
    days = table(spark, sf_dir, "events").groupBy(F.unix_seconds(F.date_trunc("day", "ts")).alias("t")).agg(F.avg("value").alias("v"))
    frames = mesh.crossJoin(F.broadcast(days)).select("t", "r", "c", (F.col("v") / 10 + F.col("r") * 0.5 - F.col("c") * F.col("c") * 0.01).alias("skt"))  # one row a day
    cells = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("i"), (F.col("o_orderkey") % 150).alias("j")).distinct()
    i, j = F.col("i"), F.col("j")
    st = F.struct((i % 11 / 10.0).alias("s"), (j % 9 / 8.0).alias("t"))
    mapping = cells.filter((i + j) % 5 != 0).select("i", "j", ((i * 7 + j) % 69).alias("r"), ((i + j * 3) % 44).alias("c"), st.alias("st"))
    name, at = f"stored_{uuid.uuid4().hex}", scratch(spark, "stored")
    SI.store_frames(frames, (70, 45), f"{name}_frames", f"{at}/frames", 8, values=["skt"])
    SI.store_mapping(mapping, (70, 45), f"{name}_mapping", f"{at}/mapping", 8, cells=cells)
    out = SI.regrid_stored(spark.table(f"{name}_frames"), spark.table(f"{name}_mapping"), wind=False)
    return out.withColumn("temperature", F.round("temperature", 6))


@query(
    """
    WITH e AS (SELECT user_id, ts, floor(value / 100)::BIGINT AS frame, max(ts) OVER () - INTERVAL 1 HOUR AS passed FROM events),
    w AS (SELECT *, lag(frame) OVER (PARTITION BY user_id ORDER BY ts, frame) AS before FROM e)
    SELECT user_id, epoch_us(ts) AS us, frame FROM w WHERE (before IS NULL OR before <> frame) AND ts <= date_trunc('milliseconds', passed)
    """
)
def ordered_frame_changes(spark, sf_dir):
    """A stream of events that keeps rows in state until the watermark has passed them, written and read back."""
    before, at = spark.conf.get(OS.PROVIDER), scratch(spark, "changes")
    spark.conf.set(OS.PROVIDER, OS.ROCKSDB)
    try:
        source = f"{sf_dir}/events.parquet"
        events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]")  # a pattern may be a file or a folder
        events = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") / 100).alias("frame"))
        out = OS.ordered_changes(events, "user_id", "ts", "frame", "1 hour")
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(OS.PROVIDER, before)
    return spark.read.parquet(f"{at}/out").select("user_id", F.unix_micros("ts").alias("us"), "frame")


@query(
    f"""
    WITH f AS ({ORACLE_SQL["ocean_fields"]}), {_PLANE},
    h AS (SELECT t, r, c, sithick, avg(uo) OVER w AS a, avg(vo) OVER w AS b FROM f WINDOW w AS (PARTITION BY t, r ORDER BY c ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    g AS (SELECT t, r, c, sithick, avg(a) OVER w AS uo, avg(b) OVER w AS vo FROM h WINDOW w AS (PARTITION BY t, c ORDER BY r ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    pos AS (SELECT k, CAST(k % 12 * 3600 AS BIGINT) - 631152000 AS t, (lat - 78.3::DOUBLE) / 0.8::DOUBLE AS yy, (lon + 71.5::DOUBLE) / 1.5::DOUBLE AS xx FROM xy),
    u AS (SELECT *, floor(yy)::INT AS r0, floor(xx)::INT AS c0 FROM pos),
    v AS (SELECT u.k, u.t, a, b, (CASE a WHEN 0 THEN 1 - (yy - r0) ELSE yy - r0 END) * (CASE b WHEN 0 THEN 1 - (xx - c0) ELSE xx - c0 END) AS wt, r0 + a AS r, c0 + b AS c
        FROM u, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b) WHERE r0 >= 0 AND c0 >= 0 AND r0 < 5 AND c0 < 5),
    s AS (SELECT u.k, u.t, coalesce(sum(wt * uo), 0) AS uo, coalesce(sum(wt * vo), 0) AS vo, coalesce(sum(wt * sithick), 0) AS thickness
        FROM u LEFT JOIN v ON v.k = u.k LEFT JOIN g ON g.t = v.t AND g.r = v.r AND g.c = v.c GROUP BY u.k, u.t),
    nn AS (SELECT k, {_shift('1e-5', '0.0')} FROM xy), ee AS (SELECT k, {_shift('0.0', '1e-5')} FROM xy)
    SELECT s.t, s.k, round(uo * ee.dx / sqrt(ee.dx * ee.dx + ee.dy * ee.dy) + vo * nn.dx / sqrt(nn.dx * nn.dx + nn.dy * nn.dy), 4) AS vx,
        round(uo * ee.dy / sqrt(ee.dx * ee.dx + ee.dy * ee.dy) + vo * nn.dy / sqrt(nn.dx * nn.dx + nn.dy * nn.dy), 4) AS vy, round(thickness, 9) AS thickness
    FROM s JOIN nn USING (k) JOIN ee USING (k)
    """
)
def ocean_on_grid(spark, sf_dir):
    """A regular ocean raster from packed values to grid vectors: unpacked, tides added, nearest thickness, blurred, looked up, turned."""
    k = F.col("p_partkey")
    o = table(spark, sf_dir, "part").groupBy((k % 12).alias("hours_1950"), F.expr("CAST(p_partkey DIV 12 % 6 AS INT)").alias("r"), F.expr("CAST(p_partkey DIV 72 % 6 AS INT)").alias("c")).agg(F.max("p_size").alias("raw"))
    currents = o.select("hours_1950", "r", "c", F.col("raw").alias("uo"), (F.col("raw") * 2).alias("vo"))
    tides = o.filter("hours_1950 % 2 = 0").select("hours_1950", "r", "c", (F.col("raw") % 9).alias("utide"), (F.col("raw") % 9).alias("vtide"))
    ice = o.filter("hours_1950 IN (1, 8)").select("hours_1950", "r", "c", (F.col("raw") + 1).alias("sithick"))
    frames = RG.ocean_frames(currents, tides, ice, 0.01, 0.5, 7.0)
    cells = _positions(spark, sf_dir).select(((F.col("k") % 12) * 3600 - 631152000).alias("t"), F.col("k").alias("i"), F.lit(0).alias("j"), "lat", "lon")
    out = RG.regrid_regular(frames, cells, PROJECTION, (78.3, -71.5), (0.8, 1.5), (6, 6))
    return out.select("t", F.col("i").alias("k"), F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"), F.round("thickness", 9).alias("thickness"))


@query(
    """
    WITH d AS (SELECT l_linenumber AS frame, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1)
    SELECT frame, 1704067200 + frame::BIGINT * 300 AS epoch_utc, strftime(make_timestamp((1704067200 + frame::BIGINT * 300) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS datetime_utc, top AS ice_strength_max, n::DOUBLE AS wind_speed_mean FROM d
    """
)
def report_written_and_read(spark, sf_dir):
    """A diagnostics report as CSV, written and read by its columns' places."""
    li, at = table(spark, sf_dir, "lineitem"), scratch(spark, "report")
    d = li.groupBy(F.col("l_linenumber").cast("int").alias("frame")).agg(F.count("*").cast("double").alias("wind_speed_mean"), F.max("l_quantity").alias("ice_strength_max"))
    epoch = F.lit(1704067200).cast("long") + F.col("frame") * 300
    rest = {m: F.lit(0.0) for m in S.MEASURES if m not in d.columns}
    FR.write_report(d.withColumns({"epoch_utc": epoch, "datetime_utc": epoch_to_iso(epoch)} | rest), at)
    return FR.read_report(spark, at).select("frame", "epoch_utc", "datetime_utc", "ice_strength_max", "wind_speed_mean")


@query("SELECT o_orderpriority AS phase, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def log_appended_and_read(spark, sf_dir):
    """A log that grows by several appends, each with its own header, read back whole."""
    at = scratch(spark, "log")
    for k in range(3):
        part = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 == k)
        FR.append_log(part.groupBy(F.col("o_orderpriority").alias("phase")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), at)
    back = spark.read.csv(at, schema="phase string, n long, total double", header=True)
    return back.groupBy("phase").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


@query("SELECT l_partkey % 60 * 60 + l_suppkey % 60 AS cell, count(*) AS n, 0::BIGINT AS unsorted FROM lineitem GROUP BY 1")
def cell_order(spark, sf_dir):
    """Points by cell, with how many of the stored rows stand before one of a lower cell, over files in their order."""
    li, at = table(spark, sf_dir, "lineitem"), scratch(spark, "cells")
    p = li.select((F.col("l_partkey") % 60).alias("cell_x"), (F.col("l_suppkey") % 60).alias("cell_y"))
    L.sort_by_cell(p, 60).write.parquet(at)
    # rows of one file keep their order; the numbers of the files follow the ranges
    back = spark.read.parquet(at).select("cell", "_metadata.file_name", "_metadata.row_index")
    w = Window.partitionBy("file_name").orderBy("row_index")
    steps = back.select("cell", "file_name", (F.lag("cell").over(w) > F.col("cell")).alias("down"))
    files = steps.groupBy("file_name").agg(F.count_if("down").alias("n"), F.min("cell").alias("a"), F.max("cell").alias("b"))
    cross = F.lag("b").over(Window.orderBy("file_name")) > F.col("a")  # one row a file
    wrong = files.withColumn("cross", cross).agg((F.sum("n") + F.count_if("cross")).alias("unsorted"))
    return back.groupBy("cell").agg(F.count("*").alias("n")).crossJoin(wrong)


_SPLINE = "(CASE {d} WHEN -1 THEN 0.5 * (0.5 - {p}) * (0.5 - {p}) WHEN 0 THEN 0.75 - {p} * {p} ELSE 0.5 * ({p} + 0.5) * ({p} + 0.5) END)"


@query(
    f"""
    WITH s AS (SELECT {_ID} AS id, 3 + l_partkey % 58 AS cx, 3 + l_suppkey % 58 AS cy, l_discount * 9 - 0.45::DOUBLE AS px, l_tax * 10 - 0.4::DOUBLE AS py, l_quantity / 20 AS h, l_linestatus = 'F' AND l_quantity > 40 AS off FROM {_ONE}),
    o AS (SELECT o_custkey % 64 AS i, o_orderkey % 64 AS j, avg(o_totalprice) / 50000 AS v FROM orders GROUP BY ALL),
    g AS (SELECT i, j, 250 + coalesce(v, 0) AS t0, 255 - coalesce(v, 0) * 2 AS t1 FROM (SELECT a.i, b.j FROM range(64) a(i), range(64) b(j)) LEFT JOIN o USING (i, j)),
    w AS (SELECT id, sum({_SPLINE.format(d="a", p="px")} * {_SPLINE.format(d="b", p="py")} * (0.75 * t0 + 0.25 * t1)) - 273.15 AS new
        FROM s, range(-1, 2) x(a), range(-1, 2) y(b), g WHERE g.i = cx + a AND g.j = cy + b GROUP BY id),
    c AS (SELECT id, h, new, n, h * h / ({KAPPA_ICE!r} * pi() * pi() * n * n) AS tau, (new + 10) / 3600 * 2 / (n * pi()) AS b FROM s JOIN w USING (id), (VALUES (1), (2), (3)) t(n)),
    m AS (SELECT id, h, new, max(b * tau * exp(-3600 / tau) - b * tau) FILTER (n = 1) AS a1, max(b * tau * exp(-3600 / tau) - b * tau) FILTER (n = 2) AS a2, max(b * tau * exp(-3600 / tau) - b * tau) FILTER (n = 3) AS a3 FROM c GROUP BY ALL),
    z AS (SELECT *, (k + 0.5) / 8 AS f FROM m, range(8) r(k)),
    d AS (SELECT id, new + (-1.8 - new) * f + a1 * sin(pi() * f) + a2 * sin(2 * pi() * f) + a3 * sin(3 * pi() * f) AS t FROM z),
    x AS (SELECT id, avg(1.76e6 * exp(-5.88 * sqrt(least(1.0, greatest(0.0, 0.006 * (49.185 / greatest(-t, 1e-6) + 0.532)))))) AS xi FROM d GROUP BY id)
    SELECT s.id AS point_id, CASE WHEN off THEN -10.0 ELSE round(new, 7) END AS ts_old, CASE WHEN off THEN 0.0 ELSE round(a1, 7) END AS a1, CASE WHEN off THEN 50000.0 ELSE round(xi, 2) END AS xi
    FROM s JOIN m USING (id) JOIN x USING (id)
    """
)
def strength_from_grid(spark, sf_dir):
    """The strength step from the gather of the grid's temperature to xi; some points are disabled."""
    li = _one(spark, sf_dir)
    off = F.when(F.expr("l_linestatus = 'F' AND l_quantity > 40"), F.lit(S.DISABLED)).otherwise(F.lit(0))
    p = _states(spark, sf_dir, li, off)
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 64).alias("i"), (F.col("o_orderkey") % 64).alias("j")).agg((F.avg("o_totalprice") / 50000).alias("v"))
    grid = spark.range(64 * 64).select(F.expr("id DIV 64").alias("i"), (F.col("id") % 64).alias("j")).join(o, ["i", "j"], "left").fillna(0.0, ["v"])
    out = strength_step(p, grid.select("i", "j", (F.lit(250.0) + F.col("v")).alias("t0"), (F.lit(255.0) - F.col("v") * 2).alias("t1")), 0.25, 3600.0, 6.0, most=64 * 64)
    return out.select("point_id", F.round("ts_old", 7).alias("ts_old"), F.round("a1", 7).alias("a1"), F.round("xi", 2).alias("xi"))


@query(
    """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 7919) % 1048576, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
    SELECT d AS draw, o_orderkey, o_totalprice FROM range(20000) t(d) JOIN r ON r.k = (d * 7368787 + 12345) % n
    """
)
def drawn_with_replacement(spark, sf_dir):
    """20,000 draws from all orders; at the smaller sizes many rows come several times."""
    spread = F.col("o_orderkey") * 7919 % 1048576
    out = L.sample_with_replacement(table(spark, sf_dir, "orders"), ["o_orderkey"], 20_000, spread=spread, rank=lambda d, n: (d * 7368787 + 12345) % n, per_range=1000)
    return out.select("draw", "o_orderkey", "o_totalprice")
