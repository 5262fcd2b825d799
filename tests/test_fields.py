"""Masked point generation, distance fill, nearest cells of many sites and exact medians against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distance, masked_points
from gridloom.operators import layout as L
from gridloom.operators import nearest as N
from gridloom.operators import raster as R
from gridloom.operators import regrid as RG
from gridloom.operators import scatter as SC
from gridloom.operators import stored_index as SI
from gridloom.operators import timeseries as TS
from gridloom.params import Projection
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def components():
    """A block, a ring, a single far cell, a diagonal of cells that touch at corners only, and a second block below 0."""
    cells = {(x, y) for x in range(12) for y in range(9)}
    cells |= {(x, y) for x in range(30, 41) for y in range(30, 41) if max(abs(x - 35), abs(y - 35)) == 5}
    return cells | {(200, -50)} | {(60 + k, k) for k in range(8)} | {(x, y) for x in range(-30, -24) for y in range(-20, -10)}


@pytest.mark.parametrize("radius", [0.7, 2.5, 9.0])
def test_masked_points_cover_every_component(spark, radius):
    cells = components()
    rows = [(x, y, "a") for x, y in cells] + [(0, 0, "again"), (None, 3, "b"), (3, None, "c")]
    df = spark.createDataFrame(rows, "x int, y int, rank string")
    p = np.array(sorted((r.x, r.y) for r in masked_points.masked_poisson_disk(df, radius, seed=4).collect()))
    assert all((int(np.floor(x + 0.5)), int(np.floor(y + 0.5))) in cells for x, y in p)
    apart = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(apart, np.inf)
    assert apart.min() >= radius**2
    rng = np.random.default_rng(1)
    spots = np.array(sorted(cells))[:, None] + rng.random((1, 60, 2)) - 0.5
    spots = np.concatenate([spots.reshape(-1, 2), np.array(sorted(cells))])
    assert ((spots[:, None] - p[None]) ** 2).sum(-1).min(1).max() < radius**2  # no place is left
    again = masked_points.masked_poisson_disk(df.repartition(7), radius, seed=4).collect()
    assert sorted((r.x, r.y) for r in again) == [tuple(r) for r in p.tolist()]


def test_masked_points_of_nothing(spark):
    none = spark.createDataFrame([], "x int, y int")
    assert masked_points.masked_poisson_disk(none, 2.0).collect() == []
    with pytest.raises(ValueError):
        masked_points.masked_poisson_disk(none, 0.0)


def brute_fill(cells, radius):
    known = [(x, y, v) for (x, y), v in cells.items() if v is not None]
    out = {}
    for (x, y), v in cells.items():
        near = min((((x - a) ** 2 + (y - b) ** 2, a, b, w) for a, b, w in known), default=None)
        out[x, y] = v if v is not None or near is None or near[0] > radius * radius else near[3]
    return out


@pytest.mark.parametrize("radius,tile", [(100, 512), (100, 40), (7, 16), (3, 1), (0, 5)])
def test_fill_far_equals_brute_force(spark, radius, tile):
    rng = random.Random(radius + tile)
    cells = {(x, y): None for x in range(-20, 110) for y in range(-60, 20) if rng.random() < 0.4}
    for at in rng.sample(sorted(cells), 25):
        cells[at] = f"v{at}"
    df = spark.createDataFrame([(x, y, v, "t") for (x, y), v in cells.items()], "x int, y int, v string, tx string")
    got = R.fill_nearest(df, "v", radius, tile)
    assert {(r.x, r.y): r.v for r in got.collect()} == brute_fill(cells, radius) and got.columns == df.columns


def test_fill_odd_rasters(spark):
    schema = "x int, y int, v double"
    assert R.fill_nearest(spark.createDataFrame([], schema), "v", 9).collect() == []
    rows = [(0, 0, None), (0, 0, None), (None, 1, None), (5, 5, None)]
    assert sorted(map(tuple, R.fill_nearest(spark.createDataFrame(rows, schema), "v", 9).collect()), key=repr) == sorted(rows, key=repr)
    twice = spark.createDataFrame([(0, 0, None), (0, 0, None), (1, 0, 4.0), (None, 0, 9.0)], schema)
    assert sorted(map(tuple, R.fill_nearest(twice, "v", 2).collect()), key=repr) == sorted([(0, 0, 4.0), (0, 0, 4.0), (1, 0, 4.0), (None, 0, 9.0)], key=repr)


def test_fill_rows_are_linear(spark):
    """Rows that reach the tiles, at a radius of 100: no hole meets its candidates one by one."""
    n = 300
    df = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), (F.col("id") / n).cast("int").alias("y"), F.when(F.col("id") % 997 == 0, F.col("id")).alias("v"))
    assert distance.nearest_known(df, "v", 100, 512).count() == n * n - df.filter("v IS NOT NULL").count()


def wrapped(d):
    return d - 360 * np.sign(d) * np.floor(np.abs(d) / 360 + 0.5)


@pytest.mark.parametrize("kind", ["grid", "cluster", "few"])
def test_nearest_cells_of_many_sites(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "grid":
        cells = [(r, c, 60 + r * 0.5 + c * 0.01, (c * 3.7 + r * 0.2) % 360) for r in range(50) for c in range(97)]
    elif kind == "cluster":  # dense on one side, far from most sites, and copies of places
        cells = [(r, c, -75.0 + r * 0.01, 359.5 + c * 0.01 - (360 if c > 50 else 0)) for r in range(60) for c in range(100)] + [(900, k, -74.9, 0.1) for k in range(50)]
    else:
        cells = [(0, 0, 89.9, 10.0), (0, 1, -89.0, -170.0), (1, 0, 0.0, 179.9)]
    odd = [(7, 7, None, 1.0), (8, 8, float("nan"), 1.0), (9, 9, 95.0, 1.0), (9, 8, 1.0, float("inf"))]
    df = spark.createDataFrame([(*map(int, c[:2]), *c[2:], 1) for c in cells + odd], "r int, c int, lat double, lon double, bx int")
    places = [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 540, 300))] + [(90.0, 0.0), (-90.0, 180.0), (0.0, -180.0), (60.0, 359.999)]
    sites = [(k, a, o) for k, (a, o) in enumerate(places + places[:5])] + [(998, None, 1.0), (999, 91.0, 0.0)]
    got = N.nearest_cells(spark.createDataFrame([(*s, "x") for s in sites], "site int, lat double, lon double, key string"), df, full=4).collect()
    assert len(got) == len(sites)
    lat, lon = (np.array([c[k] for c in cells]) for k in (2, 3))
    for r in got:
        if r.site >= 998:
            assert r.r is None and r.d2 is None
            continue
        d2 = (lat - r.lat) ** 2 + wrapped(lon - r.lon) ** 2
        assert abs(r.d2 - d2.min()) < 1e-9, r
        least = min(cells[k][:2] for k in np.flatnonzero(d2 <= d2.min() + 1e-12))
        assert (r.r, r.c) == least or abs(d2[[c[:2] for c in cells].index((r.r, r.c))] - d2.min()) < 1e-12


def test_sites_without_cells(spark):
    sites = spark.createDataFrame([(1, 2.0, 3.0)], "site int, lat double, lon double")
    none = spark.createDataFrame([], "r int, c int, lat double, lon double")
    assert [tuple(r) for r in N.nearest_cells(sites, none).collect()] == [(1, 2.0, 3.0, None, None, None, None, None)]


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 5001])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.exp(rng.normal(0, 30, n)), np.full(n, 2.5)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        for few in (4096, 4):
            assert TS.exact_median(df, "v", buckets=16, few=few) == np.median(values)
    assert TS.exact_median(df.filter("v > 1e300 AND NOT isnan(v)"), "v") is None


def test_spacings_in_chunks(spark):
    rng = random.Random(2)
    times = [rng.randrange(10**6) for _ in range(2000)] + [10**9, 10**9]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t long")
    want = sorted(float(d) for d in np.diff(sorted(times)))
    for rows in (100_000, 50, 1):
        assert sorted(r.d for r in TS.spacings(df, "t", rows).collect()) == want
    assert TS.window_samples(df, "t", 5000.0, 50) == TS.window_samples(df, "t", 5000.0)
    assert TS.window_samples(df.limit(0), "t", 5000.0) == 1


def test_site_series_have_all_frames(spark):
    got = catalogue.QUERIES["site_series_written_and_read"](spark, SF)
    days = spark.read.parquet(f"{SF}/events.parquet").select(F.to_date("ts")).distinct().count()
    assert got.groupBy("c_custkey").count().filter(F.col("count") != days).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", [(12, 12), (9, 5), (40, 34)])
def test_stored_regrid_equals_joins_and_needs_no_exchange(spark, tmp_path, shape):
    rows, cols = shape
    p = Projection(80.0, -65.0, (1000.0, 0.0, -15000.0, 0.0, -1000.0, 15000.0))
    mesh = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    mesh = mesh.withColumns({"lat": F.lit(79.86) + F.col("r") * (0.28 / rows) + F.col("c") * 0.001, "lon": F.lit(-65.8) + F.col("c") * (1.6 / cols) + 360})
    frames = mesh.withColumn("t", F.explode(F.array(F.lit(0), F.lit(3600), F.lit(7200))))
    frames = frames.withColumns({"u10": F.sin(F.col("r") * 0.7 + F.col("t")), "v10": F.cos(F.col("c") * 1.3), "skt": F.col("r") * 1.5 - F.col("c") + F.col("t") / 1000})
    mapping = RG.curvilinear_mapping(mesh, p, 34, 34, 0, 0, 34)
    cells = spark.range(34 * 34).select((F.col("id") / 34).cast("int").alias("i"), (F.col("id") % 34).cast("int").alias("j"))
    name = f"own_{rows}_{cols}"
    for k in (0, 1):  # frames are added as they come
        SI.store_frames(frames.filter(F.col("t") > 0 if k else F.col("t") == 0), shape, f"{name}_f", str(tmp_path / "f"), 4, block=7)
    SI.store_mapping(mapping, shape, f"{name}_m", str(tmp_path / "m"), 4, p, block=7, cells=cells)
    got = SI.regrid_stored(spark.table(f"{name}_f"), spark.table(f"{name}_m"))
    assert "Exchange" not in plan_of(got)
    want = {(r.t, r.i, r.j): (r.vx, r.vy, r.temperature) for r in RG.regrid_curvilinear(frames, mapping, p).collect()}
    have = {(r.t, r.i, r.j): (r.vx, r.vy, r.temperature) for r in got.collect()}
    assert len(have) == 3 * 34 * 34 and 0 < len(want) < len(have)
    for key, values in have.items():
        assert values == pytest.approx(want.get(key, (0.0, 0.0, 0.0)), abs=1e-9)
    again = SI.attach(spark, f"{name}_again", str(tmp_path / "f"), 4)
    later = SI.regrid_stored(again.filter("t = 3600"), spark.table(f"{name}_m"), wind=False)
    plan = plan_of(later)
    assert "Exchange" not in plan and later.columns == ["t", "i", "j", "temperature"] and later.count() == 34 * 34
    assert "u10" not in plan.split("Scan parquet")[1].split("ReadSchema")[1][:200]


def test_draws_with_replacement(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("k"), F.lit("x").alias("draw2"), (F.col("id") % 7).alias("_n"))
    got = L.sample_with_replacement(df, ["k"], 8000, seed=5, per_range=100).collect()
    again = L.sample_with_replacement(df.repartition(9), ["k"], 8000, seed=5, per_range=100).collect()
    other = L.sample_with_replacement(df, ["k"], 8000, seed=6, per_range=5000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and sorted(r.draw for r in got) == list(range(8000))
    counts = np.bincount([r.k // 3 for r in got], minlength=5000)
    assert abs((counts > 0).mean() - (1 - np.exp(-1.6))) < 0.03 and counts.max() < 12  # as of independent draws
    assert {(r.draw, r.k) for r in got} != {(r.draw, r.k) for r in other} and len(other) == 8000
    assert L.sample_with_replacement(df.limit(0), ["k"], 3).collect() == []
    one = L.sample_with_replacement(df.limit(1), ["k"], 4).collect()
    assert len(one) == 4 and len({r.k for r in one}) == 1


@pytest.mark.parametrize("tile", [16, 3])
def test_gather_by_tile_equals_fan_out(spark, tile):
    rng = random.Random(tile)
    cells = spark.createDataFrame([(f, i, j, rng.uniform(-1, 1), rng.uniform(-1, 1) if rng.random() < 0.9 else None) for f in (0, 1) for i in range(-2, 20) for j in range(0, 25) if rng.random() < 0.8], "field int, i int, j int, vx double, vy double")
    points = spark.createDataFrame([(k, k % 3, rng.randrange(-3, 22), rng.randrange(-2, 27), rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5)) for k in range(400)], "point_id long, field int, cell_x int, cell_y int, posx double, posy double")
    got = {r.point_id: (r.vx, r.vy, r.vx_dx, r.vy_dy) for r in SC.gathered(points, cells, ["vx", "vy"], ["field"], tile).collect()}
    at = SC.fan_out(points).join(cells, ["field", "i", "j"], "left").fillna(0.0, ["vx", "vy"])
    w = F.col("w")
    want = at.groupBy("point_id").agg(F.sum(w * F.col("vx")).alias("a"), F.sum(w * F.col("vy")).alias("b"), F.sum(w * F.col("vx") * F.col("dx")).alias("c"), F.sum(w * F.col("vy") * F.col("dy")).alias("d"))
    rows = want.collect()
    assert len(got) == len(rows) == 400
    for r in rows:
        assert got[r.point_id] == pytest.approx((r.a, r.b, r.c, r.d), abs=1e-12)


def test_stored_frames_with_absent_cells(spark, tmp_path):
    """A cell with an absent corner is null, also where its whole block is absent; one without a quad is 0."""
    frames = spark.createDataFrame([(7, r, c, float(r)) for r in range(3) for c in range(3)], "t long, r int, c int, skt double")
    st = F.struct(F.lit(0.5).alias("s"), F.lit(0.5).alias("t"))
    mapping = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 2, 2), (0, 2, 8, 8)], "i int, j int, r int, c int").withColumn("st", st)
    cells = spark.createDataFrame([(0, k) for k in range(6)], "i int, j int")
    SI.store_frames(frames, (10, 10), "holes_f", str(tmp_path / "f"), 2, block=4, values=["skt"])
    SI.store_mapping(mapping, (10, 10), "holes_m", str(tmp_path / "m"), 2, block=4, cells=cells)
    got = {r.j: r.temperature for r in SI.regrid_stored(spark.table("holes_f"), spark.table("holes_m"), wind=False).collect()}
    assert got == {0: 0.5, 1: None, 2: None, 3: 0.0, 4: 0.0, 5: 0.0}
