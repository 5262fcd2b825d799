"""Time-series, report and summary queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import generic as X
from ..operators import diagnostics as D
from ..operators import thermal as H
from ..operators import timeseries as TS
from .registry import query, rounded, table


def _epoch(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros("ts").alias("us"), "ts")


@query(
    """
    SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS price_mean, max(l_extendedprice) AS price_max,
           round(sqrt(power(sum(l_quantity * l_discount), 2) + power(sum(l_quantity * l_tax), 2)) / sum(l_quantity), 8) AS mean_vector
    FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag
    """
)
def weighted_vector_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    m, x, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    sx, sy = F.sum(m * x), F.sum(m * y)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("price_mean"), F.max("l_extendedprice").alias("price_max"), F.round(F.sqrt(sx * sx + sy * sy) / F.sum(m), 8).alias("mean_vector"))


@query(
    """
    WITH m AS (SELECT DISTINCT p_partkey AS j FROM part WHERE p_size > 20), c AS (
      SELECT CAST(month(l_shipdate) AS INTEGER) AS frame, l_quantity AS mass, l_discount AS vx, l_tax AS vy, l_extendedprice AS s,
             CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS cracked, l_tax AS wx, l_discount AS wy
      FROM lineitem WHERE l_partkey IN (SELECT j FROM m)), d AS (
      SELECT *, sqrt(power(wx - vx, 2) + power(wy - vy, 2)) AS u, (SELECT count(*) FROM m) AS cells FROM c)
    SELECT frame, round(sum(s) / any_value(cells), 4) AS ice_strength_mean, max(s) AS ice_strength_max,
           round(sum(sqrt(wx * wx + wy * wy)) / any_value(cells), 6) AS wind_speed_mean,
           round(sum(cracked) / any_value(cells), 6) AS fractured_fraction,
           round(sqrt(power(sum(mass * u * (wx - vx)), 2) + power(sum(mass * u * (wy - vy)), 2)) * 0.0015 * 1.2 / sum(mass), 12) AS wind_drag_mean,
           round(max(u * u) * 0.0015 * 1.2, 12) AS wind_drag_max
    FROM d GROUP BY frame
    """
)
def masked_region_diag(spark, sf_dir):
    mask = table(spark, sf_dir, "part").filter("p_size > 20").select(F.lit(0).alias("i"), F.col("p_partkey").alias("j"))
    cells = table(spark, sf_dir, "lineitem").select(
        F.month("l_shipdate").alias("frame"), F.lit(0).alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("mass"), F.col("l_discount").alias("vx"), F.col("l_tax").alias("vy"),
        F.col("l_extendedprice").alias("ice_strength"), (F.col("l_returnflag") == "R").cast("double").alias("cracked"), F.col("l_tax").alias("wx"), F.col("l_discount").alias("wy"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
    )
    out = D.region_diagnostics(cells, mask, wind_drag=0.0015, water_drag=0.0055)
    return out.select("frame", F.round("ice_strength_mean", 4).alias("ice_strength_mean"), "ice_strength_max", F.round("wind_speed_mean", 6).alias("wind_speed_mean"), F.round("fractured_fraction", 6).alias("fractured_fraction"), F.round("wind_drag_mean", 12).alias("wind_drag_mean"), F.round("wind_drag_max", 12).alias("wind_drag_max"))


@query(
    """
    WITH f AS (SELECT user_id, max(value) AS value, epoch_us(ts) AS us FROM events WHERE event_type = 'error' GROUP BY user_id, epoch_us(ts)),
    g AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
    q AS (SELECT p.*, f.k, x.n FROM p JOIN (SELECT user_id, any_value(n) AS n FROM g GROUP BY user_id) x USING (user_id) ASOF LEFT JOIN g f ON p.user_id = f.user_id AND p.us >= f.us),
    r AS (SELECT *, greatest(1, least(coalesce(k, 1), n - 1)) AS k0, least(greatest(1, least(coalesce(k, 1), n - 1)) + 1, n) AS k1 FROM q),
    s AS (SELECT r.event_id, r.us, a.us AS t0, b.us AS t1, a.value AS v0, b.value AS v1 FROM r JOIN g a ON a.user_id = r.user_id AND a.k = r.k0 JOIN g b ON b.user_id = r.user_id AND b.k = r.k1),
    u AS (SELECT *, CASE WHEN t1 = t0 THEN 0.0 ELSE greatest(0.0, least(1.0, (us - t0) / CAST(t1 - t0 AS DOUBLE))) END AS a FROM s)
    SELECT event_id, t0, t1, round(a, 9) AS alpha, round(v0 * (1 - a) + v1 * a, 6) AS value FROM u
    """
)
def asof_bracket_blend(spark, sf_dir):
    e = _epoch(spark, sf_dir)
    frames = e.filter("event_type = 'error'").groupBy("user_id", "us").agg(F.max("value").alias("value"))
    probes = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us").join(frames.select("user_id").distinct(), "user_id", "left_semi")
    out = TS.asof_bracket(probes, frames, "us", "us", ["value"], by=["user_id"])
    return out.select("event_id", "t0", "t1", F.round("alpha", 9).alias("alpha"), F.round("value", 6).alias("value"))


@query(
    """
    WITH f AS (SELECT user_id, max(value) AS v, epoch_us(ts) AS us FROM events WHERE event_type = 'error' GROUP BY user_id, epoch_us(ts)),
    p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, arg_min(f.us, (abs(f.us - p.us), f.us)) AS nearest_ts, arg_min(f.v, (abs(f.us - p.us), f.us)) AS value
    FROM p JOIN f USING (user_id) GROUP BY p.event_id
    """
)
def nearest_in_time(spark, sf_dir):
    e = _epoch(spark, sf_dir)
    frames = e.filter("event_type = 'error'").groupBy("user_id", "us").agg(F.max("value").alias("value"))
    probes = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    return TS.nearest_in_time(probes, frames, "us", "us", ["value"], by=["user_id"]).filter("nearest_ts IS NOT NULL").select("event_id", "nearest_ts", "value")


@query(
    """
    WITH d AS (SELECT DISTINCT o_orderdate AS d FROM orders), i AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM d)
    SELECT min(k) AS first_idx, max(k) AS last_idx FROM i WHERE d BETWEEN (SELECT min(d) FROM d) AND (SELECT max(d) FROM d)
    """
)
def exact_span(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.unix_seconds("o_orderdate").alias("t")).distinct()
    frames = days.withColumn("idx", F.row_number().over(Window.orderBy("t")).cast("long") - 1)
    low, high = days.agg(F.min("t"), F.max("t")).first()
    return TS.frame_range(frames, "t", "idx", low, high)


@query(
    """
    WITH f AS (SELECT event_id, epoch_us(ts) AS t, CAST(CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS INTEGER) AS file_seq FROM events)
    SELECT event_id, file_seq, CAST(row_number() OVER (PARTITION BY file_seq ORDER BY t, event_id) - 1 AS INTEGER) AS local_idx,
           row_number() OVER (ORDER BY file_seq, t, event_id) - 1 AS global_idx FROM f
    """
)
def multi_file_timeline(spark, sf_dir):
    e = _epoch(spark, sf_dir).select("event_id", F.struct("us", "event_id").alias("t"), F.dayofmonth("ts").alias("d"))
    files = [e.filter("d <= 15").drop("d"), e.filter("d > 15").drop("d")]
    return TS.timeline(files).select("event_id", "file_seq", "local_idx", "global_idx")


_DAILY = "SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS t, avg(value) AS v FROM events GROUP BY 1, 2"


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.unix_seconds(F.date_trunc("day", "ts")).alias("t")).agg(F.avg("value").alias("v"))


@query(
    f"""
    WITH RECURSIVE d AS ({_DAILY}), s AS (SELECT event_type, t, -v / 10 AS s, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k FROM d),
    c AS (SELECT n, 2.3 * 2.3 / (1.1e-6 * pi() * pi() * n * n) AS tau, 2.0 / (n * pi()) AS b FROM (VALUES (1), (2), (3)) x(n)),
    r AS (SELECT s.event_type, c.n, s.k, s.t, s.s, CAST(0.0 AS DOUBLE) AS a FROM s, c WHERE k = 1
      UNION ALL SELECT r.event_type, r.n, s.k, s.t, s.s, (r.a + (s.s - r.s) / (s.t - r.t) * c.b * c.tau) * exp(-(s.t - r.t) / c.tau) - (s.s - r.s) / (s.t - r.t) * c.b * c.tau
      FROM r JOIN s ON s.event_type = r.event_type AND s.k = r.k + 1 JOIN c ON c.n = r.n),
    l AS (SELECT event_type, n, a, s FROM r QUALIFY k = max(k) OVER (PARTITION BY event_type))
    SELECT event_type, round(max(s), 6) AS ts_last, round(max(a) FILTER (n = 1), 6) AS a1, round(max(a) FILTER (n = 2), 6) AS a2, round(max(a) FILTER (n = 3), 6) AS a3 FROM l GROUP BY event_type
    """
)
def thermal_fold(spark, sf_dir):
    series = _daily(spark, sf_dir).select("event_type", "t", (-F.col("v") / 10).alias("s"), F.lit(2.3).alias("h"))
    return rounded(H.thermal_fold_chunked(series, "t", "s", "h", by=["event_type"], chunk=7 * 86400.0).drop("thickness"))


@query(
    """
    WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS h, -CAST(p_size AS DOUBLE) AS s FROM part),
    z AS (SELECT p_partkey, k, s + (-1.8 - s) * ((k + 0.5) / 8) AS t FROM p, range(8) r(k)),
    b AS (SELECT p_partkey, least(1.0, greatest(0.0, 0.006 * (49.185 / greatest(-t, 1e-6) + 0.532))) AS v FROM z)
    SELECT p_partkey, round(avg(1.76e6 * exp(-5.88 * sqrt(v))), 3) AS strength FROM b GROUP BY p_partkey
    """
)
def ice_strength(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("thickness"), (-F.col("p_size")).cast("double").alias("ts_last"), *[F.lit(0.0).alias(f"a{n}") for n in (1, 2, 3)])
    return H.with_strength(p).select("p_partkey", F.round("strength", 3).alias("strength"))


_RATE = f"""d AS ({_DAILY}), c AS (SELECT event_type, t, t / 86400.0 AS x, sum(v) OVER (PARTITION BY event_type ORDER BY t) AS y FROM d),
    w AS (SELECT *, x - lag(x) OVER o AS hs, lead(x) OVER o - x AS hd, y - lag(y) OVER o AS dn, lead(y) OVER o - y AS up FROM c WINDOW o AS (PARTITION BY event_type ORDER BY t)),
    g AS (SELECT event_type, t, x, CASE WHEN hs IS NOT NULL AND hd IS NOT NULL THEN (hs * hs * up + hd * hd * dn) / (hs * hd * (hs + hd)) WHEN hd IS NOT NULL THEN up / hd ELSE dn / hs END AS rate FROM w)"""


def _rate(spark, sf_dir):
    d = _daily(spark, sf_dir)
    d = d.withColumn("x", F.col("t") / 86400.0).withColumn("y", F.sum("v").over(Window.partitionBy("event_type").orderBy("t")))
    return TS.gradient(d, "x", "y", "rate", by=["event_type"])


@query(f"WITH {_RATE} SELECT event_type, t, round(rate, 6) AS rate FROM g")
def gradient_rate(spark, sf_dir):
    return _rate(spark, sf_dir).select("event_type", "t", F.round("rate", 6).alias("rate"))


@query(f"WITH {_RATE} SELECT event_type, t, round(sum(rate) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM g")
def moving_average(spark, sf_dir):
    return TS.moving_average(_rate(spark, sf_dir), "t", "rate", "smooth", 5, by=["event_type"]).select("event_type", "t", F.round("smooth", 6).alias("smooth"))


@query(
    f"""
    WITH {_RATE}, s AS (SELECT event_type, t, sum(rate) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS r FROM g),
    p AS (SELECT *, first_value(t) OVER (PARTITION BY event_type ORDER BY round(r, 9) DESC, t) AS pt, max(r) OVER (PARTITION BY event_type) AS pv FROM s)
    SELECT event_type, any_value(pt) AS peak_t, coalesce(max(t) FILTER (t <= pt AND r <= 0.85 * pv), min(t)) AS start_t, coalesce(min(t) FILTER (t >= pt AND r <= 0.85 * pv), max(t)) AS end_t
    FROM p GROUP BY event_type HAVING max(pv) >= 0.05
    """
)
def transition_window(spark, sf_dir):
    s = TS.moving_average(_rate(spark, sf_dir), "t", "rate", "r", 5, by=["event_type"])
    return TS.transition_window(s, "t", "r", by=["event_type"], share=0.85).select("event_type", "peak_t", "start_t", "end_t")


@query(
    f"""
    WITH d AS ({_DAILY}), w AS (SELECT event_type, t, v, t - lag(t) OVER o AS dt, v - lag(v) OVER o AS dv, max(v) OVER o AS peak FROM d WINDOW o AS (PARTITION BY event_type ORDER BY t))
    SELECT event_type, t, dt, round(dv / dt, 9) AS rate, round(peak, 6) AS peak FROM w
    """
)
def frame_deltas_peak(spark, sf_dir):
    d = TS.running_peak(TS.deltas(_daily(spark, sf_dir), "t", "v", by=["event_type"]), "t", "v", "peak", by=["event_type"])
    return d.select("event_type", "t", "dt", F.round("rate", 9).alias("rate"), F.round("peak", 6).alias("peak"))


@query(
    """
    WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS q, l_discount AS d FROM lineitem)
    SELECT k, count(*) AS n, round(sum(CASE WHEN d > 0.05 THEN q ELSE 0 END), 2) AS total FROM e GROUP BY k
    """
)
def conditional_accumulation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"), F.col("l_extendedprice").alias("q"), "l_discount")
    r = TS.running_conditional_sum(li, "o", "q", F.col("l_discount") > 0.05, "total", by=["k"])
    return r.groupBy("k").agg(F.count("*").alias("n"), F.round(F.max("total"), 2).alias("total"))


@query(
    """
    WITH b AS (SELECT CAST(trunc(embedding[1] * 100) AS DOUBLE) AS vx, CAST(trunc(embedding[2] * 100) AS DOUBLE) AS vy FROM embeddings),
    s AS (SELECT *, sqrt(vx * vx + vy * vy) AS s, degrees(atan2(-vx, -vy)) AS d FROM b),
    c AS (SELECT CASE WHEN s < 1e-6 THEN -1 ELSE CAST(floor((d + CASE WHEN d < 0 THEN 360 ELSE 0 END) / 22.5 + 0.5) AS BIGINT) % 16 END AS dir_bin,
                 CASE WHEN s < 1e-6 THEN -1 ELSE (s >= 2)::INT + (s >= 5)::INT + (s >= 10)::INT + (s >= 15)::INT END AS speed_bin FROM s),
    g AS (SELECT dir_bin, speed_bin, count(*) AS n FROM c GROUP BY ALL),
    z AS (SELECT d AS dir_bin, s AS speed_bin FROM range(16) a(d), range(5) b(s) UNION ALL SELECT -1, -1 UNION ALL SELECT -2, -1)
    SELECT CAST(dir_bin AS INTEGER) AS dir_bin, CAST(speed_bin AS INTEGER) AS speed_bin, coalesce(n, 0) AS n,
           CASE WHEN dir_bin >= 0 THEN round(coalesce(n, 0) / (SELECT sum(n) FROM g WHERE dir_bin >= 0), 9) END AS share
    FROM z LEFT JOIN g USING (dir_bin, speed_bin)
    """
)
def rose_16x5(spark, sf_dir):
    at = lambda k: (F.element_at("embedding", k) * 100).cast("int").cast("double")
    e = table(spark, sf_dir, "embeddings").select(at(1).alias("vx"), at(2).alias("vy"))
    return rounded(D.rose(e, "vx", "vy", [2.0, 5.0, 10.0, 15.0]), 9)


@query(
    """
    WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y, 1000000.0 / 150 AS sx, 60.0 / 86 AS sy FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 1000000 AND l_quantity BETWEEN 0 AND 60),
    u AS (SELECT sx, sy, x / sx AS u, y / sy AS v FROM p),
    k AS (SELECT *, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM u),
    h AS (SELECT CASE WHEN (u - i1) * (u - i1) + (v - j1) * (v - j1) * 3 < (u - i2 - 0.5) * (u - i2 - 0.5) + (v - j2 - 0.5) * (v - j2 - 0.5) * 3 THEN (i1, j1) ELSE (i2 + 0.5, j2 + 0.5) END AS c, sx, sy FROM k)
    SELECT round(c[1] * sx, 4) AS cx, round(c[2] * sy, 4) AS cy, count(*) AS n, round(log10(count(*)), 9) AS log_n FROM h GROUP BY 1, 2
    """
)
def hexbin_log(spark, sf_dir):
    out = D.hexbin(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", (0.0, 1_000_000.0, 0.0, 60.0))
    return rounded(out, 4, log_n=9)


@query("SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bx, CAST(floor(l_quantity / 5) AS BIGINT) AS by, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist2d(spark, sf_dir):
    return D.histogram2d(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 5000.0, 5.0)


@query(
    """
    SELECT 'c_acctbal' AS name, -max(abs(c_acctbal)) AS low, max(abs(c_acctbal)) AS high FROM customer
    UNION ALL SELECT 'c_custkey', CAST(min(c_custkey) AS DOUBLE), CAST(max(c_custkey) AS DOUBLE) FROM customer
    UNION ALL SELECT 'c_nationkey', 0.0, 30.0
    """
)
def value_ranges(spark, sf_dir):
    return D.value_range(table(spark, sf_dir, "customer"), {"c_acctbal": "diverging", "c_custkey": "sequential", "c_nationkey": "fixed"}, {"c_nationkey": (0.0, 30.0)})


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(value) AS valid, round(avg(CASE WHEN value IS NULL THEN 0 ELSE 100 END), 6) AS coverage FROM events GROUP BY event_type")
def frame_statistics(spark, sf_dir):
    return rounded(D.statistics(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("SELECT round(sum(p_size * 2.5::DOUBLE), 4) AS volume, round(avg(p_retailprice), 6) AS strength_mean, round(avg(-p_size), 6) AS temperature_mean, CAST(min(p_size) AS DOUBLE) AS thickness_min FROM part")
def sum_reductions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("thickness"), F.col("p_retailprice").alias("xi"), (-F.col("p_size")).cast("double").alias("ts_old"))
    return rounded(D.totals(p, 2.5), 6, volume=4)


@query("SELECT o_custkey, greatest(min(epoch(o_orderdate)::BIGINT), 852076800) AS low, least(max(epoch(o_orderdate)::BIGINT), 946684800) AS high FROM orders GROUP BY o_custkey HAVING greatest(min(epoch(o_orderdate)::BIGINT), 852076800) < least(max(epoch(o_orderdate)::BIGINT), 946684800) UNION ALL SELECT o_custkey, 0, 0 FROM orders GROUP BY o_custkey HAVING NOT greatest(min(epoch(o_orderdate)::BIGINT), 852076800) < least(max(epoch(o_orderdate)::BIGINT), 946684800)")
def interval_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.unix_seconds("o_orderdate")).alias("a"), F.max(F.unix_seconds("o_orderdate")).alias("b"))
    return o.withColumn("r", TS.intersect_intervals([F.col("a"), F.lit(852076800).cast("long")], [F.col("b"), F.lit(946684800).cast("long")])).select("o_custkey", "r.low", "r.high")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def iso_epoch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    e = X.iso_to_epoch(F.col("d"))
    return o.select("o_orderkey", e.alias("epoch"), X.epoch_to_iso(e).alias("iso"))


@query(
    """
    WITH e AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - 1704499200 AS s FROM events), d AS (SELECT event_id, CAST(floor(s / 86400.0) AS BIGINT) AS d, ((s % 86400) + 86400) % 86400 AS r FROM e)
    SELECT event_id, 'Day ' || CASE WHEN d BETWEEN -9 AND -1 THEN '-' || abs(d) ELSE lpad(d::VARCHAR, 2, '0') END || '  Hour ' || lpad((r // 3600)::VARCHAR, 2, '0') AS label FROM d
    """
)
def day_hour_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_seconds("ts") - 1704499200).alias("s"))
    return e.select("event_id", X.day_hour(F.col("s")).alias("label"))


@query("SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, coalesce(props->>'missing', 'none') AS missing FROM events")
def props_parse(spark, sf_dir):
    p = F.from_json("props", "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"))


@query("WITH p AS (SELECT DISTINCT CAST(o_totalprice / 1000 AS BIGINT) AS x FROM orders) SELECT x AS low, lead(x) OVER (ORDER BY x) AS high FROM p QUALIFY high IS NOT NULL")
def breakpoint_intervals(spark, sf_dir):
    return TS.intervals(table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") / 1000).cast("long").alias("x")), "x")


@query(
    """
    WITH p AS (SELECT l_orderkey AS k, l_extendedprice AS x, l_quantity AS y, l_partkey AS a, l_linenumber AS b FROM lineitem),
    r AS (SELECT k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY k ORDER BY b, a, x))
    SELECT k, round(sum((x * ny - nx * y) / 2), 4) AS area FROM r GROUP BY k
    """
)
def polygon_area(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(TS.polygon_area(li, "o", "x", "y", by=["k"]), 4)


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    from ..streaming.stateful import tumbling

    e = table(spark, sf_dir, "events")
    out = tumbling(e, "ts", "6 hours", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")
