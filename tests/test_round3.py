"""Odd rows and plans of the queries named in the third round's findings."""

import datetime
import os

import __spark_entry__ as entry
from gridloom.operators import timeseries as TS
from jobs import forcing_frames
from pyspark.sql import functions as F


def events_folder(spark, path, rows):
    """A folder whose events.parquet holds rows (event_id, ts, user_id, event_type, value)."""
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(os.path.join(str(path), "events.parquet"))
    return str(path)


def test_frame_time_rounds_and_keeps_all_rows_of_the_last_event(spark, tmp_path):
    at = lambda us: datetime.datetime(2024, 1, 30, 23, 59, 25, us)
    rows = [(1, at(0), 1, "view", 1.0), (2, at(700_000), 1, "view", 1.0), (2, at(200_000), 2, "view", 1.0), (2, at(500_000), 2, "view", 1.0)]
    out = entry.queries()["frame_time"](spark, events_folder(spark, tmp_path / "a", rows))
    assert sorted(map(tuple, out.collect())) == [(2, 1706659165), (2, 1706659166), (2, 1706659166)]  # 165.5 goes to the even second
    none = entry.queries()["frame_time"](spark, events_folder(spark, tmp_path / "b", [(None, None, 1, "view", 1.0)]))
    assert none.collect() == [] and none.columns == ["wanted", "t"]


def test_forcing_frames_have_the_bearings_of_their_sql(spark):
    sums = [(19723, 157784, 0, 0, 1, 0.0, 0.0, 0.0, 0.0), (19723, 157784, 1, 0, 2, 1e-16, -2.0, 2.0, 1.0), (19723, 157784, 2, 0, 1, -1.0, 0.0, 1.0, 1.0), (19723, 157784, 3, 0, 1, 1.0, 0.0, 1.0, 1.0), (19723, 157784, 4, 0, 1, 0.0, 1.0, 1.0, 1.0)]
    partials = spark.createDataFrame(sums, "day int, frame long, i int, j int, n long, sum_u double, sum_v double, sum_speed double, max_speed double")
    got = {r.i: (round(r.bearing, 7), r.sector) for r in forcing_frames.frames_of(partials).collect()}
    # the SQL: atan2(-u, -v) in degrees, 360 added if negative; calm is atan2(-0, -0)
    assert got == {0: (180.0, 8), 1: (360.0, 0), 2: (90.0, 4), 3: (270.0, 12), 4: (180.0, 8)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_brackets_and_nearest_frames_fold_no_window_anew_for_each_row(spark):
    probes, frames = spark.range(50).select(F.col("id").alias("t")), spark.range(0, 50, 7).select(F.col("id").alias("ts"), (F.col("id") * 2.0).alias("v"))
    found = [TS.asof_bracket(probes, frames, "t", "ts", ["v"]), TS.asof_bracket_chunked(probes, frames, "t", "ts", ["v"], 10), TS.nearest_in_time(probes, frames, "t", "ts", ["v"])]
    for out in found:
        assert "currentrow$(), unboundedfollowing$()" not in plan(out)
    assert [r.v for r in found[1].orderBy("t").collect()] == [2.0 * min(k, 49) for k in range(50)]
    assert [r.nearest_ts for r in found[2].orderBy("t").collect()] == [min(49, (k + 3) // 7 * 7) for k in range(50)]


def test_points_are_gathered_and_warmed_without_dealing_them_out_by_tile(spark):
    queries = entry.queries()
    gathered = plan(queries["gather_g2p"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" not in gathered and "BroadcastHashJoin" in gathered
    assert plan(queries["thermal_points"](spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") == 1
