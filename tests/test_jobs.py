"""The jobs over growing input, broken-off runs and odd rows."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gridloom.sources.config import load_config
from jobs import forcing_frames, log_catalogue

EVENTS = "/root/testdata/sf0.001/events.parquet"
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def frames_config():
    return load_config(forcing_frames.DEFAULT_CONFIG)


def grown(spark, folder, upto):
    """A copy of the events with ids up to so many, added to what is there."""
    have = spark.read.parquet(folder).agg(F.max("event_id")).first()[0] if os.path.isdir(folder) else -1
    spark.read.parquet(EVENTS).filter(F.col("event_id").between(have + 1, upto)).write.mode("append").parquet(folder)


def outcome(spark, target):
    return rows(forcing_frames.read_frames(spark, target)), rows(forcing_frames.read_report(spark, target))


def test_frames_of_growing_input_equal_one_run(spark, tmp_path):
    source, target, once = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "once")
    grown(spark, source, 399)
    first = forcing_frames.run(spark, source, target, frames_config())
    before = outcome(spark, target)
    assert first["n_rows"] == 400 and first["from_id"] is None
    grown(spark, source, 999)
    second = forcing_frames.run(spark, source, target, frames_config())
    assert (second["from_id"], second["to_id"], second["n_rows"]) == (399, 999, 600)
    assert forcing_frames.run(spark, source, target, frames_config())["n_rows"] == 0
    forcing_frames.run(spark, source, once, frames_config())
    assert outcome(spark, target) == outcome(spark, once) != before
    assert spark.read.parquet(f"{target}/marks").count() == 2
    assert sum(r[sorted(forcing_frames.read_frames(spark, target).columns).index("n")] for r in outcome(spark, target)[0]) == 1000


@pytest.mark.parametrize("step", ["frames_of", "report_of", "append_log"])
def test_broken_off_run_starts_from_its_mark(spark, tmp_path, monkeypatch, step):
    source, target, once = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "once")
    grown(spark, source, 299)
    forcing_frames.run(spark, source, target, frames_config())
    grown(spark, source, 599)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(forcing_frames, step, broken)
        with pytest.raises(RuntimeError):
            forcing_frames.run(spark, source, target, frames_config())
    grown(spark, source, 999)  # more has come before the next try
    forcing_frames.run(spark, source, target, frames_config())
    forcing_frames.run(spark, source, once, frames_config())
    assert outcome(spark, target) == outcome(spark, once)


def test_late_and_odd_observations(spark, tmp_path):
    config = {r: r for r in ("id", "i", "j", "u", "v")} | {"time": "timestamp_seconds(t)", "frame_seconds": 10}
    schema = "id long, t long, i int, j int, u double, v double, day string, n string"
    a = [(1, 5, 0, 0, 3.0, 4.0), (2, 86405, 0, 0, 1.0, 0.0), (3, -1, 2, 2, 0.0, 0.0), (None, 5, 0, 0, 9.0, 9.0), (4, None, 0, 0, 9.0, 9.0), (5, 7, 0, 0, None, 1.0)]
    b = [(6, 9, 0, 0, 0.0, 0.0), (7, 86409, 0, 0, 1.0, 0.0), (8, 86409, 0, 0, 1.0, 0.0)]  # late rows for frames already written; copies count
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(*r, "x", "y") for r in a], schema).write.parquet(source)
    assert forcing_frames.run(spark, source, target, config)["n_rejected"] == 3
    spark.createDataFrame([(*r, "x", "y") for r in b], schema).write.mode("append").parquet(source)
    forcing_frames.run(spark, source, target, config)
    got = {(r["frame"], r["i"]): (r["day"], r["n"], r["u"], r["v"], r["speed"], r["max_speed"]) for r in forcing_frames.read_frames(spark, target).collect()}
    assert got == {(0, 0): (0, 2, 1.5, 2.0, 2.5, 5.0), (8640, 0): (1, 3, 1.0, 0.0, 1.0, 1.0), (-1, 2): (-1, 1, 0.0, 0.0, 0.0, 0.0)}


def test_empty_observations(spark, tmp_path):
    spark.read.parquet(EVENTS).limit(0).write.parquet(str(tmp_path / "in"))
    assert forcing_frames.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), frames_config())["n_rows"] == 0


def log_rows(spark, target):
    return rows(log_catalogue.read_catalogue(spark, target)), rows(log_catalogue.read_summary(spark, target))


def test_catalogue_of_growing_folder_equals_one_run(spark, tmp_path):
    config = load_config(log_catalogue.DEFAULT_CONFIG) | {"files_per_batch": 2}
    source, target, once = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "once")
    docs = spark.read.parquet(DOCUMENTS).repartition(5)
    docs.filter("doc_id % 3 = 0").write.parquet(source)
    first = log_catalogue.run(spark, source, target, config)
    docs.filter("doc_id % 3 <> 0").write.mode("append").parquet(source)
    second = log_catalogue.run(spark, source, target, config)
    assert first["batches"] >= 2 and first["templates"] < second["templates"]
    before = log_rows(spark, target)
    assert log_catalogue.run(spark, source, target, config)["batches"] == 0
    log_catalogue.run(spark, source, once, config | {"files_per_batch": 0})
    assert log_rows(spark, target) == before == log_rows(spark, once)
    lines = sum(len(r["text"].split("\n")) for r in docs.collect() if r["text"] is not None)
    assert sum(r["n_lines"] for r in log_catalogue.read_catalogue(spark, target).collect()) == lines


def test_broken_off_batch_is_counted_once(spark, tmp_path, monkeypatch):
    config = load_config(log_catalogue.DEFAULT_CONFIG) | {"files_per_batch": 1}
    source, target, once = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "once")
    spark.read.parquet(DOCUMENTS).repartition(3).write.parquet(source)
    counts, calls = log_catalogue.counts_of, []

    def second_fails(lines):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return counts(lines)

    with monkeypatch.context() as m:
        m.setattr(log_catalogue, "counts_of", second_fails)
        with pytest.raises(Exception, match="lost"):
            log_catalogue.run(spark, source, target, config)
    log_catalogue.run(spark, source, target, config)
    log_catalogue.run(spark, source, once, config)
    assert log_rows(spark, target) == log_rows(spark, once)


def test_messages_of_odd_logs(spark, tmp_path):
    config = {"id": "id", "source": "source", "text": "text", "parts": 3}
    data = [(1, "a", "step 12 of 40\nstep 7 of 40 \n"), (2, "a", None), (None, None, "x"), (3, "a", ""), (4, "b", "step 1 of 2"), (4, "b", "step 1 of 2"), (0, "a", "z" * 50_000)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(*r, "x", 5) for r in data], "id long, source string, text string, line string, part int").write.parquet(source)
    log_catalogue.run(spark, source, target, config)
    got = sorted(((r["source"], r["n_lines"], r["n_chars"], r["n_numbers"], r["first_doc"], r["first_line"]) for r in log_catalogue.read_catalogue(spark, target).collect()), key=repr)
    assert got == sorted([("a", 2, 26, 4, 1, 0), ("a", 2, 0, 0, 1, 2), ("a", 1, 50_000, 0, 0, 0), (None, 1, 1, 0, None, 0), ("b", 2, 22, 4, 4, 0)], key=repr)
    assert {r["source"]: (r["n_lines"], r["n_templates"], r["n_repeated"]) for r in log_catalogue.read_summary(spark, target).collect()} == {"a": (5, 3, 4), "b": (2, 1, 2), None: (1, 1, 0)}


def test_command_line(tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"ParentConfig": forcing_frames.DEFAULT_CONFIG, "frame_seconds": 3600}))
    for _ in range(2):
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/forcing_frames.py", EVENTS, str(tmp_path / "out"), "--config", str(config)], capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "0 rows above mark 999" in done.stderr and sorted(os.listdir(tmp_path / "out")) == ["frames", "log", "marks", "partials", "report"]
