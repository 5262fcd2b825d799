"""The jobs as queries: each runs its job twice into one new folder and returns the output as the second run left it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.lineage import scratch
from gridloom.sources.config import load_config

from . import forcing_frames, log_catalogue


def job1_forcing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of kind cell (frames) and of kind frame (report)."""
    target, config = scratch(spark, "job1"), load_config(forcing_frames.DEFAULT_CONFIG)
    for _ in range(2):
        forcing_frames.run(spark, f"{sf_dir}/events.parquet", target, config)
    cells = forcing_frames.read_frames(spark, target).withColumn("kind", F.lit("cell"))
    frames = forcing_frames.read_report(spark, target).withColumn("kind", F.lit("frame"))
    both = cells.unionByName(frames, allowMissingColumns=True)
    return both.select(*(F.round(c, 7).alias(c) if t == "double" else F.col(c).cast("long" if t == "int" else t).alias(c) for c, t in both.dtypes))


JOB1_SQL = """
WITH seen AS (
    SELECT floor(epoch(ts) / 10800)::bigint AS frame, floor(epoch(ts) / 86400)::bigint AS day, user_id % 32 AS i, user_id // 32 AS j, value AS speed,
        value * sin(radians(72 * list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type))) AS u,
        value * cos(radians(72 * list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type))) AS v
    FROM events
    WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL
        AND event_type IN ('click', 'error', 'purchase', 'signup', 'view')
),
cells AS (
    SELECT day, frame, i, j, count(*) AS n, avg(u) AS u, avg(v) AS v, avg(abs(speed)) AS speed, max(abs(speed)) AS max_speed
    FROM seen GROUP BY day, frame, i, j
),
turned AS (SELECT *, degrees(atan2(-u, -v)) AS b FROM cells),
directed AS (SELECT *, CASE WHEN b < 0 THEN b + 360 ELSE b END AS bearing FROM turned)
SELECT 'cell' AS kind, day, frame, i, j, n, round(u, 7) AS u, round(v, 7) AS v, round(speed, 7) AS speed, round(max_speed, 7) AS max_speed,
    round(bearing, 7) AS bearing, (floor(bearing / 22.5 + 0.5)::bigint % 16) AS sector,
    NULL::bigint AS n_cells, NULL::double AS speed_mean, NULL::double AS speed_max, NULL::double AS vector_mean
FROM directed
UNION ALL
SELECT 'frame', day, frame, NULL, NULL, sum(n)::bigint, NULL, NULL, NULL, NULL, NULL, NULL,
    count(*), round(avg(speed), 7), round(max(max_speed), 7), round(sqrt(avg(u) * avg(u) + avg(v) * avg(v)), 7)
FROM cells GROUP BY day, frame
"""


def job2_log_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, config = scratch(spark, "job2"), load_config(log_catalogue.DEFAULT_CONFIG)
    for _ in range(2):
        log_catalogue.run(spark, f"{sf_dir}/documents.parquet", target, config)
    return log_catalogue.read_catalogue(spark, target)


JOB2_SQL = r"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents
),
keyed AS (
    SELECT *, sha256(trim(regexp_replace(line, '[0-9]+', '#', 'g'))) AS template_sha256, len(regexp_extract_all(line, '[0-9]+')) AS numbers FROM lines
)
SELECT source, template_sha256, count(*) AS n_lines, sum(length(line))::bigint AS n_chars, sum(numbers)::bigint AS n_numbers,
    arg_min(doc_id, (doc_id, k)) AS first_doc, arg_min(k, (doc_id, k)) AS first_line
FROM keyed GROUP BY source, template_sha256
"""

QUERIES = {f.__name__: f for f in (job1_forcing_frames, job2_log_catalogue)}
ORACLE_SQL = {"job1_forcing_frames": JOB1_SQL, "job2_log_catalogue": JOB2_SQL}
