"""Catalogue of the messages in run logs, kept up to date as log files arrive.

    python jobs/log_catalogue.py SOURCE TARGET [--config jobs/log_catalogue.json]

SOURCE is a folder of Parquet files with one log a row (text, its source, an id); files are only added. Each line
of a log is a message whose numbers vary, so lines are grouped by what is left when every number becomes `#`. TARGET gets

    checkpoint          which files have been taken (Spark's)
    parts/batch=N       counts of each micro-batch
    catalogue/part=P    source, template_sha256, n_lines, n_chars, n_numbers, first_doc, first_line
    summary             one row a source: n_lines, n_templates, n_repeated (lines whose template occurs more than once)
    log                 CSV, one line a run

The files are a file stream that ends when all that is there is taken; each text is read once. A micro-batch that is run
again after a failure replaces its own part. The catalogue is merged from the parts' counts, never from texts,
so it is the same after any number of runs. Null texts have no lines, empty ones one; rows without source are one group;
rows that occur twice count twice. first_doc and first_line point at the first place of a message.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridloom.sources.config import get, load_config  # noqa: E402
from gridloom.sources.frames import append_log  # noqa: E402

DEFAULT_CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "log_catalogue.json")
PART = "source string, template_sha256 string, n_lines long, n_chars long, n_numbers long, first struct<doc: long, line: long>"
log = logging.getLogger("log_catalogue")


def lines_of(logs: DataFrame, config: dict) -> DataFrame:
    """source, doc, line, text: one row a line."""
    role = {r: F.col(get(config, r, str)) for r in ("id", "source", "text")}
    rows = logs.select(role["id"].cast("long").alias("doc"), role["source"].cast("string").alias("source"), F.posexplode(F.split(role["text"].cast("string"), "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line").cast("long"))


def counts_of(lines: DataFrame) -> DataFrame:
    """Counts of each message, which can be added to those of other batches."""
    template = F.trim(F.regexp_replace("text", "[0-9]+", "#"))
    one = lines.select("source", F.sha2(template, 256).alias("template_sha256"), F.char_length("text").alias("chars"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.struct("doc", "line").alias("first"))
    return one.groupBy("source", "template_sha256").agg(F.count("*").alias("n_lines"), F.sum("chars").alias("n_chars"), F.sum("numbers").alias("n_numbers"), F.min("first").alias("first"))


def merged(parts: DataFrame) -> DataFrame:
    out = parts.groupBy("source", "template_sha256").agg(*(F.sum(c).alias(c) for c in ("n_lines", "n_chars", "n_numbers")), F.min("first").alias("first"))
    return out.select("source", "template_sha256", "n_lines", "n_chars", "n_numbers", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))


def summary_of(catalogue: DataFrame) -> DataFrame:
    repeated = F.sum(F.when(F.col("n_lines") > 1, F.col("n_lines")).otherwise(0))
    return catalogue.groupBy("source").agg(F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_templates"), repeated.alias("n_repeated"))


def take_new(spark: SparkSession, source: str, target: str, config: dict) -> tuple[int, int]:
    """Counts of the files that no earlier run took, as parts; gives (batches, rows read)."""
    source = source.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    files = get(config, "files_per_batch", int)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)

    def keep(batch: DataFrame, number: int) -> None:
        counts_of(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/parts/batch={number}")

    # as a pattern, the path may be of one file as well as of a folder
    logs = stream.parquet(f"{source[:-1]}[{source[-1]}]")
    query = lines_of(logs, config).writeStream.foreachBatch(keep).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    rows = [p["numInputRows"] for p in query.recentProgress]
    return sum(n > 0 for n in rows), sum(rows)


def run(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """Take in the new files of `source` and bring the catalogue up to date; gives what was read and written."""
    batches, rows = take_new(spark, source, target, config)
    log.info("%s: %d new rows in %d batches", source, rows, batches)
    try:
        parts = spark.read.schema(PART).option("basePath", f"{target}/parts").parquet(f"{target}/parts")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        parts = spark.createDataFrame([], PART)
    number = get(config, "parts", int, 16)
    # a long text's hash deals a source's messages over all parts, so that no source makes a part of its own
    dealt = merged(parts).withColumn("part", F.expr(f"CAST(pmod(xxhash64(template_sha256), {number}) AS INT)"))
    dealt.repartition(number, "part").write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{target}/catalogue")
    summary_of(read_catalogue(spark, target)).write.mode("overwrite").parquet(f"{target}/summary")
    out = {"batches": batches, "rows_read": rows, "templates": read_catalogue(spark, target).count()}
    log.info("%s: %d messages in the catalogue", target, out["templates"])
    append_log(spark.createDataFrame([tuple(out.values())], "batches long, rows_read long, templates long"), f"{target}/log")
    return out


def read_catalogue(spark: SparkSession, target: str) -> DataFrame:
    schema = "source string, template_sha256 string, n_lines long, n_chars long, n_numbers long, first_doc long, first_line long, part int"
    return spark.read.schema(schema).parquet(f"{target}/catalogue").drop("part")


def read_summary(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/summary")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Catalogue of the messages in run logs, kept up to date as log files arrive.")
    args.add_argument("source")
    args.add_argument("target")
    args.add_argument("--config", default=DEFAULT_CONFIG)
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("log_catalogue").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.source, given.target, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
