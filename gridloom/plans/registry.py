"""Registry of queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table by its columns' types as stored; timestamps without zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, as sums come in any order."""
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
