"""Order, partitions and samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generic import cell_index
from .lineage import cut


def sort_by_cell(points: DataFrame, size_y: int, partitions: int | None = None) -> DataFrame:
    """Points ordered by cell: range-partitioned, then sorted inside each partition."""
    key = cell_index(F.col("cell_x"), F.col("cell_y"), size_y)
    keyed = points.withColumn("cell", key)
    ranged = keyed.repartitionByRange(partitions, "cell") if partitions else keyed.repartitionByRange("cell")
    return ranged.sortWithinPartitions("cell")


def unsorted_rows(df: DataFrame, order: str, value: str) -> DataFrame:
    """Number of rows whose value is under that of the row before.

    Ranges of `order` are checked by their own tasks; the ranges' first and last values are then compared.
    """
    ranged = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_b", F.coalesce(F.lag(value).over(Window.partitionBy("_p").orderBy(order)) > F.col(value), F.lit(False)))
    parts = ranged.groupBy("_p").agg(F.count_if("_b").alias("_n"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    edge = F.coalesce(F.lag("_last").over(Window.orderBy("_p")) > F.col("_first"), F.lit(False))
    return parts.select("_n", edge.alias("_e")).agg(F.coalesce(F.sum("_n") + F.count_if("_e"), F.lit(0)).alias("unsorted"))


def equal_count_split(df: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """Adds part (0..parts-1) so that parts hold equal counts in the given order, larger remainders first.

    Ranks are global without a global sort: rows are cut into ordered ranges, each range is numbered by its own task and
    the ranges' counts give the offsets. The ranges are kept as a checkpoint, as they are used twice and a second
    cut (by another sample, or of other columns) need not be the same.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy()).alias("_t"))
    out = ranged.join(offsets, "_p").withColumn("_g", F.col("_r") + F.col("_o"))
    big, small = F.expr(f"_t DIV {parts} + 1"), F.expr(f"_t DIV {parts}")
    extra = F.col("_t") % parts
    part = F.when(F.col("_g") < extra * big, F.floor(F.col("_g") / big)).otherwise(extra + F.floor((F.col("_g") - extra * big) / F.nullif(small, F.lit(0))))
    return out.withColumn("part", part.cast("int")).drop("_p", "_r", "_o", "_t", "_g", "_n")


def split_bounds(df: DataFrame, value: str, part: str = "part") -> DataFrame:
    """(part, low): the first value of each part."""
    return df.groupBy(part).agg(F.min(value).alias("low"), F.count("*").alias("n"))


def needs_repartition(points: DataFrame, disabled: Column, capacity: int, most_disabled: float = 0.05, least_free: float = 0.01) -> DataFrame:
    """(repartition): too many disabled rows, or too little room."""
    n = F.count("*")
    return points.agg(((F.count_if(disabled) / F.nullif(n, F.lit(0)) > most_disabled) | ((F.lit(capacity) - n) / float(capacity) < least_free)).alias("repartition"))


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c_min, c_max) of each column over all rows."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def seeded_sample(df: DataFrame, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """k rows by a seeded hash order, the same at each run."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(k)


def sample_with_replacement(df: DataFrame, key: Sequence[str], k: int, seed: int = 0, spread: Column | None = None, rank: Callable[[Column, int], Column] | None = None, per_range: int = 100_000) -> DataFrame:
    """k rows drawn with replacement: `draw` (0 to k - 1) beside df's columns.

    Rows have a rank in the order of (spread, key), where spread is a number of 0 or more, by default a seeded hash of the key; a
    draw is a rank, by default a seeded hash of its number. Nothing is sorted as a whole: ranges of spread are counted,
    a draw finds its range through the sums of counts, and only ranges that were drawn order their rows. The same rows
    come at any partitioning as long as key tells rows apart; rows that it does not are told apart by nothing else, so any of
    them may come. An empty table gives no rows.
    """
    spark = df.sparkSession
    spread = F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)) if spread is None else spread.cast("long")
    rank = rank or (lambda draw, n: F.pmod(F.xxhash64(draw, F.lit(seed), F.lit("draw")), F.lit(n)))
    x = df.withColumn("_s", spread)
    found = x.agg(F.count("*").alias("n"), F.max("_s").alias("top")).first()
    n = found["n"]
    if not n or k < 1:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    width = found["top"] // max(1, n // per_range) + 1
    x = x.withColumn("_r", F.expr(f"_s DIV {width}L"))
    counts = x.groupBy("_r").agg(F.count("*").alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    # ranges and draws meet on the hundred thousands of ranks they lie in
    spans = counts.withColumn("_first", before).withColumn("_b", F.explode(F.expr(f"sequence(_first DIV {per_range}, (_first + _n - 1) DIV {per_range})")))
    draws = spark.range(k).select(F.col("id").alias("draw"), rank(F.col("id"), n).cast("long").alias("_at")).withColumn("_b", F.expr(f"_at DIV {per_range}"))
    at = draws.join(spans, "_b").filter("_at >= _first AND _at < _first + _n").select("draw", "_r", (F.col("_at") - F.col("_first")).alias("_k"))
    own = x.join(at.select("_r").distinct(), "_r", "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy("_s", *key)) - 1)
    return own.join(at, ["_r", "_k"]).select("draw", *df.columns)


def stride_of(cells: int, aim: int = 6000) -> int:
    return max(1, round(math.sqrt(cells / aim)))


def strided(df: DataFrame, stride: int, i: str = "i", j: str = "j") -> DataFrame:
    return df.filter((F.col(i) % stride == 0) & (F.col(j) % stride == 0))


def rescaled_index(index: Column, visible: int, size: int) -> Column:
    """Grid index of a column of a reduced view."""
    return (index / float(max(visible - 1, 1)) * (size - 1)).cast("int")


def argbest(df: DataFrame, by: Sequence[str], value: str, index: str, largest: bool = True) -> DataFrame:
    """Row index of the extreme value by group, the first of equals."""
    pick = F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("n"))) if largest else F.min(F.struct(F.col(value).alias("v"), F.col(index).alias("n")))
    out = df.groupBy(*by).agg(pick.alias("m"))
    return out.select(*by, F.col("m.v").alias(value), (-F.col("m.n") if largest else F.col("m.n")).alias(index))
