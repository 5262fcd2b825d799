"""Tables kept in the shared folder between the phases of an operator."""

from __future__ import annotations

import gc
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset and the session is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/gridloom"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


HASH_RANGE = 2**62
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound the bytes of text handed to a Python worker at once; a smaller bound set by the user stays."""
    now = int(re.sub(r"\D", "", spark.conf.get(BATCH)) or 0)
    unit = spark.conf.get(BATCH).strip("0123456789 ").lower()[:1]
    now *= {"k": 2**10, "m": 2**20, "g": 2**30}.get(unit, 1)
    if now <= 0 or now > limit:
        spark.conf.set(BATCH, f"{limit}b")


MERGE = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def materialise(df: DataFrame, label: str, scan: bool = False, light: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs tasks, never the phases before. Files are kept few: scan says that df
    is one pass over its input, of which a task then takes up to four splits; light says that its last stage is
    cheap, so that adaptive execution may merge its partitions up to the advisory size even if cores then idle.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if scan:
        splits = df.rdd.getNumPartitions()
        df = df.coalesce(max(1, min(splits, max(2 * spark.sparkContext.defaultParallelism, splits // 4))))
    before = spark.conf.get(MERGE)
    if light:
        spark.conf.set(MERGE, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(MERGE, before)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose readers have all been written themselves."""
    for df in tables:
        _, path = _WRITTEN.pop(id(df), (None, None))
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def clear() -> None:
    """Delete all materialised tables of this process; only once no result that was returned is read any more."""
    discard(*(df for df, _ in list(_WRITTEN.values())))


def sampled(rows: DataFrame, n: int, most: int, key: str = "doc_id") -> DataFrame:
    """About `most` of n rows, those with the smallest hash of `key`, so the choice does not depend on partitions."""
    return rows if n <= most else rows.filter(F.expr(f"(xxhash64({key}) & {HASH_RANGE - 1}L) < {HASH_RANGE * most // n}L"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer used."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
