"""Exact dedup: a tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition makes a run of digests, sorted and reduced to one entry a digest. In each round, the
runs whose numbers agree above the lowest bits are merged (`fan_in` to one, so a binomial tree): entries
are exchanged by (run, digest), sorted again and merged with the smallest doc_id and the number of rows kept.
The minimum is a struct, for which Spark merges sorted rows instead of hashing. An entry carries a second
digest and the text's length beside SHA-256 and all three must agree, which verifies what is merged. A digest
that a third of all rows share costs one entry a partition and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SPACE = r"[\x20\x09-\x0D]+"
KEY = ("digest", "check", "n_chars_norm")


def _keyed(rows: DataFrame, text: str, names: tuple[str, ...] = KEY) -> DataFrame:
    """rows with digest, check and length of `text` under these names, in place of it."""
    made = (F.unhex(F.sha2(text, 256)), F.xxhash64(text), F.length(text))
    return rows.withColumns(dict(zip(names, made, strict=True))).drop(text)


def _normal() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")


def with_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, check and length of the normalised text; null counts as empty."""
    return _keyed(docs.select("doc_id", _normal().alias("t")), "t")


def merge_runs(digests: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row a distinct text: digest, check, n_chars_norm, keep_id, group_size."""
    if runs < 1 or fan_in < 2:
        raise ValueError("runs >= 1 and fan_in >= 2 are needed")
    level = digests.select(*KEY, F.expr(f"CAST(pmod(spark_partition_id(), {runs}) AS INT)").alias("run"), F.struct("doc_id").alias("low"), F.lit(1).cast("long").alias("n"))
    left = runs
    while True:
        left = -(-left // fan_in)
        level = level.withColumn("run", F.expr(f"run DIV {fan_in}").cast("int")).groupBy("run", *KEY).agg(F.min(F.when(F.col("low.doc_id").isNotNull(), F.col("low"))).alias("low"), F.sum("n").alias("n"))
        if left == 1:
            return level.select(*KEY, F.col("low.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text; others are ignored).

    Texts are equal when identical after each run of white space (`[\\x20\\x09-\\x0D]+`) is one space; null is
    empty. The row with the smallest doc_id stays. Rows that repeat that doc_id and text stay too; a row
    without doc_id stays only if its text has no row with one (keep_id is then null). Empty in, empty out.
    """
    digests = materialise(with_digests(docs), "digests", scan=True)  # texts are read, normalised and hashed once
    merged = merge_runs(digests, runs, fan_in)
    out = digests.join(merged, list(KEY))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Exactly the rows that `exact_duplicates` marks as not kept go: a row is told by its doc_id, null included,
    and its text's digests, so that other rows with the doc_id of a dropped one stay.
    Only identifiers are exchanged by digest; the texts meet the (few) dropped identifiers once.
    """
    digests = materialise(with_digests(docs), "digests", scan=True)
    both = digests.join(merge_runs(digests, runs, fan_in), list(KEY)).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    dropped = both.select(F.col("doc_id").alias("_dropped_id"), *(F.col(k).alias(f"_dropped_{k}") for k in KEY)).distinct()
    own = [f"_own_{k}" for k in KEY]
    rows = _keyed(docs.withColumn("_own_t", _normal()), "_own_t", tuple(own))
    same = F.col("doc_id").eqNullSafe(F.col("_dropped_id"))
    for k in KEY:
        same &= F.col(f"_own_{k}") == F.col(f"_dropped_{k}")
    return rows.join(dropped, same, "left_anti").drop(*own)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
