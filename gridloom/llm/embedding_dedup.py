"""Embedding near-dedup by p-stable (Euclidean) hashing of normalised vectors.

A hash is floor((a . x + b) / width) with Gaussian a: for unit vectors at cosine 0.93 (distance 0.374) it agrees
with probability 0.75, for unrelated ones with 0.32. Tables of `k` hashes each bring candidates together;
each bucket's candidates are compared by exact cosines in double precision. Rows with one label and one
vector are one class with a multiplicity, so copies are never compared. Buckets larger than `block`
classes are split into pairs of blocks that different tasks compare. Inside a task only counts and a spanning
set of links leave, never all pairs; a pair that several tables find counts in the first one only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, small_batches

WIDTH = 1.2
NEAR, FAR = 0.75, 0.32  # probability that one hash agrees at the threshold, and between unrelated vectors


CROWD, MISS = 2000, 0.002


def plan(n: int, miss: float = MISS, crowd: int = CROWD) -> tuple[int, int]:
    """(k, tables): hashes a table so that about `crowd` unrelated vectors of n share a bucket, and tables so
    that a pair at the threshold is missed with probability `miss`."""
    k = max(1, math.ceil(math.log(max(n, 1) / crowd) / -math.log(FAR)))
    return k, tables_of(k, miss)


def tables_of(k: int, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - NEAR**k))


class Hashes:
    def __init__(self, dim: int, k: int, tables: int, seed: int = 20240917):
        rng = np.random.default_rng([seed, dim, k, tables])
        self.k, self.tables = k, tables
        self.a = rng.standard_normal((dim, k * tables))
        self.b = rng.uniform(0, WIDTH, k * tables)

    def codes(self, unit: np.ndarray, first: int | None = None) -> np.ndarray:
        """One 64-bit code a table, of the first so many or all; quantised projections are mixed, so equal codes mean equal cells."""
        tables = self.tables if first is None else first
        a, b = self.a[:, : self.k * tables], self.b[: self.k * tables]
        cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64)
        out = np.zeros((len(unit), tables), np.uint64)
        for j in range(self.k):
            out = (out ^ cells[:, j :: self.k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


@lru_cache(maxsize=16)
def hashes(dim: int, k: int, tables: int) -> Hashes:
    """The projections of a kind of label, drawn once a worker."""
    return Hashes(dim, k, tables)


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _hashed(miss: float):
    def run(batches):
        for batch in batches:
            for dim, k in sorted(set(zip(batch.column("dim").to_pylist(), batch.column("k").to_pylist()))):
                part = batch.filter(pa.compute.and_(pa.compute.equal(batch.column("dim"), dim), pa.compute.equal(batch.column("k"), k)))
                tables = tables_of(k, miss)
                codes = hashes(dim, k, tables).codes(_unit(_matrix(part.column("vec"))))
                for t in range(tables):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "label", "dim", "k")), pa.array(np.full(n, t, np.int32)), pa.array(np.ascontiguousarray(codes[:, t]))], names=["rep", "label", "dim", "k", "t", "code"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member's row of each row's component, given links i-j."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compared(miss: float, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("side", "ascending")])
        rep, m, side = (table.column(c).to_numpy() for c in ("rep", "m", "side"))
        t, k = table.column("t")[0].as_py(), table.column("k")[0].as_py()
        v = _matrix(table.column("vec"))
        codes = hashes(v.shape[1], k, tables_of(k, miss)).codes(_unit(v), t)  # of the tables before this one
        norm = np.sqrt((v * v).sum(axis=1))
        links = np.zeros(len(rep), np.int64)
        ii, jj = [], []
        cross = len(set(side.tolist())) > 1
        for a in range(0, len(rep), 512):
            c = (v[a : a + 512] @ v.T) / (norm[a : a + 512, None] * norm[None, :])
            i, j = np.nonzero(c >= cosine)
            i += a
            ok = i < j
            if cross:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            ii.append(i)
            jj.append(j)
            new = ~(codes[i] == codes[j]).any(axis=1) if t else np.ones(len(i), bool)
            np.add.at(links, i[new], m[j[new]])
            np.add.at(links, j[new], m[i[new]])
        root = _roots(len(rep), np.concatenate(ii), np.concatenate(jj))
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        return pa.table({"rep": rep[keep], "links": links[keep], "root": rep[root[keep]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, block: int = 1024, miss: float = MISS, crowd: int = CROWD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label; others are ignored).

    Rows are compared when their labels are equal and not null and their dimensions agree. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without label, link with nothing. Equal
    vectors link whatever their number; ties go to the smallest vec_id. vec_id must be 0 or more and unique; a row
    without one links with nothing and is kept.
    Every row is hashed and found pairs are confirmed exactly. A label's hashes a table and tables follow from the number
    of its vectors (`plan`), so that small labels are shipped to few tables; recall is that of `plan`. Empty in, empty out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.filter("fine")
    classes = materialise(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("vec")), "classes")
    n = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    n = n.select("label", "dim", F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / crowd) / -math.log(FAR))).cast("int").alias("k"))
    hashed = classes.select("rep", "label", "dim", "vec").join(n, ["label", "dim"]).select("rep", "label", "dim", "k", "vec").mapInArrow(_hashed(miss), "rep long, label string, dim int, k int, t int, code long")
    hashed = materialise(hashed, "hashed")
    bucket = ["label", "dim", "k", "t", "code"]
    sizes = hashed.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    member = hashed.join(sizes, bucket).withColumn("own", F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)"))
    member = member.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    member = member.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).withColumn("side", F.col("own"))
    member = member.join(classes.select("rep", "vec", "m"), "rep").select(*bucket, "lo", "hi", "side", "rep", "m", "vec")
    found = member.groupBy(*bucket, "lo", "hi").applyInArrow(_compared(miss, cosine), "rep long, links long, root long")
    found = materialise(found, "near")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    classes = classes.join(links, "rep", "left").join(parts, "rep", "left")
    classes = classes.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(classes, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


