"""Shared search for windows of text that occur more than once, at cluster scale.

Used by substring dedup (13-word windows) and suffix-array dedup (400-byte windows). Every window is
owned by its anchor, a short gram chosen by content alone, so equal windows have equal anchors and
neighbouring windows with one anchor form a run. The steps, none of which holds a corpus-wide
structure anywhere:

1. Documents are dealt into chunks by a hash of doc_id (the one shuffle of text; later steps reuse it).
2. Each chunk asks which of its distinct anchor keys exist elsewhere: sorted key fragments go to key
   buckets as packed blobs, the answer is one bit a key. A key held by a third of all documents costs
   one entry a chunk.
3. Runs with repeated keys are named by (key, keyed cryptographic digest of the run's text), 128 bits
   together, and pre-aggregated in the chunk, then across chunks. The digest reads the bytes themselves, so the
   cheaper hashes only choose anchors: where they collide, a key gets more names, never a wrong verdict.
4. A key with one name needs no index: its runs are equal from end to end. For keys with several
   names, one representative text a name goes to a shard by key, where the operator's own index
   (suffix automaton or difference-cover suffix array) decides each window.
5. Keys with more than `hot_names` names are decided by 128-bit digests of single windows instead,
   spread over the cluster, which is exact too and keeps shards bounded.
6. Verdicts travel back to the chunks that hold the name and are applied to the text.

A chunk sends a row to a key bucket only if it has keys there, so the rows of step 2 are never more than the distinct
keys of all chunks, however many chunks there are. Chunks are numbered so that each has a shuffle partition of its
own (`labels`): the largest task is one chunk, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release
from .textbatch import chunks, digests, mix, runs, utf8

#: Up to so many chunks, each gets a partition of its own; more of them even out by their number, and need no list of labels.
LABELLED = 4096
FRAGMENT = 5  # bytes of a key that are sent; the bucket number holds the rest


@dataclass
class Parsed:
    """Symbols of some documents (document i owns first[i]:first[i + 1]), and where each lies in the batch's bytes
    (begin, end) and in `text` (t0, t1), of which a run's digest is taken. order: what anchors are chosen by."""

    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    order: np.ndarray
    text: np.ndarray
    t0: np.ndarray
    t1: np.ndarray


@dataclass
class Runs:
    """Runs of windows: key, document's row, first and last window (s, e), bytes in the document and in `text`."""

    key: np.ndarray
    doc: np.ndarray
    s: np.ndarray
    e: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    t0: np.ndarray
    t1: np.ndarray
    text: np.ndarray

    def spans(self, rows: np.ndarray) -> np.ndarray:
        """Digest of the text of each of these runs."""
        view = memoryview(np.ascontiguousarray(self.text))
        return digests(view[i:j] for i, j in zip(self.t0[rows].tolist(), self.t1[rows].tolist()))


@dataclass
class Repeats:
    """One kind of window. `parse` turns (bytes, offsets) into a Parsed; see subclasses."""

    window: int
    gram: int
    by_document: bool  # windows count only if they start in different documents
    parts: int
    hot_names: int = 4096

    # -- to be given by the operator ------------------------------------------------------------
    def parse(self, data: np.ndarray, offsets: np.ndarray) -> Parsed:
        raise NotImplementedError

    def shard(self, names: pa.Table) -> list[bytes]:
        """Verdict of each row of names (n, doc, text); see `judge` for its format."""
        raise NotImplementedError

    def windows_of(self, text: bytes) -> list[bytes]:
        raise NotImplementedError

    # -- the common part --------------------------------------------------------------------------
    def runs_of(self, data: np.ndarray, offsets: np.ndarray) -> Runs:
        p = self.parse(data, offsets)
        doc, s, e, a = runs(p.order, p.grams, p.first, self.window, self.gram)
        if not len(doc):
            none = np.zeros(0, np.int64)
            return Runs(none.astype(np.uint64), *[none] * 7, p.text)
        last = e + self.window - 1
        return Runs(p.grams[a], doc, s, e, p.begin[s] - offsets[doc], p.end[last] - offsets[doc], p.t0[s], p.t1[last], p.text)

    def pieces(self, table: pa.Table):
        """(doc_ids, bytes, offsets) of a few documents at a time."""
        for batch in table.select(["doc_id", "text"]).to_batches():
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                yield ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]

    def all_runs(self, table: pa.Table) -> list[tuple[np.ndarray, Runs]]:
        """(doc_ids, runs) of a chunk's documents, a few at a time."""
        return [(ids, self.runs_of(data, offsets)) for ids, data, offsets in self.pieces(table)]

    def split(self, found: list[tuple[np.ndarray, Runs]]):
        """Distinct keys sorted by (bucket, fragment), which of them the chunk itself repeats, buckets, fragments."""
        key, doc = (np.concatenate(x) for x in zip(*((r.key, ids[r.doc]) for ids, r in found)))
        buckets = np.uint64(self.parts)
        if self.by_document and len(key):
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key = key[keep]
        unique, count = np.unique(key, return_counts=True)
        bucket = unique % buckets
        fragment = (unique // buckets) & np.uint64(2 ** (8 * FRAGMENT) - 1)
        order = np.lexsort((unique, fragment, bucket))
        return unique[order], count[order] > 1, bucket[order].astype(np.int64), fragment[order]

    def questions(self, table: pa.Table) -> pa.Table:
        unique, _, bucket, fragment = self.split(self.all_runs(table))
        chunk = table.column("chunk")[0].as_py()
        held, begin = np.unique(bucket, return_index=True)  # a chunk meets at most as many buckets as it has keys
        edges = np.append(begin, len(bucket)).tolist()
        packed = np.ascontiguousarray(fragment.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :FRAGMENT]
        rows = [(b, packed[i:j].tobytes()) for b, i, j in zip(held.tolist(), edges, edges[1:])]
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "keys": pa.array([k for _, k in rows], pa.binary())})

    @staticmethod
    def answers(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        parts = []
        for blob in blobs:
            wide = np.zeros((len(blob) // FRAGMENT, 8), np.uint8)
            wide[:, :FRAGMENT] = np.frombuffer(blob, np.uint8).reshape(-1, FRAGMENT)
            parts.append(wide.view("<u8").ravel())
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if len(twice):
            bits = [np.packbits(twice[np.minimum(np.searchsorted(twice, p), len(twice) - 1)] == p).tobytes() for p in parts]
        else:
            bits = [np.packbits(np.zeros(len(p), bool)).tobytes() for p in parts]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def named(self, docs: pa.Table, bits: pa.Table) -> pa.Table:
        """The chunk's names: runs whose keys occur elsewhere, pre-aggregated by (key, span)."""
        if not docs.num_rows:
            return NAMES.empty_table()
        runs = self.all_runs(docs)
        unique, twice, bucket, _ = self.split(runs)
        live = twice.copy()
        asked = bits.column("bucket").to_numpy()
        begin, end = np.searchsorted(bucket, asked), np.searchsorted(bucket, asked, side="right")
        for i, j, blob in zip(begin.tolist(), end.tolist(), bits.column("bits").to_pylist(), strict=True):
            live[i:j] |= np.unpackbits(np.frombuffer(blob, np.uint8), count=j - i).astype(bool)
        active = np.sort(unique[live])
        if not len(active):
            return NAMES.empty_table()
        out = []
        for ids, r in runs:
            keep = np.flatnonzero(active[np.minimum(np.searchsorted(active, r.key), len(active) - 1)] == r.key)
            if len(keep):
                out.append((r.key[keep], r.spans(keep), ids[r.doc[keep]], r.b0[keep], r.b1[keep]))
        if not out:
            return NAMES.empty_table()
        key, span, doc, b0, b1 = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((b0, doc, span, key))
        key, span, doc, b0, b1 = (x[order] for x in (key, span, doc, b0, b1))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(key)))
        chunk = docs.column("chunk")[0].as_py()
        return pa.table([key[at].view(np.int64), span[at].view(np.int64), n, doc[at], b0[at], b1[at], np.full(len(at), chunk, np.int32)], schema=NAMES)

    def texts(self, docs: pa.Table, names: pa.Table) -> pa.Table:
        """The representative text of each name whose representative is in this chunk."""
        if not names.num_rows or not docs.num_rows:
            return TEXTS.empty_table()
        want = np.unique(names.column("doc").to_numpy())
        ids = docs.column("doc_id").to_numpy()
        rows = np.flatnonzero(np.isin(ids, want))
        raw = {int(ids[r]): docs.column("text")[int(r)].as_py().encode() for r in rows}
        cut = [raw[d][i:j] for d, i, j in zip(names.column("doc").to_pylist(), names.column("b0").to_pylist(), names.column("b1").to_pylist(), strict=True)]
        return pa.table([names.column("key"), names.column("span"), names.column("n"), names.column("doc"), pa.array(cut, pa.binary())], schema=TEXTS)

    def judged(self, names: pa.Table) -> pa.Table:
        return pa.table([names.column("key"), names.column("span"), pa.array(self.shard(names), pa.binary())], schema=VERDICT)

    def digests(self, batches):
        """For names of hot keys: 128-bit digest of each window."""
        import hashlib

        for batch in batches:
            rows = []
            for key, span, n, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "span", "n", "doc", "text")), strict=True):
                for x, w in enumerate(self.windows_of(text)):
                    rows.append((key, span, x, hashlib.blake2b(w, digest_size=16).digest(), n, doc))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "span", "x", "w", "n", "doc"])

    def verdicts(self, names: DataFrame, docs: DataFrame) -> DataFrame:
        """(key, span, n, doc, chunks, verdict): verdict is null where all runs of the key are equal."""
        # the second key follows from the first; with it the join exchanges both sides, so a hot key can be split
        per_key = names.groupBy("key", F.shiftright("key", 63).alias("z")).agg(F.count("*").alias("n_names")).filter("n_names > 1").drop("z")
        several = names.join(per_key, "key").select(F.col("rep_chunk").alias("chunk"), "key", "span", "n", "doc", "b0", "b1", "n_names")
        pick = ("chunk", "key", "span", "n", "doc", "b0", "b1")
        plain = _pair(docs, several.filter(F.col("n_names") <= self.hot_names).select(*pick)).applyInArrow(lambda left, right: self.texts(left, right), TEXTS_DDL)
        # shards hold an index in memory, so there are more of them than chunks
        judged = plain.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(key), {8 * self.parts}) AS INT)")).groupBy("shard").applyInArrow(lambda t: self.judged(t), VERDICT_DDL)
        if not per_key.filter(F.col("n_names") > self.hot_names).isEmpty():
            hot = _pair(docs, several.filter(F.col("n_names") > self.hot_names).select(*pick)).applyInArrow(lambda left, right: self.texts(left, right), TEXTS_DDL)
            single = hot.mapInArrow(self.digests, "key long, span long, x int, w binary, n long, doc long")
            totals = single.groupBy("w", F.length("w").alias("z")).agg(F.sum("n").alias("n"), F.min("doc").alias("doc")).drop("z")
            decided = single.select("key", "span", "x", "w").join(totals, "w").groupBy("key", "span").agg(F.array_sort(F.collect_list(F.struct("x", "n", "doc"))).alias("v"))
            judged = judged.unionByName(decided.select("key", "span", self.pack(F.col("v")).alias("verdict")))
        found = names.select("key", "span", "n", "doc", "chunks").join(judged, ["key", "span"], "left")
        return found.filter("n > 1 OR verdict IS NOT NULL")

    def pack(self, v):
        raise NotImplementedError

    def search(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents with their chunk, verdicts exploded to chunks)."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        chunk = f"CAST(pmod(xxhash64(doc_id), {self.parts}) AS INT)"
        if self.parts <= LABELLED:
            names = ",".join(map(str, labels(self.parts).tolist()))
            chunk = f"element_at(CAST(split('{names}', ',') AS ARRAY<INT>), {chunk} + 1)"
        docs = docs.withColumn("chunk", F.expr(chunk))
        bits = docs.groupBy("chunk").applyInArrow(lambda t: self.questions(t), "chunk int, bucket int, keys binary").groupBy("bucket").applyInArrow(self.answers, "chunk int, bucket int, bits binary")
        names = _pair(docs, bits).applyInArrow(lambda left, right: self.named(left, right), NAMES_DDL)
        names = names.groupBy("key", "span").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "b0", "b1", "chunk")).alias("rep"), F.collect_list("chunk").alias("chunks"))
        names = names.select("key", "span", "n", "rep.doc", "rep.b0", "rep.b1", F.col("rep.chunk").alias("rep_chunk"), "chunks")
        names = materialise(names, "repeats")
        del bits
        release(docs.sparkSession)  # the first phase's shuffles
        found = self.verdicts(names, docs).withColumn("chunk", F.explode("chunks")).drop("chunks")
        return docs, found

    def apply(self, docs: DataFrame, finish: Callable, schema: str) -> DataFrame:
        """finish(self, docs table, verdicts table): a chunk's result. Rows without doc_id come back with nulls."""
        nameless = docs.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"))
        docs, found = self.search(docs.filter("doc_id IS NOT NULL"))
        out = _pair(docs, found).applyInArrow(lambda left, right: finish(self, left, right), schema)
        return out.unionByName(nameless, allowMissingColumns=True)


def _pair(docs: DataFrame, other: DataFrame):
    return docs.groupBy("chunk").cogroup(other.groupBy("chunk"))


NAMES = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64()), ("chunk", pa.int32())])
NAMES_DDL = "key long, span long, n long, doc long, b0 long, b1 long, chunk int"
TEXTS = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("text", pa.binary())])
TEXTS_DDL = "key long, span long, n long, doc long, text binary"
VERDICT = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("verdict", pa.binary())])
VERDICT_DDL = "key long, span long, verdict binary"


def _partition(values: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition Spark puts each 32-bit integer into: its Murmur3 hash (seed 42) modulo `parts`."""

    def turn(x, n):
        return x << np.uint32(n) | x >> np.uint32(32 - n)

    h = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).astype(np.int32).astype(np.int64) % parts


def labels(parts: int) -> np.ndarray:
    """For each of `parts` shuffle partitions the smallest integer that lands in it."""
    out, first, step = np.full(parts, -1, np.int64), 0, 16 * parts
    while (out < 0).any():
        at, row = np.unique(_partition(np.arange(first, first + step), parts), return_index=True)
        new = out[at] < 0
        out[at[new]] = first + row[new]
        first += step
    return out


class Verdicts:
    """Look-up of (key, span) among a chunk's verdicts."""

    def __init__(self, table: pa.Table):
        key = table.column("key").to_numpy().view(np.uint64)
        span = table.column("span").to_numpy().view(np.uint64)
        self.order = np.lexsort((span, key))
        self.code = self._code(key[self.order], span[self.order])
        again = np.argsort(self.code, kind="stable")
        self.order, self.code = self.order[again], self.code[again]
        self.key, self.span = key[self.order], span[self.order]
        self.keys = np.unique(key)
        _, same = np.unique(self.code, return_counts=True)
        self.ties = int(same.max(initial=1)) - 1
        self.n = table.column("n").to_numpy()[self.order]
        self.doc = table.column("doc").to_numpy()[self.order]
        column = table.column("verdict").combine_chunks()
        self.verdict = column.take(pa.array(self.order))

    @staticmethod
    def _code(key: np.ndarray, span: np.ndarray) -> np.ndarray:
        return mix(key * np.uint64(0x9E3779B97F4A7C15) + span)

    def find(self, found: Runs) -> np.ndarray:
        """Row of each run, or -1."""
        out = np.full(len(found.key), -1)
        if not len(self.code) or not len(out):
            return out
        rows = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, found.key), len(self.keys) - 1)] == found.key)
        if len(rows):
            key, span = found.key[rows], found.spans(rows)
            at = np.minimum(np.searchsorted(self.code, code := self._code(key, span)), len(self.code) - 1)
            for step in range(self.ties):  # rows of one code stand together
                at = np.where((self.code[at] == code) & ((self.key[at] != key) | (self.span[at] != span)), np.minimum(at + 1, len(self.code) - 1), at)
            out[rows] = np.where((self.key[at] == key) & (self.span[at] == span), at, -1)
        return out


def parts_of(spark) -> int:
    """Chunks, key buckets and shards: the session's number of shuffle partitions, which is sized to the input."""
    own = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) if spark.conf.get("spark.sql.adaptive.enabled") == "true" else None
    return max(2, int(own or spark.conf.get("spark.sql.shuffle.partitions")))
