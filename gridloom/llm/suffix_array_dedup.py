"""Suffix-array dedup: bytes covered by a 400-byte string that also starts anywhere else are removed.

The difference-cover suffix sort (`suffix_order`) runs in shards. Equal 400-byte strings have the same
anchor (see repeats.py), so the shard of an anchor holds all occurrences and the order of suffixes
across shards is never needed. Inside a shard: triples of sampled suffixes (start mod 3 is 1 or 2) are
sorted and named, the names are sorted by recursion until all are distinct, the remaining suffixes are
sorted by first symbol and sampled rank and merged in, and adjacent suffixes that agree in their
first 400 bytes are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Parsed, Repeats, Verdicts, parts_of
from .shared import small_batches
from .textbatch import byte_symbols, ngram_hashes, utf8

LENGTH = 400
GRAM = 128


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of an array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64)
    pad = np.concatenate([s, np.zeros(4, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # a dummy at n keeps the names of both classes apart
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # sort sampled triples
    base = int(s.max()) + 1
    if base < 2**21:
        triple = (pad[sample] * base + pad[sample + 1]) * base + pad[sample + 2]
        order = np.argsort(triple, kind="stable")
        ranked = triple[order]
        fresh = ranked[1:] != ranked[:-1]
    else:
        order = np.lexsort((pad[sample + 2], pad[sample + 1], pad[sample]))
        ranked = np.stack([pad[sample], pad[sample + 1], pad[sample + 2]])[:, order]
        fresh = (ranked[:, 1:] != ranked[:, :-1]).any(axis=0)
    names = np.ones(len(sample), np.int64)
    names[1:] += np.cumsum(fresh)
    rank = np.zeros(n + 4, np.int64)
    if names[-1] < len(sample):
        word = np.empty(len(sample), np.int64)
        word[order] = names
        order = suffix_order(word)  # recurse on names
    sorted_sample = sample[order]
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    # the remaining suffixes, by first symbol and rank of the next, a sampled one
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    lead = pad[zero] * wide + rank[zero + 1]
    by = np.argsort(lead, kind="stable")
    zero, lead = zero[by], lead[by]
    # merge: how many sampled suffixes of each class stand before each remaining one
    in_one = sorted_sample[sorted_sample % 3 == 1]
    in_two = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(pad[in_one] * wide + rank[in_one + 1], lead)
    pairs, code = np.unique(np.concatenate([pad[in_two] * base + pad[in_two + 1], pad[zero] * base + pad[zero + 1]]), return_inverse=True)
    key_two = code[: len(in_two)] * wide + rank[in_two + 2]
    before = before + np.searchsorted(key_two, code[len(in_two) :] * wide + rank[zero + 2])
    out = np.empty(n + len(one) + len(two) + len(zero) - n, np.int64)
    place = before + np.arange(len(zero))
    rest = np.ones(len(out), bool)
    rest[place] = False
    out[place] = zero
    out[rest] = sorted_sample
    return out[out < n]


def equal_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether text[i:i+length] equals text[j:j+length], for each i, j of left, right."""
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    same = np.arange(len(left))
    out = np.zeros(len(left), bool)
    words = np.lib.stride_tricks.sliding_window_view(pad, 8)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(same):
            return out
        a = np.ascontiguousarray(words[left[same] + at]).view(np.uint64).ravel()
        b = np.ascontiguousarray(words[right[same] + at]).view(np.uint64).ravel()
        same = same[a == b]
    out[same] = True
    return out


class ByteRepeats(Repeats):
    def parse(self, data, offsets):
        symbols = byte_symbols(data)
        grams = ngram_hashes(symbols, self.gram)
        at = np.arange(len(data) + 1)
        return Parsed(offsets, at, at + 1, grams, grams, data, at, at + 1)

    def windows_of(self, text):
        return [text[i : i + self.window] for i in range(len(text) - self.window + 1)]

    def shard(self, names: pa.Table) -> list[bytes]:
        data, offsets = utf8(names.column("text"))
        n = names.column("n").to_numpy()
        size = np.diff(offsets) - self.window + 1
        order = suffix_order(data.astype(np.int64) + 1)
        row = np.searchsorted(offsets, order, side="right") - 1
        inside = order + self.window <= offsets[row + 1]  # prefixes that lie in one name
        order, row = order[inside], row[inside]
        same = equal_prefixes(data, order[:-1], order[1:], self.window)
        twice = n[row] > 1
        twice[1:] |= same
        twice[:-1] |= same
        flag = np.zeros(len(data) + 1, bool)
        flag[order] = twice
        return [np.packbits(flag[offsets[i] : offsets[i] + size[i]]).tobytes() for i in range(len(n))]

    def pack(self, v):
        # one byte eight windows, as numpy.packbits
        bit = F.transform(v, lambda e: F.when(e["n"] > 1, F.lit("1")).otherwise(F.lit("0")))
        text = F.concat_ws("", bit)
        text = F.rpad(text, F.ceil(F.length(text) / 8).cast("int") * 8, "0")
        pieces = F.transform(F.sequence(F.lit(0), (F.length(text) / 8 - 1).cast("int")), lambda i: F.lpad(F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
        return F.unhex(F.concat_ws("", pieces))


def _covered(self: ByteRepeats, data, offsets, found: Verdicts) -> np.ndarray:
    """Which bytes are covered by a repeated window."""
    edge = np.zeros(len(data) + 1, np.int64)
    runs = self.runs_of(data, offsets)
    s, e, row = runs.s, runs.e, found.find(runs)
    hit = np.flatnonzero(row >= 0)
    valid = np.asarray(found.verdict.is_valid()) if len(found.code) else np.zeros(0, bool)
    whole = hit[~valid[row[hit]] | (found.n[row[hit]] > 1)] if len(hit) else hit
    np.add.at(edge, s[whole], 1)
    np.add.at(edge, e[whole] + self.window, -1)
    part = hit[valid[row[hit]] & (found.n[row[hit]] <= 1)] if len(hit) else hit
    for r in part:
        m = e[r] - s[r] + 1
        flags = np.flatnonzero(np.unpackbits(np.frombuffer(found.verdict[int(row[r])].as_py(), np.uint8), count=m))
        if len(flags):
            np.add.at(edge, s[r] + flags, 1)
            np.add.at(edge, s[r] + flags + self.window, -1)
    return np.cumsum(edge)[:-1] > 0


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"
DIGEST_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DIGEST = pa.schema([*list(OUT)[:4], ("kept_sha256", pa.string())])


def _finish(digest: bool):
    def finish(self: ByteRepeats, docs: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = Verdicts(right), []
        for ids, part, off in self.pieces(docs):
            gone = _covered(self, part, off, found)
            for r in range(len(ids)):
                own, out = part[off[r] : off[r + 1]], gone[off[r] : off[r + 1]]
                step = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                kept = own[~out].tobytes() if len(step) else own.tobytes()
                head = (int(ids[r]), len(own), len(own) - len(kept), len(step) // 2)
                rows.append((*head, hashlib.sha256(kept).hexdigest()) if digest else (*head, [{"start": int(a), "stop": int(b)} for a, b in step.reshape(-1, 2)], kept))
        schema = DIGEST if digest else OUT
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return finish


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_names: int = 4096, digest: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts at any other place.

    Input: doc_id, text; other columns are ignored, so their names cannot clash. Result, one row a document:
    doc_id, n_bytes, n_removed, n_spans, and `spans` (byte ranges removed) with `kept` (remaining bytes), or
    `kept_sha256` instead of these two if digest. Null and empty texts count as empty: zeros and the digest of
    nothing. Texts shorter than `length` are kept whole. Of equal texts all go, as each repeats the other.
    Repeated rows are texts of their own; a doc_id should be unique. A row without doc_id takes no part and
    returns with nulls. An empty table gives an empty result.
    Documents of any length are handled whole; matches never cross documents.
    """
    if not 16 <= gram <= length <= 4096:
        raise ValueError("16 <= gram <= length <= 4096 is needed")
    op = ByteRepeats(window=length, gram=gram, by_document=False, parts=parts_of(docs.sparkSession), hot_names=hot_names)
    return op.apply(docs, _finish(digest), DIGEST_DDL if digest else OUT_DDL)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
