"""Alignment of two tokenizers' tokens by the byte offsets at which both end.

A whole Arrow batch is laid end to end with the documents' byte offsets. The ends of A's and of B's tokens are counted
once for each byte (bincount); where both have one the text is cut, so that a group is the least span that both
tokenize on their own. Prefix sums over the bytes give each token its group, and their differences at the documents'
offsets each document's results.

How often two ids end together in the whole corpus takes a second pass: links are kept as one number each, counted
inside tasks, and summed by pair. The most frequent pairs, at most `most_pairs`, are sent to all tasks; links of the
others, each rare, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bpe, byte_alphabet, default_vocabulary
from .shared import materialise, small_batches
from .textbatch import utf8

#: Bytes, tokens or ids handled by one numpy call, which bounds what a very long text takes beside itself.
SLICE = 1 << 20
#: Bytes of text in an Arrow batch: two encoders' lists and a dozen arrays over its bytes and tokens take some 100 times that.
BATCH_BYTES = 1 << 20
#: tiktoken gives up on white space of about a million characters; texts with this much go to this package's encoder.
BLANKS = re.compile(r"(?<!\s)\s{100000}")


class Side:
    """One tokenizer: `encode` takes texts to lists of ids, `size`, `begin` and `data` hold the bytes of each id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        size = self.size[ids]
        place = np.repeat(self.begin[ids] - np.cumsum(size) + size, size)
        return self.data[place + np.arange(len(place))]


def byte_bpe(path: str) -> Side:
    """A byte-level BPE vocabulary (tokenizer JSON); a space is put before the text, special tokens' strings are text."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
    fast = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token

    slow: list[Bpe] = []

    def encode_one(text: str) -> list[int]:
        if len(text) < 100_000 or not BLANKS.search(text):
            return fast.encode_ordinary(text)
        if not slow:
            slow.append(Bpe(path))
            slow[0].cut = None  # no special tokens
        return slow[0].encode(text).tolist()

    def encode(texts: list[str]) -> list[list[int]]:
        return [encode_one(" " + t) for t in texts]

    return Side(encode, tokens)


def piece_bpe(path: str) -> Side:
    """A sentencepiece model with byte fallback, which puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = map(model.id_to_piece, range(model.get_piece_size()))
    tokens = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer of a file, once a process: sentencepiece for `.model`, byte-level BPE otherwise."""
    if path not in _SIDES:
        _SIDES[path] = piece_bpe(path) if path.endswith(".model") else byte_bpe(path)
    return _SIDES[path]


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Ids of several documents, those of document i at first[i]:first[i+1]."""

    def __init__(self, lists: list[list[int]]):
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        self.ids = np.fromiter(chain.from_iterable(lists), np.int32, int(self.first[-1]))

    def keep(self, good: np.ndarray) -> None:
        count = np.diff(self.first)
        self.ids = self.ids[np.repeat(good, count)]
        self.first = np.concatenate([[0], np.cumsum(count * good)])

    def differing(self, of: Side, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which documents' tokens do not join to their bytes; lengths are compared first, then bytes."""
        ends = np.concatenate([[0], np.cumsum(of.size[self.ids])])
        at = ends[self.first]
        bad = np.diff(at) != np.diff(offsets)
        if bad.any():
            return bad
        for i in range(0, len(self.ids), SLICE):
            j = min(i + SLICE, len(self.ids))
            other = np.flatnonzero(of.joined(self.ids[i:j]) != data[ends[i] : ends[j]])
            bad[np.searchsorted(offsets, other + ends[i], side="right") - 1] = True
        return bad


def _ending(ends: np.ndarray, total: int) -> np.ndarray:
    """How many tokens end at each byte offset from 0 to total, counted a slice of the text at a time."""
    out = np.zeros(total + 1, np.uint8)
    for i in range(0, total + 1, SLICE):
        own = ends[np.searchsorted(ends, i) : np.searchsorted(ends, i + SLICE)]
        n = min(SLICE, total + 1 - i)
        out[i : i + n] = np.bincount(own - i, minlength=n)
    return out


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, left-aligned in rows with room for a separator, and their number."""
    width = len(str(max(n - 1, 1)))
    size = np.array([len(str(i)) for i in range(n)], np.int64)
    digits = np.frombuffer("".join(str(i).ljust(width + 1) for i in range(n)).encode(), np.uint8)
    return digits.reshape(n, width + 1), size


def align(texts: list[str | None], a_side: Side, b_side: Side) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups of each text, digests of their groups, links as a * B's size + b, where each text's begin)."""
    whole = [i for i, t in enumerate(texts) if t]
    a, b = (Tokens(s.encode([texts[i] for i in whole])) for s in (a_side, b_side))
    while True:  # texts that a tokenizer does not give back have no tokens
        encoded = [b" " + texts[i].encode() for i in whole]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
        data = np.frombuffer(b"".join(encoded), np.uint8)
        del encoded
        bad = a.differing(a_side, data, offsets) | b.differing(b_side, data, offsets)
        if not bad.any():
            break
        a.keep(~bad)
        b.keep(~bad)
        whole = [i for i, w in zip(whole, bad, strict=True) if not w]
        a.first, b.first = (t.first[np.append(True, ~bad)] for t in (a, b))
    total = int(offsets[-1])
    end_a, end_b = np.cumsum(a_side.size[a.ids]), np.cumsum(b_side.size[b.ids])
    at_a, at_b = _ending(end_a, total), _ending(end_b, total)
    cut = (at_a > 0) & (at_b > 0)
    sum_a, sum_b, sum_cut = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, cut))
    cuts = np.flatnonzero(cut)
    link = a.ids[sum_a[cuts] - 1].astype(np.int64) * len(b_side.size) + b.ids[sum_b[cuts] - 1]

    out = {}
    for name, sums in (("n_a", sum_a), ("n_b", sum_b), ("n_groups", sum_cut)):
        out[name] = np.zeros(len(texts), np.int64)
        out[name][whole] = np.diff(sums[offsets])
    first = np.concatenate([[0], np.cumsum(out["n_groups"])])

    # a1,a2|b1;a3|b2,b3: a token's place is its own number and that of the other side's tokens before it
    before_b = np.concatenate([[0], sum_b[cuts]])
    place_a = np.arange(len(a.ids)) + before_b[sum_cut[end_a - 1]]
    place_b = np.arange(len(b.ids)) + sum_a[cuts][sum_cut[end_b - 1]]
    ids = np.empty(len(a.ids) + len(b.ids), np.int32)
    mark = np.empty(len(ids), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    mark[place_a] = np.where(cut[end_a], ord("|"), ord(","))
    mark[place_b] = np.where(cut[end_b], ord(";"), ord(","))
    digits, size = _digits(max(len(a_side.size), len(b_side.size)))
    parts = []
    for i in range(0, len(ids), SLICE):
        own = ids[i : i + SLICE]
        rows, length = digits[own], size[own]
        rows[np.arange(len(own)), length] = mark[i : i + SLICE]
        parts.append(rows[np.arange(rows.shape[1]) <= length[:, None]].tobytes())
    text = memoryview(b"".join(parts))
    chars = np.concatenate([[0], np.cumsum(size[ids] + 1)])[(sum_a[offsets].astype(np.int64) + sum_b[offsets])]
    digests = [""] * len(texts)
    for i, s, e in zip(whole, chars[:-1].tolist(), chars[1:].tolist(), strict=True):
        digests[i] = hashlib.sha256(text[s : e - 1]).hexdigest()
    return out, digests, link, first


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _link_type(a_side: Side, b_side: Side) -> str:
    return "<u4" if len(a_side.size) * len(b_side.size) <= 2**32 else "<u8"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, groups_sha256 and links (little-endian a * B's size + b, in order)."""

    def run(batches):
        a_side, b_side = side(a_path), side(b_path)
        kind = np.dtype(_link_type(a_side, b_side))
        for batch in batches:
            out, digests, link, first = align(batch.column("text").to_pylist(), a_side, b_side)
            packed = link.astype(kind).tobytes()
            at = (first * kind.itemsize).tolist()
            links = [packed[i:j] for i, j in zip(at, at[1:])]
            numbers = (out[k] for k in ("n_a", "n_b", "n_groups"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, numbers), pa.array(digests, pa.string()), pa.array(links, pa.binary())], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(links: DataFrame, kind: str, width: int, held: int = 1 << 20) -> DataFrame:
    """pair, n, best (whether no pair of the same B id is more frequent), over all links; width is B's number of ids."""

    def run(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            new, n = np.unique(utf8(batch.column("links"))[0].view(kind), return_counts=True)
            both = np.concatenate([pairs, new.astype(np.int64)])
            pairs, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
            if len(pairs) > held:
                yield out()
                pairs, counts = pairs[:0], counts[:0]
        yield out()

    summed = links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # a B id has at most as many pairs as A has ids
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair % {width}"))))


def _frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """(least count, of powers of two, that at most `most` pairs reach; how many pairs are below it)."""
    have = {int(r["power"]): r["count"] for r in pairs.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().collect()}
    kept, least = 0, max(have, default=0) + 1
    while least > 0 and kept + have.get(least - 1, 0) <= most:
        least -= 1
        kept += have.get(least, 0)
    return 2**least, sum(have.values()) - kept


HEAD = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_pairs: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of docs (doc_id, text; others are ignored).

    A encodes a space and the text, B the text; groups, links and counts are described above. n_best counts the links
    whose pair is, over all documents, the most frequent of its B id, ties included; count_sum adds up the counts
    of all links. Texts that are null or empty, or that a tokenizer does not give back byte by byte, have zeros and an
    empty digest. Texts of any length are taken whole; repeated rows count each; rows without doc_id stay; empty in,
    empty out. At most `most_pairs` pairs with their counts reach the driver and the tasks.
    """
    a_path, b_path = a_path or default_vocabulary(), b_path or piece_vocabulary()
    kind, width = _link_type(side(a_path), side(b_path)), len(side(b_path).size)
    aligned = materialise(alignments(docs, a_path, b_path), "aligned", scan=True)
    pairs = materialise(pair_counts(aligned, kind, width), "pairs", light=True)
    least, rare = _frequent(pairs, most_pairs)
    table = pairs.filter(F.col("n") >= least).toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batch):
        pair, n, best = sent.value
        data, offsets = utf8(batch.column("links"))
        link = data.view(kind).astype(np.int64)
        at = np.minimum(np.searchsorted(pair, link), max(len(pair) - 1, 0))
        known = pair[at] == link if len(pair) else np.zeros(len(link), bool)
        return link, offsets // np.dtype(kind).itemsize, at, known, n, best

    def run(batches):
        for batch in batches:
            link, first, at, known, n, best = look_up(batch)
            sums = []
            for values in (best, n):
                each = np.zeros(len(link) + 1, np.int64)
                each[1:][known] = values[at[known]]
                sums.append(pa.array(np.diff(np.cumsum(each)[first])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in HEAD), *sums], names=[*HEAD, "n_best", "count_sum"])

    out = aligned.mapInArrow(run, ALIGNED.replace("links binary", "n_best long, count_sum long"))
    if rare:

        def others(batches):
            for batch in batches:
                link, first, _, known, *_ = look_up(batch)
                row = np.repeat(batch.column("row").to_numpy(), np.diff(first))[~known]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(link[~known])], names=["own", "pair"])

        met = aligned.select("row", "links").mapInArrow(others, "own long, pair long").join(pairs.filter(F.col("n") < least), "pair")
        met = met.groupBy("own").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum"))
        out = out.join(met, F.col("row") == F.col("own"), "left")
        out = out.withColumns({"n_best": F.expr("n_best + coalesce(more_best, 0L)"), "count_sum": F.expr("count_sum + coalesce(more_sum, 0L)")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    small_batches(spark, BATCH_BYTES)
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
