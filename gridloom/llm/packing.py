"""Best-fit packing of token sequences by bin completion with branch and bound.

What is packed is a histogram of lengths, at most `capacity` entries whatever the corpus, so the search runs
on the driver and the corpus never does. Bins are filled from the largest remaining length: its undominated
completions are enumerated best first, a branch is cut as soon as the waste so far shows that it can't beat
the incumbent (best-fit decreasing), and a chosen filling is used as often as the counts allow. Documents
then take the slots of their length by rank; a length's ranks are counted by blocks of bounded size, of which there
are as many as its rows need, and only the histogram reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, load
from .shared import materialise, small_batches

CAPACITY = 1024
END = 2
#: tiktoken gives up on white space of about a million characters; texts with this much go to this package's encoder.
BLANKS = re.compile(r"(?<!\s)\s{100000}")


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, how many such bins)] by best fit over the histogram."""
    left = dict(counts)
    sizes = sorted(left)
    out = []
    while sizes:
        fill, room = [], capacity
        used: dict[int, int] = {}
        while True:
            i = bisect_right(sizes, room) - 1
            while i >= 0 and left[sizes[i]] - used.get(sizes[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            fill.append(sizes[i])
            used[sizes[i]] = used.get(sizes[i], 0) + 1
            room -= sizes[i]
        times = min(left[s] // u for s, u in used.items())
        for s, u in used.items():
            left[s] -= u * times
        sizes = [s for s in sizes if left[s]]
        out.append((tuple(fill), times))
    return out


def completions(room: int, left: dict[int, int], sizes: list[int], limit: int) -> list[tuple[int, ...]]:
    """Up to `limit` fillings of `room`, of any number of lengths, least waste first, undominated ones only.

    Which sums can be reached by the lengths up to each size is known from bit sets, so the enumeration meets
    no dead ends. A filling is dominated if another length would still fit, if one of its lengths could be replaced by
    a larger one, or two of them by a single one of their sum; of one sum, fillings with the largest lengths come first.
    """
    sizes = [s for s in sizes[: bisect_right(sizes, room)] if left[s] > 0]
    mask = (2 << room) - 1
    reach = [1]  # reach[i]: the sums of the i smallest sizes
    for s in sizes:
        sums, most, step = reach[-1], min(left[s], room // s), 1
        while most:
            step = min(step, most)
            sums |= sums << s * step & mask
            most -= step
            step *= 2
        reach.append(sums)
    out: list[tuple[int, ...]] = []

    def dominated(fill: dict[int, int], waste: int) -> bool:
        if any(left[s] > fill.get(s, 0) for s in sizes[: bisect_right(sizes, waste)]):
            return True
        own = list(fill)
        for a in own:
            if any(left[s] > fill.get(s, 0) for s in sizes[bisect_right(sizes, a) : bisect_right(sizes, a + waste)]):
                return True
        for i, a in enumerate(own):
            for b in own[i:]:
                if (a != b or fill[a] > 1) and left.get(a + b, 0) > fill.get(a + b, 0):
                    return True
        return False

    def fillings(total: int):
        """Fillings of this sum, by depth first from the largest length."""
        stack = [(total, len(sizes), ())]
        while stack:
            rest, i, chosen = stack.pop()
            if not rest:
                yield dict(chosen)
                continue
            more = []
            i = min(i, bisect_right(sizes, rest))
            while i and reach[i] >> rest & 1:  # the i smallest sizes suffice; the largest used of them is sizes[i - 1] or less
                s = sizes[i - 1]
                more += [(rest - s * n, i - 1, (*chosen, (s, n))) for n in range(min(left[s], rest // s), 0, -1) if reach[i - 1] >> rest - s * n & 1]
                if len(more) > 4 * limit:
                    break
                i -= 1
            stack += reversed(more)

    tried = 0
    for total in range(room, -1, -1):
        if not reach[-1] >> total & 1:
            continue
        first = True
        for fill in fillings(total):
            tried += 1
            if first and not out or not dominated(fill, room - total):
                out.append(tuple(s for s, n in fill.items() for _ in range(n)))
            first = False
            if len(out) >= limit or tried >= 16 * limit:
                return out
    return out


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = 4000) -> list[tuple[tuple[int, ...], int]]:
    """Fewest bins found for the histogram: [(lengths, times)]. The least possible is ceil(total / capacity).

    The search follows the least wasteful filling of each bin and, round by round, departs from it in one more
    place (or by one place further down the order); it ends at the least possible number of bins, when nothing is
    left to try or after `node_limit` fillings, but not before it has packed everything once.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(s * c for s, c in counts.items())
    bound = -(-total // capacity)
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(t for _, t in best)
    nodes, cut = 0, False

    def search(left: dict[int, int], plan: list, bins: int, waste: int, depart: int) -> None:
        nonlocal best, best_bins, nodes, cut
        while True:
            nodes += 1
            sizes = sorted(s for s, c in left.items() if c)
            if not sizes:
                if bins < best_bins:
                    best, best_bins = list(plan), bins
                return
            # waste bound: what is wasted already can't be won back
            if -(-(total + waste) // capacity) >= best_bins or best_bins == bound:
                return
            top = sizes[-1]
            left[top] -= 1
            options = completions(capacity - top, left, sizes, depart + 2)
            left[top] += 1
            cut |= len(options) > depart + 1
            for k, other in enumerate(options[1 : depart + 1], 1):
                if best_bins == bound or nodes >= node_limit:
                    break
                again = dict(left)
                more, times, lost = use(again, (top, *other))
                search(again, [*plan, more], bins + times, waste + lost, depart - k)
            if nodes >= node_limit and depart < most:
                return
            chosen, times, lost = use(left, (top, *options[0]))
            plan = [*plan, chosen]
            bins, waste = bins + times, waste + lost

    def use(left: dict[int, int], fill: tuple[int, ...]):
        need: dict[int, int] = {}
        for s in fill:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        return (fill, times), times, times * (capacity - sum(fill))

    most = 0
    while True:
        cut = False
        search(dict(counts), [], 0, 0, most)
        if best_bins == bound or nodes >= node_limit or not cut:
            return best
        most += 1


class Slots:
    """Where the piece of a length and rank goes: sequence and offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list] = {}
        first = 0
        for fill, times in plan:
            at = 0
            for s in fill:
                rows.setdefault(s, []).append((times, first, at))
                at += s
            first += times
        self.table = {}
        for s, slots in rows.items():
            times, begin, at = (np.array(c, np.int64) for c in zip(*slots))
            self.table[s] = (np.concatenate([[0], np.cumsum(times)[:-1]]), begin, at)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            own = np.flatnonzero(length == s)
            start, begin, at = self.table[int(s)]
            k = np.searchsorted(start, rank[own], side="right") - 1
            sequence[own] = begin[k] + rank[own] - start[k]
            offset[own] = at[k]
        return sequence, offset


_ENCODINGS: dict = {}


def _encoding(path: str):
    """The vocabulary as tiktoken's encoding, which gives the tokenizers library's ids some ten times faster."""
    if path not in _ENCODINGS:
        import json

        import tiktoken

        from .bpe import byte_alphabet

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
    return _ENCODINGS[path]


def _ids(text: str, path: str) -> np.ndarray:
    if len(text) >= 100_000 and BLANKS.search(text):
        return load(path).encode(text)
    return _encoding(path).encode_to_numpy(text, allowed_special="all")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `capacity`; only the first may be shorter."""
    path = path or default_vocabulary()

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(np.asarray(_ids(text or "", path), "<u4"), np.array([END], "<u4"))
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, block_rows: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for docs (doc_id, text; others ignored).

    A null or empty text is one piece, the end id. Repeated rows are packed once each. Texts of any length, of white
    space only too, are cut whole. Sequences hold at most `capacity` tokens and are gapless from offset 0. Empty in,
    empty out. The histogram (`capacity` counts at most) is all that reaches the driver; a length is ranked in blocks of
    about `block_rows` rows. Numbers of sequences are arbitrary; full pieces have negative ones.
    """
    cut = materialise(pieces(docs, capacity, path), "pieces", scan=True)
    # a full piece fills a sequence, so it needs no rank; any unused number does, and these are negative
    whole = cut.filter(F.col("length") == capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cut = cut.filter(F.col("length") < capacity)
    histogram = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}
    slots = Slots(pack_histogram(histogram, capacity))
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    blocks = [-(-histogram.get(s, 0) // block_rows) or 1 for s in range(capacity)]
    cut = cut.withColumn("block", F.expr(f"CAST(pmod(xxhash64(doc_id, piece, ids_crc32), element_at(CAST(split('{','.join(map(str, blocks))}', ',') AS ARRAY<INT>), CAST(length AS INT) + 1)) AS INT)"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(first, ["length", "block"]).select(*order, (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches):
        for batch in batches:
            sequence, offset = slots.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array(sequence), pa.array(offset)], names=[*order, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long").unionByName(whole)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
