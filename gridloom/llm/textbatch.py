"""Vectorised text kernels on Arrow string buffers (numpy only, no Spark).

All functions work on the UTF-8 bytes of a batch of documents laid end to end, so the cost per
byte is a handful of numpy passes and no Python object is made for a word or a window.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a batch; one longer document is handled alone.
CHUNK_BYTES = 3 << 16

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SECRET = _RNG.bytes(32)
_KEYS = _RNG.integers(0, 2**64, 8, dtype=np.uint64)


def digests(parts) -> np.ndarray:
    """Keyed 64-bit digest of each bytes-like object: equal digests mean equal bytes, also for texts made to collide."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8, key=_SECRET).digest() for x in parts]), "<u8")


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, np.uint64(base % 2**64))
        down = np.full(size, np.uint64(pow(base, -1, 2**64)))
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= CHUNK_BYTES + 1:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray):
    """Ranges (i, j) of documents holding about CHUNK_BYTES of text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch: start, end (bytes), doc index and 64-bit hash of each.

    `first` holds, for document i, the index of its first word; words of i are first[i]:first[i+1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        ink = np.zeros(n + 1, bool)
        ink[:n] = ~_SPACE[data]
        before = np.zeros(n + 1, bool)
        before[1:] = ink[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.zeros(n + 1, bool)
        after[: n - 1 if n else 0] = ink[1:n]
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = False
        if n:
            after[n - 1] = False
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64 bits a word: a permutation of the bytes and length of words up to 7 bytes, so these never collide; sums of
        differently keyed permutations of 7 bytes each up to 56 bytes; the keyed digest of longer words."""
        size = self.end - self.start
        lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
        out = np.zeros(len(size), np.uint64)
        rows, left = np.arange(len(size)), size
        for k, key in enumerate(_KEYS):
            few = np.minimum(left, 7).astype(np.uint64)
            lane = lanes[self.start[rows] + 7 * k].view("<u8").ravel()
            out[rows] += mix((lane & ((np.uint64(1) << few * np.uint64(8)) - np.uint64(1)) | few << np.uint64(56)) ^ key)
            rows = rows[left > 7]
            if not len(rows):
                return out
            left = size[rows] - 7 * (k + 1)
        raw = self.data
        out[rows] = digests(raw[i:j].tobytes() for i, j in zip(self.start[rows].tolist(), self.end[rows].tolist()))
        return out

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes with one space between words of a document, where each word begins there)."""
        space = _SPACE[self.data]
        keep = ~space
        keep[1:] |= keep[:-1].copy()
        place = np.cumsum(keep)[self.start] - 1 if len(self.start) else self.start
        text = self.data[keep]
        text[_SPACE[text]] = 0x20
        return text, place


def ngram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n consecutive 64-bit symbols; len(symbols) - n + 1 of them."""
    m = len(symbols)
    if m < n:
        return np.zeros(0, np.uint64)
    if m > CHUNK_BYTES + n:  # long texts piece by piece
        return np.concatenate([ngram_hashes(symbols[i : i + CHUNK_BYTES + n - 1], n) for i in range(0, m - n + 1, CHUNK_BYTES)])
    up, down = _powers(_WORD_BASE, m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(symbols * up[:m], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: m - n + 1])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def window_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in each window of `width` values.

    Only the upper 52 bits of `order` are compared. Blocks of `width` are reduced from both sides,
    so a window needs two look-ups whatever its width (at most 4096).
    """
    assert 1 <= width <= 4096
    n = len(order)
    if n < width:
        return np.zeros(0, np.int64)
    blocks = -(-n // width) + 1
    value = np.full(blocks * width, np.uint64(2**64 - 1))
    value[:n] = order
    low = np.uint64(0xFFF)
    value = (value & ~low).reshape(blocks, width) | np.arange(width, dtype=np.uint64)
    left = np.minimum.accumulate(value, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1]).ravel()
    at = np.arange(n - width + 1)
    here, there = right[at], left[at + width - 1]
    block = at // width
    first = (here >> np.uint64(12)) <= (there >> np.uint64(12))
    # at a block's start both look-ups see the same block
    pick = np.where(first, block * width + (here & low).astype(np.int64), (at + width - 1) // width * width + (there & low).astype(np.int64))
    return pick


def runs(order: np.ndarray, grams: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of windows that share their anchor.

    A window is `window` consecutive symbols of one document (document i owns symbols
    first[i]:first[i+1]); its anchor is the gram (`gram` symbols) of least order inside it, leftmost on
    ties, so equal windows have equal anchors at equal places. Returns doc, s, e, a: windows starting
    at s..e of document doc have their anchor at a.
    """
    none = np.zeros(0, np.int64)
    at = window_argmin(order, window - gram + 1)
    size = np.diff(first)
    count = np.maximum(size - window + 1, 0)
    total = int(count.sum())
    if not total:
        return none, none, none, none
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    anchor = at[start]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], total) - 1
    return doc[begin], start[begin], start[stop], anchor[begin]
