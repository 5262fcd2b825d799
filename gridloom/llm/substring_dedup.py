"""Substring dedup: words covered by a 13-word window that also starts in an earlier document are removed.

Reference shards are suffix automata over words. A reference that is the whole corpus has no proven
size bound, so a shard is not broadcast: names (see repeats.py) are dealt to shards by anchor, which
all equal windows share, and each shard's automaton lives in one task. Documents' runs are streamed
through it for matching statistics: wherever the longest match reaches 13 words, the state that holds
the 13-word suffix knows the smallest document in which it starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Parsed, Repeats, Verdicts, parts_of
from .shared import small_batches
from .textbatch import Words, ngram_hashes

WINDOW = 13
GRAM = 3


class SuffixAutomaton:
    """Suffix automaton of several words sequences; a state keeps the smallest document it ends in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.low: list[int] = [2**63 - 1]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.low.append(2**63 - 1)
        return len(self.link) - 1

    def _clone(self, p: int, word, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words, doc: int) -> None:
        last, nexts, length, link = 0, self.next, self.length, self.link
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # the prefix is known already
                last = q if length[q] == length[last] + 1 else self._clone(last, word, q)
            else:
                cur, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = cur
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
                last = cur
            if doc < self.low[last]:
                self.low[last] = doc

    def close(self) -> None:
        """Hand each state's smallest document to the states of its suffixes."""
        low, link = self.low, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if p > 0 and low[v] < low[p]:
                low[p] = low[v]

    def statistics(self, words):
        """(length of the longest match ending at each word, its state)."""
        v = n = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if word in self.next[v]:
                v = self.next[v][word]
                n += 1
            yield n, v

    def earliest(self, words, window: int) -> list[int]:
        """Smallest document of each window of `window` words; 2**63 - 1 if it occurs in none."""
        out = []
        for i, (n, v) in enumerate(self.statistics(words)):
            if i >= window - 1:
                if n >= window:
                    while self.length[self.link[v]] >= window:
                        v = self.link[v]
                    out.append(self.low[v])
                else:
                    out.append(2**63 - 1)
        return out


class WordRepeats(Repeats):
    def parse(self, data, offsets):
        words = Words(data, offsets)
        symbols = words.hashes()
        grams = ngram_hashes(symbols, self.gram)
        order = grams >> np.uint64(2)
        if len(grams):  # short words are common ones: prefer anchors without them
            short = (words.end - words.start <= 4).astype(np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(short)])
            order |= np.minimum(total[self.gram :] - total[: -self.gram], np.uint64(3)) << np.uint64(62)
        text, place = words.spaced()
        return Parsed(words.first, words.start, words.end, grams, order, text, place, place + words.end - words.start)

    def windows_of(self, text):
        words = text.split()
        return [b" ".join(words[i : i + self.window]) for i in range(len(words) - self.window + 1)]

    def shard(self, names: pa.Table) -> list[bytes]:
        texts = [t.split() for t in names.column("text").to_pylist()]
        known: dict[bytes, int] = {}
        coded = [[known.setdefault(w, len(known)) for w in t] for t in texts]
        automaton = SuffixAutomaton()
        for words, doc in zip(coded, names.column("doc").to_pylist(), strict=True):
            automaton.add(words, doc)
        automaton.close()
        return [np.array(automaton.earliest(words, self.window), "<i8").tobytes() for words in coded]

    def pack(self, v):
        # little-endian 64-bit integers
        word = F.transform(v, lambda e: F.lpad(F.hex(e["doc"]), 16, "0"))
        flip = F.transform(word, lambda h: F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))
        return F.unhex(F.concat_ws("", flip))


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept string"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
DIGEST_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(digest: bool):
    def finish(self: WordRepeats, docs: pa.Table, right: pa.Table) -> pa.Table:
        found, rows = Verdicts(right), []
        valid = np.asarray(found.verdict.is_valid()) if len(found.code) else np.zeros(0, bool)
        for ids, part, off in self.pieces(docs):
            words = Words(part, off)
            edge = np.zeros(len(words.start) + 1, np.int64)
            runs = self.runs_of(part, off)
            s, e, own, row = runs.s, runs.e, ids[runs.doc], found.find(runs)
            hit = np.flatnonzero(row >= 0)
            if len(hit):
                whole = hit[~valid[row[hit]]]
                whole = whole[found.doc[row[whole]] < own[whole]]
                np.add.at(edge, s[whole], 1)
                np.add.at(edge, e[whole] + self.window, -1)
                for r in hit[valid[row[hit]]]:
                    low = np.frombuffer(found.verdict[int(row[r])].as_py(), "<i8")
                    at = s[r] + np.flatnonzero(low < own[r])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + self.window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            raw, base = part.tobytes(), words.first
            for r in range(len(ids)):
                a, b = base[r], base[r + 1]
                out = gone[a:b]
                tokens = raw[off[r] : off[r + 1]].split()
                if out.any():
                    tokens = [tokens[k] for k in np.flatnonzero(~out)]
                kept = b" ".join(tokens)
                rows.append((int(ids[r]), int(b - a), int(b - a) - len(tokens), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
        schema = DIGEST if digest else OUT
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return finish


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_names: int = 4096, digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Input: doc_id, text; other columns are ignored, so their names
    cannot clash. Result, one row a document: doc_id, n_words, n_removed and `kept` (kept words joined by one
    space), or `kept_sha256` if digest. Null and empty texts have no words; texts under `window` words are kept
    whole. Windows are judged on the input. Of equal texts the one with the smallest doc_id stays whole; rows
    with one doc_id never remove each other. A row without doc_id takes no part and
    returns with nulls. An empty table gives an empty result.
    """
    if not 1 <= gram <= window <= 4096:
        raise ValueError("1 <= gram <= window <= 4096 is needed")
    op = WordRepeats(window=window, gram=gram, by_document=True, parts=parts_of(docs.sparkSession), hot_names=hot_names)
    return op.apply(docs, _finish(digest), DIGEST_DDL if digest else OUT_DDL)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
