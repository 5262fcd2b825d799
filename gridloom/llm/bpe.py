"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding with an offset table.

A pretoken's bytes pass once through an Aho-Corasick automaton of all tokens, which gives the tokens that
start at each place, longest first. The encoder takes the longest that is compatible with the token before
it, shorter ones otherwise, and steps back from places that proved dead, each of which is visited once.
Two neighbours are compatible if no merge inside their join would have come first; the answers are kept
in a pair table. This gives exactly the merges' result in time linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern that splits text into pretokens (a fixed value of the vocabulary).
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for ASCII text, where the standard library's faster expressions can say it; tests hold both against the library.
SPLIT_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
CACHE = 250_000
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (tokenizer JSON with byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        raw: list[bytes] = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for content, i in self.special.items():
            raw[i] = content.encode()
        # tokens numbered by age: single bytes first, then merges in order
        self.id_of = [vocab[c] for c in sorted((c for c in vocab if len(c) == 1), key=alphabet.__getitem__)]
        age = {i: k for k, i in enumerate(self.id_of)}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts = [(k, k) for k in range(len(self.id_of))]
        for a, b in merges:
            i = vocab[a + b]
            if i in age:
                continue
            age[i] = k = len(self.id_of)
            self.id_of.append(i)
            self.parts.append((age[vocab[a]], age[vocab[b]]))
            self.pair[self.parts[k]] = k
        self.size = [len(raw[i]) for i in self.id_of]
        self.automaton = ahocorasick.Automaton()
        for k, i in enumerate(self.id_of):
            self.automaton.add_word(raw[i].decode("latin-1"), k)
        self.automaton.make_automaton()
        # decoding: all tokens' bytes end to end, and where each begins
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._seen: dict[str, tuple[tuple[int, ...], str]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the tokens left, right as they are when they meet."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > 4 * CACHE:
                self._fits.clear()
            known = self._fits[left, right] = self._check(left, right)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's outermost piece on one side (0 left, 1 right) while the merges build it: (piece, until), from
        the single byte to the whole token. A piece is there until the merge numbered `until` takes it."""
        known = self._edges[side].get(token)
        if known is None:
            inner = self.parts[token][side]
            known = [(token, NEVER)]
            if inner != token:
                *before, (last, _) = self._edge(inner, side)
                known = [*before, (last, token), *known]
            self._edges[side][token] = known
        return known

    def _check(self, left: int, right: int) -> bool:
        """Plays the merges of both tokens in the order of their numbers. They stay apart unless, at some time, the two
        pieces that touch form a pair whose merge comes before the next merge on either side; of merges with one number
        the leftmost comes first, so on the right it may also be the same."""
        ends, begins = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], begins[j]
            merge = self.pair.get((a, b), NEVER)
            if merge < a_until and merge <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode_bytes(self, word: bytes) -> list[int]:
        n = len(word)
        starts: list[list[int]] = [[] for _ in range(n)]
        size = self.size
        for end, k in self.automaton.iter(word.decode("latin-1")):
            starts[end + 1 - size[k]].append(k)
        # matches come by end, so each list is shortest first
        dead = bytearray(n + 1)
        tokens: list[int] = []
        choice: list[int] = []
        at, k = 0, len(starts[0]) - 1
        while at < n:
            if k < 0:
                dead[at] = 1
                at -= size[tokens.pop()]
                k = choice.pop() - 1
                continue
            token = starts[at][k]
            end = at + size[token]
            if not dead[end] and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                choice.append(k)
                at = end
                k = len(starts[at]) - 1 if at < n else 0
            else:
                k -= 1
        return [self.id_of[t] for t in tokens]

    def _words(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        words = SPLIT_ASCII.findall(text) if text.isascii() else SPLIT.findall(text)
        seen = self._seen
        found = list(map(seen.get, words))
        if None in found:
            for i, got in enumerate(found):
                if got is None:
                    word = words[i]
                    got = seen.get(word)
                    if got is None:
                        ids = tuple(self.encode_bytes(word.encode()))
                        got = (ids, ",".join(map(str, ids)))
                        if len(seen) > CACHE:
                            seen.clear()
                        if len(word) < 64:
                            seen[word] = got
                    found[i] = got
        return found

    def _pieces(self, text: str):
        for part in self.cut.split(text) if self.cut else [text]:
            special = self.special.get(part)
            if special is not None:
                yield [((special,), str(special))]
            elif part:
                yield self._words(part)

    def encode(self, text: str) -> np.ndarray:
        ids = [w[0] for piece in self._pieces(text) for w in piece]
        return np.fromiter(chain.from_iterable(ids), np.int64)

    def encode_joined(self, text: str) -> tuple[np.ndarray, str]:
        """ids, and the ids in decimal joined by commas."""
        words = [w for piece in self._pieces(text) for w in piece]
        return np.fromiter(chain.from_iterable([w[0] for w in words]), np.int64), ",".join([w[1] for w in words])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        after = np.cumsum(size)
        return self.bytes[np.repeat(begin - after + size, size) + np.arange(after[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs (doc_id, text; other columns are ignored).

    Special tokens' strings in a text become their ids, none is added. Null and empty texts give no ids.
    The vocabulary file must be at `path` on every executor. Empty in, empty out.
    """
    path = path or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # token lists are larger than their text
                part = batch.slice(i, 256)
                ids = [bpe.encode(t or "").astype(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of rows (doc_id, ids); null ids give an empty text, bad UTF-8 U+FFFD."""
    path = path or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            text = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without keeping ids."""
    path = path or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, joined = bpe.encode_joined(text or "")
                back = bpe.decode(ids).encode()
                rows.append((doc, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
