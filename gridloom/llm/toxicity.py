"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lowers case, maps homoglyphs (Cyrillic, Greek, full-width and accent-free look-alikes) and digit
substitutions to Latin letters and turns punctuation into spaces. The lexicon's entries are whole words and
word beginnings, weighted by smoothed log odds of the labelled documents that hold them. A match inside an
exception phrase counts for nothing. The sum of weights is normalised by the logarithm of the length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, sampled, small_batches
from .textbatch import Words, mix, ngram_hashes, utf8

#: Look-alike letters and the Latin letters they stand for, in pairs of equal length.
LOOK_ALIKE = "аеорсухіјѕԁһӏɡαοενικρτυх"
LATIN = "aeopcyxijsdhlgaoevikptux"
#: Digits and signs used for letters.
SUBSTITUTE = "013457@$!"
LETTER = "oieastasi"
_FOLD = {ord(a): b for a, b in zip(LOOK_ALIKE, LATIN, strict=True)}
_FOLD |= {ord(a): b for a, b in zip(SUBSTITUTE, LETTER, strict=True)}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOLD |= {c: " " for c in (9, 10, 11, 12, 13)}
_FOLD |= {ord(c): " " for c in "\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’–—…¡¿"}
#: A sign at the end of a word is punctuation, not a letter.
_CLOSING = re.compile(r"(?<=\w)[!@$]+(?!\w)|(?<!\w)[!@$]+")
BEGINNINGS = range(4, 9)
#: See `train`; best of 48 settings by F1 in three-fold cross-validation on the training fold of sf0.1.
SHARE, CHANCE, ODDS = 0.0, 1e-6, 50.0


def fold(text: str | None) -> str:
    if not text:
        return "  "
    if "!" in text or "@" in text or "$" in text:
        text = _CLOSING.sub(" ", text)
    return f" {text.lower().translate(_FOLD)} "


def features(words) -> set[str]:
    """' word ' for each word, ' beginning' for its beginnings of 4 to 8 letters."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if n <= len(w))
    return out


class Lexicon:
    """weights: entry -> weight; exceptions: phrases (' two words ') inside which entries don't count."""

    def __init__(self, weights: dict[str, float], exceptions: set[str]):
        self.weights, self.exceptions, self._automaton = weights, exceptions, None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            a.make_automaton()
            self._automaton = a
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self._automaton.iter(folded):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        if not best:
            return 0.0
        return 1.0 - math.exp(-sum(best.values()) / (1.0 + 0.1 * math.log1p(folded.count(" "))))


def _sketch(batches):
    """Adds four smallest shingle hashes, by which near copies are told."""
    for batch in batches:
        words = Words(*utf8(batch.column("text")), lower=True)
        low = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64)[:, None], 4, axis=1)
        h = ngram_hashes(words.hashes(), 5)
        for i in range(batch.num_rows):
            own = h[words.first[i] : max(words.first[i], words.first[i + 1] - 4)]
            if len(own):
                low[i] = [mix(own + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min() for k in range(1, 5)]
        arrays = [batch.column(c) for c in ("doc_id", "text", "toxic")] + [pa.array(low[:, k].view(np.int64) if low.flags.f_contiguous else np.ascontiguousarray(low[:, k]).view(np.int64)) for k in range(4)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "toxic", "m0", "m1", "m2", "m3"])


def _without_copies(sample: DataFrame) -> DataFrame:
    """One document of those that share a smallest shingle hash, so that copies don't count as evidence."""
    sample = sample.mapInArrow(_sketch, "doc_id long, text string, toxic int, m0 long, m1 long, m2 long, m3 long")
    for k in range(4):
        sample = sample.groupBy(f"m{k}").agg(F.min_by(F.struct("doc_id", "text", "toxic", "m0", "m1", "m2", "m3"), "doc_id").alias("r")).select("r.*")
    return sample.select("text", "toxic")


def _tally(keep=None, phrases_of=None, spared=frozenset(), most: int = 100_000):
    """Documents of each label with an item: features, of `keep` only and outside `spared` phrases; or phrases of
    two words one of which has a feature of `phrases_of`. Counts leave in parts of about `most` items."""

    def out(total):
        rows = [(item, n if y else 0, 0 if y else n) for y, c in total.items() for item, n in c.items()]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["item", "bad", "good"])

    def run(batches):
        total = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                if phrases_of is not None:
                    hot = {w for w in set(words) if not phrases_of.isdisjoint(features((w,)))}
                    found = {f" {a} {b} " for a, b in zip(words, words[1:]) if a in hot or b in hot}
                else:
                    if spared:
                        inside = {j for i, (a, b) in enumerate(zip(words, words[1:])) if f" {a} {b} " in spared for j in (i, i + 1)}
                        words = [w for i, w in enumerate(words) if i not in inside]
                    found = features(set(words))
                    if keep is not None:
                        found &= keep
                total[int(toxic)].update(found)
                if len(total[0]) + len(total[1]) > most:
                    yield out(total)
                    total = {0: Counter(), 1: Counter()}
        yield out(total)

    return run


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, least: int = 4, share: float = SHARE, chance: float = CHANCE, odds: float = ODDS, extra_exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from docs (doc_id, text) with labels (doc_id, toxic 0/1; null is left out).

    A bounded sample (about max_train_docs labelled documents, by a hash of doc_id) is used, so its identifiers may
    be broadcast, and what is learnt is bounded by it. A document with several labels is toxic if one says so. Near
    copies are counted once. Exceptions come first: phrases of two words around a feature
    that toxic documents have too, but never in the phrase, which clean ones use so often that mere chance would
    do it with probability `chance`. Uses inside them count no more. An entry is then in at least `least` toxic
    documents and a `share` of them, `odds` times likelier there than in clean ones, and so unevenly that mere
    chance would do it with probability `chance`; of nested entries the shorter wins if it is as good.
    """
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = sampled(labels, labels.count(), max_train_docs)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "toxic")
    sample = materialise(_without_copies(sample), "toxicity")
    size = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    rate = (bad + 1) / (bad + good + 2)
    least = max(least, math.ceil(share * bad), math.ceil(math.log(chance) / math.log(rate)))

    def tally(rows: DataFrame, **how) -> DataFrame:
        return rows.mapInArrow(_tally(**how), "item string, bad long, good long").groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    more = f"(bad + 0.05) / {bad + 1} > {{}} * (good + 0.05) / {good + 1}"
    rare = f"bad * ln(bad / ((bad + good) * {rate})) + if(good = 0, 0, good * ln(good / ((bad + good) * {1 - rate}))) >= {-math.log(chance) - 1e-9}"
    likely = tally(sample.filter("toxic = 1")).filter(F.col("bad") >= least)
    likely = [r["item"] for r in likely.select("item").collect()]
    if not likely:
        return Lexicon({}, set(extra_exceptions))
    counts = tally(sample, keep=frozenset(likely)).filter(more.format(1.0))
    uses = {r["item"]: (r["bad"], r["good"]) for r in counts.collect()}
    # a phrase's clean uses by chance alone: each is clean with the share of the feature's documents that are
    enough = {f: math.log(chance) / math.log(g / (b + g)) for f, (b, g) in uses.items() if g}
    enough = {f: n for f, n in enough.items() if n <= uses[f][1]}
    spared: set[str] = set()
    if enough:
        phrases = tally(sample, phrases_of=frozenset(enough)).filter(F.expr(f"bad = 0 AND good >= {min(enough.values())}"))
        for r in phrases.collect():
            if r["good"] >= min(enough.get(f, math.inf) for f in features(r["item"].split())):
                spared.add(r["item"])
    counts = tally(sample, keep=frozenset(uses), spared=frozenset(spared)).filter(F.col("bad") >= least).filter(more.format(odds)).filter(rare)
    rows = {r["item"]: (r["bad"], r["good"]) for r in counts.collect()}
    weights: dict[str, float] = {}
    for item, (b, g) in sorted(rows.items(), key=lambda x: (len(x[0]), x[0])):
        weight = math.log((b + 0.05) / (bad + 1)) - math.log((g + 0.05) / (good + 1))
        word = item.rstrip(" ")
        shorter = max((weights.get(word[:k], 0.0) for k in range(BEGINNINGS.start + 1, len(word) + 1)), default=0.0)
        if weight > shorter + 1e-9:
            weights[item] = min(weight, 8.0)
    return Lexicon(weights, spared | {f" {p.strip()} " for p in extra_exceptions})


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) for each row of docs (doc_id, text; other columns are ignored).

    Null, empty and unmatched texts score 0. The whole text is read. Empty in, empty out.
    """

    def run(batches):
        for batch in batches:
            found = [lexicon.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, all columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [lexicon.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(F.expr("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) != 1"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = train(docs, train_rows(labels))
    held = F.expr("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) = 1")
    return score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
