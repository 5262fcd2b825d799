"""Language identification by words first, then by progressively shorter character n-grams.

A word that the model knows is scored by its log frequency in each language; an unseen word by the longest
character n-grams (4, 3, 2, then 1, with word boundaries) of which the model knows any. The model holds all words and
n-grams that occur `least` times in a bounded sample of labelled rows (`max_train_docs`, by a hash of doc_id), so
its size does not grow with the corpus and it may be sent to every task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, sampled, small_batches

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    word = f"^{word}$" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _count(batches):
    """(lang, kind, item, n): kind 0 for words, else the order of the n-gram."""
    total: dict[str, Counter] = {}

    def rows():
        out = [(lang, *item, n) for lang, words in total.items() for item, n in _expand(words).items()]
        columns = list(zip(*out)) if out else [[]] * 4
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, total.values())) > 200_000:
            yield rows()
    yield rows()


def _expand(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        out[(0, word)] += n
        for order in ORDERS:
            for g in grams(word, order):
                out[(order, g)] += n
    return out


class Model:
    """Log probabilities: row index[kind][item] of `table`, a column a language."""

    def __init__(self, langs: list[str], prior: np.ndarray, index: dict[int, dict[str, int]], table: np.ndarray):
        self.langs, self.prior, self.index, self.table = langs, prior, index, table
        self._forget()

    def _forget(self) -> None:
        self._seen = dict(self.index[0])
        self._rows = np.concatenate([self.table, np.zeros((1024, len(self.langs)))])
        self._n = len(self.table)

    def __getstate__(self):
        return self.langs, self.prior, self.index, self.table

    def __setstate__(self, state):
        self.__init__(*state)

    def _unseen(self, word: str) -> int:
        """Row of a word outside the model, from its longest known n-grams; kept for the next time."""
        row = np.zeros(len(self.langs))
        for order in ORDERS:
            known = [i for i in map(self.index[order].get, grams(word, order)) if i is not None]
            if known:
                row = self.table[known].mean(axis=0)
                break
        if self._n == len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros((len(self._rows), len(self.langs)))])
        self._rows[self._n] = row
        self._seen[word] = self._n
        self._n += 1
        return self._n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if self._n > len(self.table) + 400_000:
            self._forget()
        rows = list(map(self._seen.get, words))
        if None in rows:
            for at, i in enumerate(rows):
                if i is None:
                    word = words[at]
                    rows[at] = self._seen[word] if word in self._seen else self._unseen(word)
        score = self.prior + self._rows[rows].sum(axis=0)
        e = np.exp(score - score.max())
        best = int(np.argmax(e))
        return self.langs[best], float(e[best] / e.sum())


def train(labelled: DataFrame, max_train_docs: int = 2_000, least: int = 2) -> Model:
    """Fit on rows (doc_id, text, lang); rows without text or lang are left out, rows without doc_id used.

    At most about max_train_docs rows are used, those with the smallest hash of doc_id, so the choice does
    not depend on how the table is partitioned; items seen fewer than `least` times in them are left out.
    """
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    usable = sampled(usable, labelled.filter("lang IS NOT NULL").select("lang").count(), max_train_docs)
    counts = usable.select("lang", "text").mapInArrow(_count, "lang string, kind int, item string, n long")
    counts = materialise(counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "counts", light=True)
    items = counts.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    totals = {(r["kind"], r["lang"]): (r["n"], r["v"]) for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    known = items.filter(F.col("total") >= least).select("kind", "item", "by").toArrow().sort_by([("kind", "ascending"), ("item", "ascending")])
    langs = sorted({lang for _, lang in totals})
    at = {lang: i for i, lang in enumerate(langs)}
    index: dict[int, dict[str, int]] = {k: {} for k in (0, *ORDERS)}
    kinds, by = known.column("kind").to_numpy(), known.column("by").combine_chunks()
    table = np.zeros((len(kinds), len(langs)))
    row = np.repeat(np.arange(len(kinds)), by.value_lengths().to_numpy(zero_copy_only=False))
    table[row, np.array([at[lang] for lang in by.flatten().field("lang").to_pylist()], np.int64)] = by.flatten().field("n").to_numpy()
    size = np.ones((max(ORDERS) + 1, len(langs)))
    for (kind, lang), (n, _) in totals.items():
        size[kind, at[lang]] += n
    table = np.log((table + 0.5) / size[kinds])
    for i, (kind, item) in enumerate(zip(kinds.tolist(), known.column("item").to_pylist(), strict=True)):
        index[kind][item] = i
    docs = np.array([totals.get((0, lang), (0, 0))[0] + 1.0 for lang in langs])
    return Model(langs, np.log(docs / docs.sum()) if len(langs) else docs, index, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text; other columns are ignored).

    The whole text is used. `und` with score 0 if the text is null, empty or has no letter, or if the model
    was trained on nothing. Ties go to the language first by name. Empty in, empty out.
    """

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.expr("pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5)")
    model = train(docs.filter(fold != 0))
    return identify(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
