"""Language identification, words first.

A known word scores its log frequency in every language. A word that is not known falls back to
its character n-grams, longest first: the first length of ``GRAMS`` at which any of its n-grams
is known gives the mean of their log frequencies; if none is known, the word says nothing. A
text's language is the one with the largest sum over its words; the score is the share that
language takes in a softmax of the sums, damped to ``DAMPING`` per word.

Words are runs of letters, lower-cased. Counts come from all learning documents, summed by Spark
after counting inside each task. A word (or n-gram) is known if it makes up at least
``MIN_SHARE`` of the words (or n-grams of its length) of a language, which at most
``1 / MIN_SHARE`` of them can; so the broadcast table has a fixed bound at every size of the
corpus, and no word is dropped by a rank or a row limit. Counts of a word below that share in one
language still count there once it is known by another.

Null texts and texts without a letter give ``und`` with score 0. A null language is not learned
from. Without any learning rows every text is ``und``. Texts of any length are read whole; ties
go to the language first in order; repeated rows are scored alike; an empty table gives none.
Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import LETTERS, map_batches, slices
from riskframe.session import checkpointed

GRAMS = (5, 4, 3, 2, 1)
MIN_SHARE = 1e-5
DAMPING = 0.25
FLUSH = 300_000
MEMORY_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def letters_of(word: str) -> str:
    """The letters alone: numerals such as a superscript two are no letters."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(rows: DataFrame, names: str, of: str) -> DataFrame:
    """Sum ``(lang, key, n)`` rows that each task counts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            # Words are read as ``predict`` reads them; keys that become one are added up by Spark.
            plain = letters_of if of == "texts" else str
            rows = [(lang, key, v) for lang, c in counts.items() for k, v in c.items() if (key := plain(k))]
            langs, keys, values = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(values, pa.int64())],
                names=["lang", "key", "n"],
            )

        for batch in slices(batches, names):
            langs, texts = batch.column("lang").to_pylist(), batch.column(names).to_pylist()
            if of == "texts":
                for lang, text in zip(langs, texts, strict=True):
                    counts.setdefault(lang, Counter()).update(words_of(text))
            else:
                for lang, word, n in zip(langs, texts, batch.column("n").to_pylist(), strict=True):
                    c = counts.setdefault(lang, Counter())
                    for k in GRAMS:
                        for g in grams_of(word, k):
                            c[g] += n
            size = sum(map(len, counts.values()))
            if size > FLUSH:
                yield out()
                counts.clear()
        yield out()

    counted = rows.mapInArrow(run, "lang string, key string, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _known(counts: DataFrame, family: Column, share: float) -> DataFrame:
    """``(family, key, langs, ns)`` of the keys with the share in any language; all their counts."""
    counts = counts.withColumn("family", family)
    totals = counts.groupBy("lang", "family").agg(F.sum("n").alias("total"))
    marked = counts.join(F.broadcast(totals), ["lang", "family"]).withColumn("known", F.col("n") >= share * F.col("total"))
    return (
        marked.groupBy("family", "key")
        .agg(F.collect_list(F.struct("lang", "n")).alias("counts"), F.max("known").alias("known"))
        .where("known")
    )


@dataclass
class Model:
    """Rows of log frequencies: of words (family 0) and of n-grams (family = length)."""

    langs: list[str]
    row: dict[tuple[int, str], int]
    table: np.ndarray  # rows x languages; an extra last row of zeros says nothing

    @cached_property
    def families(self) -> tuple[dict[str, int], dict[str, int]]:
        """Rows by word and by n-gram, whose length tells its family."""
        words = {k: i for (f, k), i in self.row.items() if f == 0}
        return words, {k: i for (f, k), i in self.row.items() if f}

    def rows_of(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """The rows whose mean is the vector of a word, word after word, and how many each has."""
        known, grams = self.families
        rows, sizes = [], np.ones(len(words), np.int64)
        for i, word in enumerate(words):
            at = known.get(word)
            if at is not None:
                rows.append(at)
                continue
            for n in GRAMS:
                found = [at for g in grams_of(word, n) if (at := grams.get(g)) is not None]
                if found:
                    rows += found
                    sizes[i] = len(found)
                    break
            else:
                rows.append(len(self.table) - 1)
        return rows, sizes

    def vectors(self, words: list[str]) -> np.ndarray:
        """One row per word; the means of as many rows are taken at once."""
        rows, sizes = self.rows_of(words)
        rows, starts = np.array(rows, np.int64), np.cumsum(sizes) - sizes
        out = np.zeros((len(words), self.table.shape[1]), self.table.dtype)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            out[at] = self.table[rows[starts[at][:, None] + np.arange(n)]].mean(1)
        return out

    def vector(self, word: str) -> np.ndarray:
        return self.vectors([word])[0]


def learn(docs: DataFrame, eligible: Column | None = None, share: float = MIN_SHARE) -> Model:
    """Learn from the text and lang of ``docs``, of those rows that satisfy ``eligible``."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = (rows if eligible is None else rows.where(eligible)).select("lang", "text")
    raw = _count(rows, "text", "texts")
    words = checkpointed(raw)
    grams = _count(words.select("lang", "key", "n"), "key", "words")
    known = _known(words, F.lit(0), share).unionByName(_known(grams, F.length("key"), share)).toArrow()
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((known.num_rows + 1, max(1, len(langs))))
    family = np.array(known["family"].to_pylist(), np.int64)
    for i, pairs in enumerate(known["counts"].to_pylist()):
        for p in pairs:
            counts[i, at[p["lang"]]] = p["n"]
    table = np.zeros_like(counts, np.float32)
    for f in set(family.tolist()):
        part = np.flatnonzero(family == f)
        # Add-half smoothing; the totals are those of the known keys of the family.
        table[part] = np.log10((counts[part] + 0.5) / (counts[part].sum(0) + 0.5 * len(part)))
    row = {(f, k): i for i, (f, k) in enumerate(zip(family.tolist(), known["key"].to_pylist(), strict=True))}
    return Model(langs, row, table)


class Scorer:
    """Scores texts in one worker; vectors of words are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.width = max(1, len(model.langs))
        self.at: dict[str, int] = {}
        # Vectors by place; grown by doubling. NaN for a word without letters.
        self.table = np.zeros((1024, self.width))

    def remember(self, words: set[str]) -> None:
        if len(self.at) + len(words) > len(self.table):
            grown = np.zeros((2 * (len(self.at) + len(words)), self.width))
            grown[: len(self.at)] = self.table[: len(self.at)]
            self.table = grown
        new, letters = list(words), list(map(letters_of, words))
        first = len(self.at)
        vectors = self.model.vectors(letters).astype(float)
        vectors[[not w for w in letters]] = np.nan
        self.table[first : first + len(new)] = vectors
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums per text and language, and how many words each text has."""
        if len(self.at) > MEMORY_WORDS:
            self.at = {}
        words = [words_of(t) for t in texts]
        self.remember(set().union(*words).difference(self.at))
        table = self.table
        sums, sizes = np.zeros((len(texts), self.width)), np.zeros(len(texts), np.int64)
        for i, w in enumerate(words):
            if w:
                v = table[np.fromiter(map(self.at.__getitem__, w), np.int64, len(w))]
                letters = ~np.isnan(v[:, 0])
                sizes[i] = letters.sum()
                sums[i] = v[letters].sum(0)
        return sums, sizes


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score, n_words)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Scorer(shared.value))
        model = shared.value
        sums, sizes = held[0].sums(batch.column("text").to_pylist())
        best = sums.argmax(1)
        power = np.exp(DAMPING * np.log(10) * (sums - sums.max(1, keepdims=True)))
        known = (sizes > 0) & bool(model.langs)
        return {
            "key": batch.column("key"),
            "lang_pred": [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)],
            "score": np.where(known, 1 / power.sum(1), 0.0),
            "n_words": sizes,
        }

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, f"key {kind}, lang_pred string, score double, n_words long").withColumnRenamed("key", key)
