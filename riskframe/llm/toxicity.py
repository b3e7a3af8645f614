"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are 0 (clean), 1 (toxic) and 2 (severely toxic). The labels only say toxic or not, so the
grades of the sample come from its own words: a marker is a word or word start found in at least
``MIN_DOCS`` documents of the sample of which ``MARKER_SHARE`` or more are toxic, and a toxic
document with more distinct marker words than the median toxic document has grade 2.

Features are hashed words and word starts of lower-cased letters (``STARTS`` characters long); a
column's value is the number of a document's distinct words that have it, so a score is a sum over
distinct words. One weight vector serves both thresholds: P(grade >= k) = sigmoid(w.x - t_k) with
t_1 <= t_2. An L1 penalty keeps the many neutral features at exactly zero, which is what leaves
long clean documents alone. The fit takes at most ``FIT_ROWS`` labelled documents; the broadcast
model has ``BUCKETS`` weights.

Null and empty texts have no words and get the severity of the thresholds alone. Texts are read
whole; repeated rows are scored alike; an empty table gives none. Without toxic and clean labels
nothing is toxic. Only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import LETTERS, Sparse, filter_batches, labelled_sample, map_batches, release, sigmoid

FIT_ROWS = 8000
BUCKETS = 1 << 19
STARTS = (4, 5, 6)
MIN_DOCS = 3
MARKER_SHARE = 0.9
#: Toxic from this probability of grade 1 or more (the penalty draws probabilities down).
TOXIC_FROM = 0.2
PENALTY = 0.027
MEMORY_WORDS = 150_000


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def columns_of(word: str) -> list[int]:
    """Hashed columns of one word: the word, and its starts if it is longer."""
    names = [" " + word, *(f"{n} {word[:n]}" for n in STARTS if len(word) > n)]
    return [crc32(n.encode()) % BUCKETS for n in names]


def document_columns(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts: Counter[int] = Counter()
    for word in words_of(text):
        counts.update(columns_of(word))
    return np.array(list(counts), np.int32), np.array(list(counts.values()), np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: tuple[float, ...]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) per row and k = 1, 2, ..."""
        return sigmoid(np.asarray(score)[:, None] - np.array(self.thresholds)[None, :])


CLEAN = Model(np.zeros(BUCKETS, np.float32), (50.0, 50.0))


def grades(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 of a labelled sample; see the module's notes on markers."""
    seen = np.bincount(x.columns, minlength=x.shape[1])
    bad = np.bincount(x.columns[toxic[x.rows] == 1], minlength=x.shape[1])
    marker = (seen >= MIN_DOCS) & (bad >= MARKER_SHARE * seen)
    count = x.dot(marker.astype(np.float64))
    cut = np.median(count[toxic == 1])
    return np.where(toxic == 1, np.where(count > cut, 2, 1), 0)


def fit_ordinal(
    x: Sparse, grade: np.ndarray, levels: int = 3, penalty: float = 3e-4, steps: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds by accelerated proximal gradient steps.

    The loss is the mean of -log P(grade = g), P(g) = s(z - t_g) - s(z - t_(g+1)); each column
    moves by its own step size, the inverse of a bound on its curvature.
    """
    ks = np.arange(1, levels)
    share = np.array([(grade >= k).mean() for k in ks]).clip(1e-4, 1 - 1e-4)
    t = np.log((1 - share) / share)
    w = np.zeros(x.shape[1])
    # Rows of many columns share one step: sum over columns of |x| bounds the row norm.
    norm = np.bincount(x.rows, x.values, x.shape[0])
    curvature = 0.5 * x.back(norm) / x.shape[0] + 1e-3
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        z = x.dot(ahead)
        lower = np.where(grade > 0, sigmoid(z - t[np.maximum(grade - 1, 0)]), 1.0)
        upper = np.where(grade < levels - 1, sigmoid(z - t[np.minimum(grade, levels - 2)]), 0.0)
        p = np.maximum(lower - upper, 1e-9)
        # d(-log p)/dz and d(-log p)/dt
        dl, du = lower * (1 - lower), upper * (1 - upper)
        slope = -(dl - du) / p
        step_w = x.back(slope) / x.shape[0]
        fresh = ahead - step_w / curvature
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - penalty / curvature, 0)
        move = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = fresh + (momentum - 1) / move * (fresh - w), fresh, move
        step_t = np.zeros(levels - 1)
        np.add.at(step_t, np.maximum(grade - 1, 0), np.where(grade > 0, dl / p, 0))
        np.add.at(step_t, np.minimum(grade, levels - 2), np.where(grade < levels - 1, -du / p, 0))
        t = np.maximum.accumulate(t - step_t / x.shape[0])
    return w, t


def fit(sample: DataFrame) -> Model:
    """Fit on ``(doc_id, label, text)`` rows, at most ``FIT_ROWS`` of them."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [document_columns(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "label": batch.column("label"),
            "columns": [c.tobytes() for c, _ in rows],
            "counts": [v.tobytes() for _, v in rows],
        }

    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, columns binary, counts binary"
    rows = map_batches(sample.select("doc_id", "label", "text"), run, schema).toArrow().sort_by("doc_id")
    toxic = np.array(rows["label"].to_pylist(), np.int64)
    if len(set(toxic)) < 2:
        return CLEAN
    x = Sparse(
        [np.frombuffer(c, np.int32) for c in rows["columns"].to_pylist()],
        [np.frombuffer(v, np.float32) for v in rows["counts"].to_pylist()],
        BUCKETS,
    )
    del rows
    release()
    # Columns of one or two documents of the sample are noise.
    frequent = np.bincount(x.columns, minlength=BUCKETS) >= MIN_DOCS
    x.values = np.where(frequent[x.columns], x.values, 0).astype(np.float32)
    # Noise falls with the root of the sample's size, and so does the penalty against it.
    w, t = fit_ordinal(x, grades(x, toxic), penalty=PENALTY / np.sqrt(len(toxic)))
    del x
    release()
    return Model(w.astype(np.float32), tuple(map(float, t)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents (column ``toxic``)."""
    return fit(labelled_sample(docs, labels, "toxic", rows))


class Scorer:
    """Sums of weights over distinct words; a word's weight is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.memory: dict[str, float] = {}

    def __call__(self, texts: Iterable[str | None]) -> np.ndarray:
        memory, weights = self.memory, self.model.weights
        out = []
        for text in texts:
            words = words_of(text)
            for w in words.difference(memory):
                memory[w] = float(weights[columns_of(w)].sum())
            out.append(sum(map(memory.__getitem__, words)))
            if len(memory) > MEMORY_WORDS:
                memory.clear()
        return self.model.at_least(np.array(out, np.float64))


def score(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM, key: str = "doc_id") -> DataFrame:
    """``(key, p_toxic, p_severe, severity, grade, toxic)``; ``severity`` is the expected grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Scorer(shared.value))
        p = held[0](batch.column("text").to_pylist())
        return {"key": batch.column("key"), "p_toxic": p[:, 0], "p_severe": p[:, 1]}

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    out = map_batches(rows, run, f"key {kind}, p_toxic double, p_severe double").withColumnRenamed("key", key)
    return out.withColumns(
        {
            "severity": F.col("p_toxic") + F.col("p_severe"),
            "grade": F.when(F.col("p_severe") >= 0.5, 2).when(F.col("p_toxic") >= 0.5, 1).otherwise(0),
            "toxic": F.col("p_toxic") >= toxic_from,
        }
    )


def filter_documents(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def clean(texts: list[bytes]) -> list[bool]:
        if not held:
            held.append(Scorer(shared.value))
        return (held[0](t.decode() for t in texts)[:, 0] < toxic_from).tolist()

    return filter_batches(docs, clean)
