"""Quality rules: counted statistics and a calibrated n-gram classifier against fixed thresholds.

The classifier is a logistic regression on hashed n-grams: words and word pairs in one block of
``BUCKETS`` columns, byte n-grams of characters (``GRAMS``) in another. A column's value is its
share of the block's n-grams, so texts of any length compare, and a score is a mean of weights.
It is fitted on at most ``FIT_ROWS`` labelled documents; ``1 / CALIBRATION`` of them are held
back and give the logistic calibration (slope and offset) of the raw score. Scoring runs in
Arrow batches with the weights broadcast (two blocks of fixed size).

Null text counts as no words. A text without words gets the score of the bias alone and fails
the base rules anyway. Texts are read whole, whatever their length; repeated rows are scored
alike; an empty table gives none. Without labels of both classes the score is 0.5 everywhere
and the classifier rejects nothing. Only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import Sparse, as_bytes, filter_batches, labelled_sample, map_batches, release, sigmoid

FIT_ROWS = 4000
BUCKETS = 1 << 16
GRAMS = (2, 3)
CALIBRATION = 5
#: Kept from this calibrated probability of good quality upwards.
KEEP_FROM = 0.3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MULTIPLIER = np.uint32(2654435761)
#: Shares are small numbers; this brings them to the scale of the weights' penalty.
SCALE = 30.0


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    # Code points: bytes that don't continue one.
    word_chars = len(text.decode()) - sum(map(text.count, [SPACES[i : i + 1] for i in range(6)]))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) < len(windows):
        reach = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), word_chars, symbols, duplicates, repeated


def _spread(h: np.ndarray) -> np.ndarray:
    return ((h * MULTIPLIER) >> np.uint32(16)).astype(np.int32)


def gram_columns(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns of the words and word pairs, and of the character n-grams, with repeats."""
    words = np.fromiter(map(crc32, text.split()), np.uint32)
    pairs = words[:-1] * np.uint32(31) + words[1:] * np.uint32(17) + np.uint32(7)
    letters = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams = []
    for n in GRAMS:
        h = np.full(max(0, len(letters) - n + 1), n, np.uint32)
        for i in range(n):
            h = h * np.uint32(16777619) + letters[i : i + len(h)]
        grams.append(_spread(h))
    return np.concatenate([_spread(words), _spread(pairs)]), np.concatenate(grams) + BUCKETS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, text: bytes) -> float:
        parts = [c for c in gram_columns(text) if len(c)]
        return self.bias + sum(SCALE * float(self.weights[c].mean()) for c in parts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.raw(t) for t in texts]) + self.offset)


UNDECIDED = Model(np.zeros(2 * BUCKETS), 0.0)


def _sparse_row(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns, values = [], []
    for block in gram_columns(text):
        at, counts = np.unique(block, return_counts=True)
        columns.append(at)
        values.append(SCALE * counts / max(1, len(block)))
    return np.concatenate(columns).astype(np.int32), np.concatenate(values).astype(np.float32)


def _logistic(x: Sparse, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the mean logistic loss with an L2 penalty."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        r = (sigmoid(x.dot(w) + b) - y) / len(y)
        g = np.append(x.back(r) + penalty * w, r.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps.

    Smoothed targets and a weak pull of the slope to 1 keep it finite on separable rows.
    """
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    design = np.stack([raw, np.ones_like(raw)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(design @ beta)
        pull = np.array([beta[0] - 1, 0.0])
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1.0, 1e-6])
        beta = beta - np.linalg.solve(hessian, design.T @ (p - target) + pull).clip(-1, 1)
    return float(beta[0]), float(beta[1])


def fit(sample: DataFrame, penalty: float = 1e-5, steps: int = 60) -> Model:
    """Fit on ``(doc_id, label, text)`` rows, at most ``FIT_ROWS`` of them."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [_sparse_row(t) for t in as_bytes(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "label": batch.column("label"),
            "columns": [c.tobytes() for c, _ in rows],
            "shares": [v.tobytes() for _, v in rows],
        }

    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, columns binary, shares binary"
    rows = map_batches(sample.select("doc_id", "label", "text"), run, schema).toArrow().sort_by("doc_id")
    y = np.array(rows["label"].to_pylist(), np.float64)
    held = np.arange(len(y)) % CALIBRATION == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return UNDECIDED
    columns = [np.frombuffer(x, np.int32) for x in rows["columns"].to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in rows["shares"].to_pylist()]

    def part(mask: np.ndarray) -> Sparse:
        at = np.flatnonzero(mask)
        return Sparse([columns[i] for i in at], [values[i] for i in at], 2 * BUCKETS)

    fitted, checked = part(~held), part(held)
    # The driver keeps one copy of the sample while it fits, and none after it.
    del rows, columns, values
    release()
    w, b = _logistic(fitted, y[~held], penalty, steps)
    slope, offset = _calibrate(checked.dot(w) + b, y[held])
    del fitted, checked
    release()
    return Model(w.astype(np.float32), b, slope, offset)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents (column ``quality``)."""
    return fit(labelled_sample(docs, labels, "quality", rows))


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, key: str = "doc_id") -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        counts = zip(*map(rule_counts, texts), strict=True)
        return {
            "key": batch.column("key"),
            **dict(zip(names, map(list, counts), strict=True)),
            "score": shared.value.score(texts),
        }

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        map_batches(rows, run, schema)
        .withColumnRenamed("key", key)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from))
    )


def filter_documents(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns; nulls count as no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[bytes]) -> list[bool]:
        out = []
        for t in texts:
            n_words, _, _, _, repeated = rule_counts(t)
            sound = n_words >= MIN_WORDS and 100 * repeated <= MAX_REPEATED_PERCENT * n_words
            out.append(sound and bool(shared.value.score([t])[0] >= keep_from))
        return out

    return filter_batches(docs, keep)
