r"""Quality of documents by a linear-chain conditional random field over their lines.

Lines (cut at ``\n``) are labelled good or bad. A line's features describe its characters, its
words and whether the document had it before, and repeat the most telling ones for the line
before and after. Two states are chained by a 2 x 2 table of transition scores. In training
every line carries its document's label. A document's score is the mean of its lines'
probabilities of being good, from the forward-backward algorithm, weighted by line length.

The fit takes the lines of at most ``FIT_ROWS`` labelled documents, as runs of at most
``RUN_LINES`` lines of which at most ``FIT_RUNS`` are kept (drawn by a hash). Scoring takes every
line of every document. The model is a few dozen numbers.

Null and empty texts are one empty line and get that line's probability. Texts of any length are
scored whole; repeated rows are scored alike; an empty table gives none. Without labels of both
classes every score is 0.5. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import as_bytes, labelled_sample, map_batches, sigmoid

FIT_ROWS = 6000
FIT_RUNS = 12_000
RUN_LINES = 200
#: Good from this score upwards, as the contract of the query has it.
GOOD_FROM = 0.3

#: Classes of bytes: upper case, symbols, exclamation marks, bars, digits, other marks, spaces, beyond ASCII.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"#*$%&<>@^~=+{}[]\\_",
    b"!",
    b"|",
    b"0123456789",
    b".,;:?'\"()-/",
    b" \t\x0b\x0c\r",
    bytes(range(128, 256)),
)
OWN = ("bias", "length", "upper", "symbols", "exclamation", "bars", "digits", "marks", "spaces", "beyond_ascii",
       "distinct_words", "word_length", "repeated_line", "no_words", "short")
#: Features that are also taken from both neighbours (positions in OWN).
SHARED = tuple(OWN.index(n) for n in ("upper", "symbols", "exclamation", "bars", "distinct_words", "repeated_line", "no_words"))
WIDTH = len(OWN) + 2 * len(SHARED) + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), line lengths in bytes (the line end counted), lines per text."""
    whole = b"".join([t + b"\n" for t in texts])
    data = np.frombuffer(whole, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    sizes = ends - starts + 1
    counts = np.empty((len(starts), len(CLASSES)))
    for i, members in enumerate(CLASSES):
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        mask = table[data]
        if i == 0:
            # Upper-case letters of Latin-1 in UTF-8: C3 followed by 80..9E.
            mask[1:] += (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        counts[:, i] = np.add.reduceat(mask, starts) if len(starts) else 0
    words = np.empty(len(starts))
    distinct = np.empty(len(starts))
    again = np.empty(len(starts))
    per_text = np.empty(len(texts), np.int64)
    at = 0
    for k, text in enumerate(texts):
        lines = text.split(b"\n")
        per_text[k] = len(lines)
        seen: set[bytes] = set()
        for line in lines:
            parts = line.split()
            words[at] = len(parts)
            distinct[at] = len(set(parts))
            again[at] = len(parts) > 0 and line in seen
            seen.add(line)
            at += 1
    ratio = counts / np.maximum(sizes - 1, 1)[:, None]
    own = np.column_stack(
        [
            np.ones(len(starts)),
            np.log1p(sizes) / 5,
            np.sqrt(ratio),
            np.where(words > 0, distinct / np.maximum(words, 1), 1.0),
            np.where(words > 0, (sizes - 1 - counts[:, 6]) / np.maximum(words, 1), 0.0).clip(0, 30) / 10,
            again,
            words == 0,
            (words > 0) & (words < 5),
        ]
    )
    first = np.zeros(len(starts), bool)
    last = np.zeros(len(starts), bool)
    stops = np.cumsum(per_text)
    first[stops - per_text] = True
    last[stops - 1] = True
    near = own[:, SHARED]
    before = np.where(first[:, None], 0, np.roll(near, 1, 0))
    after = np.where(last[:, None], 0, np.roll(near, -1, 0))
    return np.column_stack([own, before, after, first, last]), sizes, per_text


@dataclass(frozen=True)
class Chain:
    """What the forward-backward algorithm leaves per line."""

    good: np.ndarray
    pairs: np.ndarray  # of a line with the one before; zero on first lines


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> Chain:
    """Marginals of many chains at once; ``emission`` is the score of good over bad."""
    step = np.exp(transition - transition.max())
    p = sigmoid(emission)
    psi = np.stack([1 - p, p], 1).clip(1e-12)
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    alpha, beta, scale = np.empty_like(psi), np.ones_like(psi), np.ones(len(psi))
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    # How many chains have a line at each step.
    alive = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    a = np.ones((len(lengths), 2))
    for t in range(longest):
        n = alive[t]
        at = start[:n] + t
        a = (a[:n] @ step if t else a[:n]) * psi[at]
        total = a.sum(1)
        a = a / total[:, None]
        alpha[at], scale[at] = a, total
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        at = start[:n] + t
        beta[at] = (psi[at + 1] * beta[at + 1] / scale[at + 1][:, None]) @ step.T
    gamma = alpha * beta
    inner = np.ones(len(psi), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((len(psi), 2, 2))
    pairs[at] = alpha[at - 1][:, :, None] * step * (psi[at] * beta[at] / scale[at][:, None])[:, None, :]
    return Chain(gamma[:, 1] / gamma.sum(1), pairs)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    transition: np.ndarray

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) per line, line lengths, lines per text."""
        x, sizes, lines = line_features(texts)
        return forward_backward(x @ self.weights, lines, self.transition).good, sizes, lines

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        good, sizes, lines = self.line_marginals(texts)
        starts = np.cumsum(lines) - lines
        return np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)


UNDECIDED = Model(np.zeros(WIDTH), np.zeros((2, 2)))


def fit_chain(x: np.ndarray, lengths: np.ndarray, label: np.ndarray, penalty: float = 2e-4, steps: int = 200) -> Model:
    """Maximum conditional likelihood by Adam.

    Every chain counts the same, whatever its length, and both labels weigh the same in sum, so
    that a rare bad document is not drowned.
    """
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    y = np.repeat(label, lengths).astype(np.float64)
    share = np.where(label == 1, label.mean(), 1 - label.mean())
    weight = np.repeat(0.5 / share / lengths, lengths) / len(lengths)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False
    true_pairs = np.zeros((2, 2))
    for k in (0, 1):
        true_pairs[k, k] = weight[inner & (y == k)].sum()
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        chain = forward_backward(x @ w, lengths, t)
        g_w = x.T @ (weight * (chain.good - y)) + penalty * w
        g_t = (weight[:, None, None] * chain.pairs).sum(0) - true_pairs + penalty * t
        g = np.r_[g_w, g_t.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:-4], t - move[-4:].reshape(2, 2)
    return Model(w, t)


def fit(sample: DataFrame) -> Model:
    """Fit on ``(doc_id, label, text)`` rows, at most ``FIT_ROWS`` of them."""
    kind = sample.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        x, _, lines = line_features(as_bytes(batch.column("text")))
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "label", "features")}
        stop = 0
        for doc, label, n in zip(ids, labels, lines.tolist(), strict=True):
            begin, stop = stop, stop + n
            for a in range(begin, stop, RUN_LINES):
                out["doc_id"].append(doc)
                out["start"].append(a - begin)
                out["label"].append(label)
                out["features"].append(x[a : min(a + RUN_LINES, stop)].astype(np.float32).tobytes())
        return out

    runs = map_batches(
        sample.select("doc_id", "label", "text"), run, f"doc_id {kind}, start long, label int, features binary"
    )
    picked = runs.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(FIT_RUNS).toArrow()
    label = np.array(picked["label"].to_pylist(), np.int64)
    if len(set(label)) < 2:
        return UNDECIDED
    x = [np.frombuffer(f, np.float32).reshape(-1, WIDTH) for f in picked["features"].to_pylist()]
    return fit_chain(np.concatenate(x).astype(np.float64), np.array([len(r) for r in x]), label)


def learn(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents (column ``quality``) that satisfy ``eligible``, a condition on ``doc_id``."""
    return fit(labelled_sample(docs, labels, "quality", rows, eligible))


def score(docs: DataFrame, model: Model, good_from: float = GOOD_FROM, key: str = "doc_id") -> DataFrame:
    """``(key, score, predicted, n_lines)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        return {
            "key": batch.column("key"),
            "score": shared.value.score(texts),
            "n_lines": [t.count(b"\n") + 1 for t in texts],
        }

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    out = map_batches(rows, run, f"key {kind}, score double, n_lines long").withColumnRenamed("key", key)
    return out.withColumn("predicted", F.when(F.col("score") >= good_from, 1).otherwise(0))


def label_lines(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, line, good)``: the probability of every line of every text, lines counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        good, _, lines = shared.value.line_marginals(as_bytes(batch.column("text")))
        return {
            "key": batch.column("key").take(pa.array(np.repeat(np.arange(len(lines)), lines))),
            "line": np.concatenate([np.arange(n) for n in lines]),
            "good": good,
        }

    rows = docs.select(F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, f"key {kind}, line long, good double").withColumnRenamed("key", key)
