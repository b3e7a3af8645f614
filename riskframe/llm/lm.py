"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words (A-Z lower-cased) and one end mark per text. Unigrams and bigrams are counted
over all learning documents. A count c is stored as its level ``1 + floor(log2(c))``: the n-gram
enters the filter once for every level up to its own, and is read back by probing level after
level until one is missing. Every counted n-gram is in the filter, whose size follows their number.

The filter is cut by n-gram hash into shards of at most ``SHARD_BITS``. Up to ``BROADCAST_BITS`` all
shards are broadcast together. A larger filter stays a table: every text sends each ``GROUP`` of
shards the distinct n-grams that fall there, groups are probed one at a time, and the levels are
joined back to the text. Both ways probe the same bits, so the scores are the same.

score = sum of log10 P(w | h), P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU) with
P(w) = (c(w) + 1) / (N + V + 1), all c read from the filter. A text's first history is the end mark.

The base score needs exact counts. Words that make up ``HEAD_SHARE`` or more (at most
``1 / HEAD_SHARE`` words can) are broadcast with their counts; the other words of a text are
joined with the whole table of counts, one row per text and distinct word, and summed.

Null text counts as empty: one end mark. A null id is neither held out nor learned from by a rule
on ids. Without learning documents N and V are 0 and every probability is 1 / 1. Texts of any
length are read whole; repeated rows are scored each by themselves; an empty table gives none.
Only the id and text columns are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import ASCII_LOWER, arrow_schema, as_bytes, map_batches, slices
from riskframe.session import checkpointed, scratch_path

HEAD_SHARE = 2.0**-22
BITS_PER_ENTRY = 10
SHARD_BITS = 1 << 20
GROUP = 128
BROADCAST_BITS = 1 << 29
PROBES = 6
MU = 50.0
MEMORY_WORDS = 400_000
FLUSH = 3_000_000
END = np.uint64(xxhash.xxh64_intdigest(b"", 1))

_words: dict[bytes, int] = {}


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text closed by END, and the number of each text's tokens."""
    if len(_words) > MEMORY_WORDS:
        _words.clear()
    split = [t.translate(ASCII_LOWER).split() for t in texts]
    for word in set().union(*split).difference(_words):
        _words[word] = xxhash.xxh64_intdigest(word)
    sizes = np.array([len(w) + 1 for w in split], np.int64)
    out = np.full(int(sizes.sum()), END)
    at = 0
    for words, size in zip(split, sizes.tolist(), strict=True):
        out[at : at + size - 1] = np.fromiter(map(_words.__getitem__, words), np.uint64, size - 1)
        at += size
    return out, sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each one; END before a text's first."""
    before = np.roll(tokens, 1)
    before[np.cumsum(sizes) - sizes] = END
    return before


def bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + token)


def levels_of(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """Quantised counts; 0 below ``least``."""
    t = np.maximum(counts, 1) / least
    return np.where(counts >= least, 1 + np.floor(np.log2(np.maximum(t, 1))), 0).astype(np.int64)


def counts_of(levels: np.ndarray, least: int = 1) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    low = least * 2.0 ** (levels - 1)
    return np.where(levels > 0, (low + np.maximum(low, 2 * low - 1)) / 2, 0.0)


def shard_of(ngrams: np.ndarray, shards: int) -> np.ndarray:
    """As ``pmod`` of the signed number in SQL."""
    return np.mod(ngrams.view(np.int64), shards)


def shape_of(size: int) -> tuple[int, int]:
    """The number of shards, and bits of each, for ``size`` entries over all levels."""
    bits = max(1, size * BITS_PER_ENTRY)
    shards = -(-bits // SHARD_BITS)
    return shards, -(-bits // (shards * 64)) * 64


@dataclass
class LogFrequencyFilter:
    """Bits of (n-gram, level) pairs, shard after shard from ``first``; n-grams are 64-bit numbers."""

    words: np.ndarray
    shards: int  # in all
    bits: int  # of one shard
    first: int = 0

    @staticmethod
    def positions(ngrams: np.ndarray, level: int | np.ndarray, bits: int) -> np.ndarray:
        """PROBES bit positions per n-gram (rows)."""
        level = np.asarray(level).astype(np.uint64)
        a = mixed(ngrams + level * np.uint64(0xD1342543DE82EF95))
        b = mixed(a ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        i = np.arange(PROBES, dtype=np.uint64)
        return ((a[:, None] + i[None, :] * b[:, None]) % np.uint64(bits)).astype(np.int64)

    def levels(self, ngrams: np.ndarray) -> np.ndarray:
        """The stored level of each n-gram, 0 if it isn't there."""
        out = np.zeros(len(ngrams), np.int64)
        open_ = np.arange(len(ngrams))
        start = (shard_of(ngrams, self.shards) - self.first) * self.bits
        level = 1
        while len(open_):
            at = self.positions(ngrams[open_], level, self.bits) + start[open_, None]
            there = ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            open_ = open_[there]
            out[open_] = level
            level += 1
        return out


@dataclass
class Model:
    filter: LogFrequencyFilter | None  # None where it is too large for a broadcast
    words: str  # path of its (shard, words)
    shards: int
    bits: int  # of one shard
    tokens: int
    types: int
    head: np.ndarray  # hashes of frequent words, ascending
    head_counts: np.ndarray

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for any other."""
        if not len(self.head):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return np.where(self.head[at] == words, self.head_counts[at], 0)

    def log_probabilities(
        self,
        levels: Callable[[np.ndarray], np.ndarray],
        words: np.ndarray,
        place: np.ndarray,
        before: np.ndarray,
        tokens: np.ndarray,
    ) -> np.ndarray:
        """log10 P(token | before); ``tokens`` is ``words[place]``, ``words`` ascending with END among them."""
        single = counts_of(levels(words))
        pair = counts_of(levels(bigram(before, tokens)))
        history = single[np.searchsorted(words, before)]
        smooth = (single[place] + 1) / (self.tokens + self.types + 1)
        pair = np.minimum(pair, np.minimum(history, single[place]))
        return np.log10((pair + MU * smooth) / (history + MU))


def _count(rows: DataFrame, pairs: bool = False) -> DataFrame:
    """``(hash, n)`` of all tokens, or of all bigrams; counted in each task first."""
    schema = arrow_schema("hash long, n long")

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def batch_of(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches):
            tokens, sizes = tokens_of(as_bytes(batch.column("text")))
            if pairs:
                tokens = bigram(histories(tokens, sizes), tokens)
            held.append(np.unique(tokens, return_counts=True))
            if sum(len(k) for k, _ in held) > FLUSH:
                held = [merged(held)]
                if len(held[0][0]) > FLUSH // 2:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(merged(held))

    return rows.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def filter_words(entries: DataFrame, least: int, shards: int, bits: int) -> DataFrame:
    """``(shard, words)``: the filter of ``(hash, n)`` n-grams, without empty shards."""
    schema = arrow_schema("shard long, words binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, set_ = -1, np.zeros(bits, bool)

        def done() -> pa.RecordBatch:
            words = np.packbits(set_, bitorder="little").tobytes()
            set_[:] = False
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([words])], schema=schema)

        for batch in batches:
            ngrams = batch.column("hash").to_numpy().view(np.uint64)
            level = levels_of(batch.column("n").to_numpy(), least)
            shard = batch.column("shard").to_numpy()
            starts = np.flatnonzero(np.diff(shard, prepend=-1) != 0).tolist()
            for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
                if shard[a] != current:
                    if current >= 0:
                        yield done()
                    current = int(shard[a])
                open_ = np.arange(a, b)
                for k in range(1, int(level[a:b].max()) + 1):
                    open_ = open_[level[open_] >= k]
                    set_[LogFrequencyFilter.positions(ngrams[open_], k, bits)] = True
        if current >= 0:
            yield done()

    placed = entries.select("hash", "n", F.pmod("hash", F.lit(shards).cast("long")).alias("shard")).repartition("shard")
    return placed.sortWithinPartitions("shard").mapInArrow(run, "shard long, words binary")


def collected(words: DataFrame, shards: int, bits: int) -> LogFrequencyFilter:
    out = np.zeros((shards, bits // 64), np.uint64)
    for batch in words.toArrow().to_batches():
        for shard, held in zip(batch.column("shard").to_pylist(), batch.column("words"), strict=True):
            out[shard] = np.frombuffer(held.as_buffer(), np.uint64)
    return LogFrequencyFilter(out.ravel(), shards, bits)


def build_filter(entries: DataFrame, least: int, size: int) -> LogFrequencyFilter:
    """The filter of ``(hash, n)`` n-grams with ``size`` entries over all levels."""
    shape = shape_of(size)
    return collected(filter_words(entries, least, *shape), *shape)


def learn(docs: DataFrame, eligible: Column | None = None) -> tuple[Model, DataFrame]:
    """The model and the exact counts ``(hash, n)`` of the documents that satisfy ``eligible``."""
    rows = (docs if eligible is None else docs.where(eligible)).select("text")
    counts = checkpointed(_count(rows))
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = total["tokens"] or 0, total["types"]
    # At most 1 / HEAD_SHARE rows of two numbers.
    head = counts.where(F.col("n") >= tokens * HEAD_SHARE).toArrow()
    hashes = head["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    head_hashes, head_counts = hashes[order], head["n"].to_numpy()[order]
    entries = counts.unionByName(checkpointed(_count(rows, pairs=True)))
    size = entries.agg(F.sum(F.floor(F.log2("n")) + 1)).first()[0] or 0
    shards, bits = shape_of(size)
    target = scratch_path(docs.sparkSession, "lm-filter")
    filter_words(entries, 1, shards, bits).write.parquet(target)
    small = shards * bits <= BROADCAST_BITS
    filter_ = collected(docs.sparkSession.read.parquet(target), shards, bits) if small else None
    return Model(filter_, target, shards, bits, tokens, types, head_hashes, head_counts), counts


def by_shard(tokens: np.ndarray, sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and bigrams of each text in shard order, their shards and their texts' numbers."""
    pairs = bigram(histories(tokens, sizes), tokens)
    keys, texts = [], []
    for k, (a, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
        found = np.unique(np.concatenate([tokens[a : a + n], pairs[a : a + n]]))
        keys.append(found[np.argsort(shard_of(found, shards), kind="stable")])
        texts.append(np.full(len(found), k))
    keys = np.concatenate(keys)
    return keys, shard_of(keys, shards), np.concatenate(texts)


def with_levels(rows: DataFrame, model: Model) -> DataFrame:
    """``(row, key, text, levels)``: the levels of each text's ``by_shard``, an array of bytes by group.

    A partition is sorted so that a group's words come before the n-grams that probe it; one group is
    held at a time.
    """
    shards, bits = model.shards, model.bits
    asked_schema = arrow_schema("part long, row long, hashes array<long>, words binary")
    found_schema = arrow_schema("row long, part long, levels binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, shard, text = by_shard(*tokens_of(as_bytes(batch.column("text"))), shards)
            part = shard // GROUP
            starts = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(text) != 0)])
            edges = pa.array(np.r_[starts, len(keys)].astype(np.int32))
            hashes = pa.ListArray.from_arrays(edges, pa.array(keys.view(np.int64)), type=asked_schema.field("hashes").type)
            row = batch.column("row").to_numpy()[text[starts]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts]), pa.array(row), hashes, pa.nulls(len(starts), pa.binary())], schema=asked_schema
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, filter_ = -1, None
        for batch in batches:
            part, row = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            starts = np.flatnonzero(np.diff(part, prepend=-1) != 0).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
                if part[a] != current:
                    current = int(part[a])
                    held = np.zeros(GROUP * bits // 64, np.uint64)
                    filter_ = LogFrequencyFilter(held, shards, bits, current * GROUP)
                middle = a + int((row[a:b] < 0).sum())
                for k in range(a, middle):
                    at = (int(row[k]) + shards - filter_.first) * bits // 64
                    filter_.words[at : at + bits // 64] = np.frombuffer(batch.column("words")[k].as_buffer(), np.uint64)
                if middle == b:
                    continue
                asked = batch.column("hashes").slice(middle, b - middle)
                levels = filter_.levels(asked.flatten().to_numpy().view(np.uint64)).astype(np.uint8)
                edges = np.r_[0, np.cumsum(asked.value_lengths().to_numpy())].astype(np.int32)
                buffers = [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(levels.tobytes())]
                bytes_ = pa.Array.from_buffers(pa.binary(), b - middle, buffers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[middle:b]), pa.array(part[middle:b]), bytes_], schema=found_schema
                )

    # Shards are rows from -shards to -1.
    words = rows.sparkSession.read.parquet(model.words).select(
        F.floor(F.col("shard") / GROUP).alias("part"),
        (F.col("shard") - shards).alias("row"),
        F.lit(None).cast("array<long>").alias("hashes"),
        "words",
    )
    asked = words.unionByName(rows.mapInArrow(ask, "part long, row long, hashes array<long>, words binary"))
    placed = asked.repartition(-(-shards // GROUP), "part").sortWithinPartitions("part", "row")
    found = placed.mapInArrow(probe, "row long, part long, levels binary").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("part", "levels"))).alias("_l")
    )
    return rows.join(found, "row").select("row", "key", "text", F.col("_l.levels").alias("levels"))


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    if model.filter is None:
        # Written, so that a text keeps its number.
        numbered = scratch_path(spark, "lm-rows")
        rows.write.parquet(numbered)
        rows = with_levels(spark.read.parquet(numbered), model)
    tail_schema = arrow_schema("tail array<long>, times array<long>")
    cells = float(model.tokens + model.types + 1)

    def run(batch: pa.RecordBatch) -> dict:
        model = shared.value
        tokens, sizes = tokens_of(as_bytes(batch.column("text")))
        words, place = np.unique(tokens, return_inverse=True)
        exact = model.exact(words)
        starts = np.cumsum(sizes) - sizes
        in_head = exact > 0
        base = np.where(in_head, np.log10((exact + 1) / cells), 0.0)
        if model.filter is None:
            ngrams, index = np.unique(by_shard(tokens, sizes, model.shards)[0], return_index=True)
            held = np.frombuffer(b"".join(batch.column("levels").flatten().to_pylist()), np.uint8)[index]
            logs = model.log_probabilities(
                lambda x: held[np.searchsorted(ngrams, x)].astype(np.int64), words, place, histories(tokens, sizes), tokens
            )
        else:
            logs = model.log_probabilities(model.filter.levels, words, place, histories(tokens, sizes), tokens)
        # The other words of each text, once per text.
        at = np.flatnonzero(~in_head[place])
        pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * len(words) + place[at], return_counts=True)
        edges = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(words)).astype(np.int32)
        tail = words[pairs % len(words)].view(np.int64)
        return {
            "row": batch.column("row"),
            "key": batch.column("key"),
            "n_tokens": sizes,
            "known": np.add.reduceat(in_head[place].astype(np.int64), starts),
            "base": np.add.reduceat(base[place], starts),
            "score": np.add.reduceat(logs, starts),
            "tail": pa.ListArray.from_arrays(pa.array(edges), pa.array(tail), type=tail_schema.field("tail").type),
            "times": pa.ListArray.from_arrays(
                pa.array(edges), pa.array(times.astype(np.int64)), type=tail_schema.field("times").type
            ),
        }

    target = scratch_path(spark, "lm")
    schema = f"row long, key {kind}, n_tokens long, known long, base double, score double, tail array<long>, times array<long>"
    map_batches(rows, run, schema).write.parquet(target)
    scored = spark.read.parquet(target)
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select(
        "row", F.col("x.tail").alias("hash"), F.col("x.times").alias("times")
    )
    # Words of the head are in no tail, so what joins here are rare words alone.
    found = rare.join(counts.where(F.col("n") < model.tokens * HEAD_SHARE), "hash").groupBy("row").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_logs")
    )
    # Every token outside the head has at least log10(1 / cells); a count adds log10(n + 1) to that.
    unknown = (F.col("n_tokens") - F.col("known")) * F.lit(-float(np.log10(cells)))
    return scored.join(found, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + unknown + F.coalesce("tail_logs", F.lit(0.0))).alias("base_score"),
        "score",
    )
