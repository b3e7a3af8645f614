"""Scores of a corpus by the log-frequency Bloom filter learned from it, with one exchange of n-grams.

``lm.learn`` and ``lm.score`` make a model and apply it to any documents. Where the filter outgrows a broadcast and
the documents to score are those it is learned from, counting and probing can share the n-grams' way to
the filter's shards:

1. Documents are tokenised once into blocks of ``BLOCK_BYTES`` of text: the distinct words of the block and
   the place of every token among them, written to the shared folder.
2. Each block sends every shard its distinct words and bigrams there, with their counts in learning documents.
   A shard is a range of hashes, so sorted n-grams need no second sort, and only their differences travel.
3. The task of a shard adds up the counts, enters every counted n-gram into the shard's filter, sized by its own
   entries, and probes it for each block's n-grams. The answer is one level (a byte) per n-gram, and for words the
   exact count, which the base score needs.
4. Answers meet their blocks, and every document is scored.

Probabilities, tokens and levels are those of ``lm``; so are the rules for null, empty, repeated and long texts.
A shard's filter is kept beside its answers. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import arrow_schema, as_bytes, slices
from riskframe.llm.lm import (
    BITS_PER_ENTRY,
    MU,
    LogFrequencyFilter,
    bigram,
    counts_of,
    histories,
    levels_of,
    tokens_of,
)
from riskframe.session import scratch_path

BLOCK_BYTES = 8 << 20
#: Tokens of the corpus for every shard.
SHARD_TOKENS = 1 << 21


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress where the high bytes are alike."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_sorted(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def shard_edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of ascending hashes begins, and the end."""
    lows = [-(-(s << 64) // shards) for s in range(1, shards)]
    return np.r_[0, np.searchsorted(hashes, np.array(lows, np.uint64)), len(hashes)]


def blocks(docs: DataFrame, eligible: Column, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, keys, sizes, learned, words, places, n_tokens, n_learned)``, written; one row per block."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(eligible, F.lit(False)).alias("learned"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    ddl = (
        f"block long, keys array<{kind}>, sizes binary, learned binary, words binary, places binary, "
        "n_tokens long, n_learned long"
    )
    schema = arrow_schema(ddl)

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _, _, _ in held])
        sizes = np.concatenate([s for _, s, _, _ in held])
        learned = np.concatenate([x for _, _, x, _ in held])
        # The end mark is always among the words, as it is the history of first tokens.
        words, places = np.unique(tokens, return_inverse=True)
        keys = pa.concat_arrays([k for _, _, _, k in held])
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(schema.field("keys").type)
        values = [
            packed(sizes), packed(learned.astype(np.uint8)), packed_sorted(words), packed(places.astype(np.uint32)),
            len(tokens), int(sizes[learned].sum()),
        ]
        columns = [pa.array([number]), lists, *(pa.array([v], f.type) for v, f in zip(values, list(schema)[2:], strict=True))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            held.append((*tokens_of(texts), learned, batch.column("key")))
            size += sum(map(len, texts))
            if size >= block_bytes:
                yield block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    path = scratch_path(docs.sparkSession, "lm-blocks")
    rows.mapInArrow(run, ddl).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Block:
    """The n-grams of one block row."""

    def __init__(self, row: dict):
        self.sizes = unpacked(row["sizes"], np.int64)
        self.words = unpacked_sorted(row["words"])
        self.places = unpacked(row["places"], np.uint32).astype(np.int64)
        tokens = self.words[self.places]
        self.before = histories(tokens, self.sizes)
        self.pairs, self.pair_places = np.unique(bigram(self.before, tokens), return_inverse=True)

    def counts(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the words, and the bigrams, occur in learning documents."""
        at = np.repeat(learned.astype(bool), self.sizes)
        return (
            np.bincount(self.places[at], minlength=len(self.words)),
            np.bincount(self.pair_places[at], minlength=len(self.pairs)),
        )


def _rows(batch: pa.RecordBatch, columns: list[str]) -> Iterator[dict]:
    """One row after the other: each holds whole arrays."""
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in columns}


def asked(block_rows: DataFrame, shards: int) -> DataFrame:
    """``(shard, pairs, block, hashes, counts)``: what each block wants of each shard; ``pairs`` 0 words, 1 bigrams."""
    schema = arrow_schema("shard long, pairs int, block long, hashes binary, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch, ["block", "sizes", "learned", "words", "places"]):
                block = Block(row)
                of_words, of_pairs = block.counts(unpacked(row["learned"], np.uint8))
                out: list[tuple] = []
                for pairs, hashes, counts in ((0, block.words, of_words), (1, block.pairs, of_pairs)):
                    edges = shard_edges(hashes, shards).tolist()
                    for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        if a < b:
                            # A block of 2^32 tokens would be one text of that many.
                            out.append((shard, pairs, row["block"], packed_sorted(hashes[a:b]), packed(counts[a:b].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    plain = block_rows.select("block", "sizes", "learned", "words", "places")
    return plain.mapInArrow(run, "shard long, pairs int, block long, hashes binary, counts binary")


ANSWER = "block long, shard long, pairs int, levels binary, exact binary, types long, bits long, filter binary"


def answer(shard: int, rows: list[dict]) -> Iterator[dict]:
    """Counts, filter and answers of one shard from what all blocks ask of it."""
    hashes = [unpacked_sorted(r["hashes"]) for r in rows]
    # Words and bigrams have hashes of their own kind; each keeps its counts.
    totals = {}
    for pairs in (0, 1):
        own = [i for i, r in enumerate(rows) if r["pairs"] == pairs]
        if own:
            keys, inverse = np.unique(np.concatenate([hashes[i] for i in own]), return_inverse=True)
            counts = np.concatenate([unpacked(rows[i]["counts"], np.uint32) for i in own])
            totals[pairs] = keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)
    entries = [(keys[n > 0], levels_of(n[n > 0])) for keys, n in totals.values()]
    size = int(sum(levels.sum() for _, levels in entries))
    bits = max(64, -(-size * BITS_PER_ENTRY // 64) * 64)
    there = np.zeros(bits, bool)
    for keys, levels in entries:
        for k in range(1, int(levels.max(initial=0)) + 1):
            there[LogFrequencyFilter.positions(keys[levels >= k], k, bits)] = True
    words = np.packbits(there, bitorder="little").view(np.uint64)
    held = LogFrequencyFilter(words, 1, bits)
    types = int((totals[0][1] > 0).sum()) if 0 in totals else 0
    for i, (r, own) in enumerate(zip(rows, hashes, strict=True)):
        exact = None
        if not r["pairs"]:
            keys, n = totals[0]
            exact = packed(n[np.searchsorted(keys, own)])
        first = i == 0
        yield {
            "block": r["block"], "shard": shard, "pairs": r["pairs"], "levels": held.levels(own).astype(np.uint8).tobytes(),
            "exact": exact, "types": types if first else 0, "bits": bits if first else None, "filter": words.tobytes() if first else None,
        }


def answers(asks: DataFrame, shards: int) -> DataFrame:
    """The answers of all shards (``ANSWER``), written. A shard's first row holds its filter."""
    schema = arrow_schema(ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            for row in answer(held[0]["shard"], held):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in _rows(batch, ["shard", "pairs", "block", "hashes", "counts"]):
                if held and held[0]["shard"] != row["shard"]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    path = scratch_path(asks.sparkSession, "lm-answers")
    placed = asks.repartition(shards, "shard").sortWithinPartitions("shard", "pairs", "block")
    placed.mapInArrow(run, ANSWER).write.parquet(path)
    return asks.sparkSession.read.parquet(path)


def score_corpus(
    docs: DataFrame,
    eligible: Column,
    key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    The filter is learned from the rows that satisfy ``eligible``.
    """
    block_rows = blocks(docs, eligible, key, block_bytes)
    total = block_rows.agg(F.sum("n_tokens").alias("all"), F.sum("n_learned").alias("learned"), F.count("*").alias("blocks")).first()
    tokens = total["learned"] or 0
    shards = max(1, -(-(total["all"] or 0) // shard_tokens))
    found = answers(asked(block_rows, shards), shards)
    types = found.agg(F.sum("types")).first()[0] or 0
    kind = block_rows.schema["keys"].dataType.elementType.simpleString()
    ddl = f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)
    cells = float(tokens + types + 1)

    def scored(row: dict, keys: pa.Array, held: list[dict]) -> pa.RecordBatch:
        block = Block(row)
        # Answers come by shard, and shards by hash.
        levels = [np.frombuffer(b"".join(h["levels"] for h in held if h["pairs"] == p), np.uint8) for p in (0, 1)]
        exact = np.concatenate([unpacked(h["exact"], np.int64) for h in held if not h["pairs"]])
        single, pair = counts_of(levels[0].astype(np.int64)), counts_of(levels[1].astype(np.int64))
        history = single[np.searchsorted(block.words, block.before)]
        own = single[block.places]
        smooth = (own + 1) / cells
        both = np.minimum(pair[block.pair_places], np.minimum(history, own))
        logs = np.log10((both + MU * smooth) / (history + MU))
        base = np.log10((exact + 1) / cells)[block.places]
        starts = np.cumsum(block.sizes) - block.sizes
        columns = [
            keys,
            block.sizes,
            np.add.reduceat((exact > 0)[block.places].astype(np.int64), starts),
            np.full(len(keys), tokens),
            np.add.reduceat(base, starts),
            np.add.reduceat(logs, starts),
        ]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i, row in enumerate(_rows(batch, ["block", "shard", "pairs", "levels", "exact", "sizes", "words", "places"])):
                if row["words"] is None:
                    held.append(row)
                else:
                    yield scored(row, batch.column("keys").slice(i, 1).flatten(), held)
                    held = []

    last = F.lit(shards).cast("long").alias("shard")
    whole = block_rows.select("block", last, "keys", "sizes", "words", "places")
    both = found.select("block", "shard", "pairs", "levels", "exact").unionByName(whole, allowMissingColumns=True)
    placed = both.repartition(max(1, total["blocks"]), "block").sortWithinPartitions("block", "shard", "pairs")
    return placed.mapInArrow(run, ddl).withColumnRenamed("key", key)
