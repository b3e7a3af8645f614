"""How filters overlap: what each removes, alone and in every order, by part of a corpus.

Every document gets one bit per filter it fails. The number of documents per part and
combination of bits, reshaped to ``2 x 2 x ... x 2`` (one axis per filter; index 0 passes, 1
fails), holds all that any order of the filters can show. A step of an order picks along each axis
the passing entry (filters applied before), the failing one, or the sum of both; one ``einsum`` over
these selections gives the counts of all steps of all orders. Of documents only the bits and a
digest of the text move between tasks, and what meets in one task is one part's table of
``2 ** filters`` counts.

The fifth filter of ``corpus_failures`` is table-wide: a text that equals one with a smaller id. Equal
texts are counted by (digest, id) first, so copies of one text are spread over tasks however many
there are; one row per digest, part and labels is left when the smallest id is sought.

Null text counts as empty and a null part as an empty string. A row without an id has no label, is
never a later copy and makes no other row one. Of repeated rows that share id and text none is the
later one. A document labelled more than once counts as good (toxic) if any of its labels says so.
Texts are read whole, whatever their length. An empty table has no parts and gives no rows. Only id,
text and part are read, so other columns of any name are harmless.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import UPPER, arrow_schema, as_bytes, map_batches
from riskframe.session import checkpointed

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOL = re.compile(rb"[#$%&*|]")
#: What a part's documents are counted by, beside the bits: all, good ones, toxic ones.
KINDS = ("n", "good", "toxic")


def text_bits(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, a symbol."""
    words = text.split()
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    upper = len(text) - len(text.translate(None, UPPER))
    loud = 100 * upper > MAX_UPPER_PERCENT * n_chars
    return few | repeated << 1 | loud << 2 | (SYMBOL.search(text) is not None) << 3


def corpus_failures(docs: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """``(key, part, bits, digest)``: the bits of the filters A to D and a digest of the text."""
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        chars = pc.utf8_length(batch.column("text")).to_pylist()
        return {
            "key": batch.column("key"),
            "part": batch.column("part"),
            "bits": list(map(text_bits, texts, chars)),
            "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts],
        }

    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, f"key {kind}, part string, bits int, digest binary")


def _flag(column: str) -> Column:
    """Whether any of an id's labels is 1."""
    return F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0)).alias(column)


def contingency(
    failures: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """``(part, bits, n, good, toxic)`` with the bit of later copies added as the next one, here bit 4.

    ``failures`` holds ``(key, part, bits, digest)``; equal digests stand for equal texts, and rows of one
    digest have the same bits.
    """
    copy_bit = 1 << (len(FILTERS) - 1)
    # A few dozen bytes a document, so that texts are read once.
    failures = checkpointed(failures)
    marks = labels.select(F.col(key).alias("key"), F.col(good).alias("good"), F.col(toxic).alias("toxic"))
    marks = marks.where(F.col("key").isNotNull()).groupBy("key").agg(_flag("good"), _flag("toxic"))
    marked = failures.where(F.col("key").isNotNull()).join(marks, "key", "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    alike = ["digest", "part", "bits", "good", "toxic"]
    # The rows lie by key already, so this adds no exchange; an id's repeated rows become one.
    single = marked.groupBy("key", *alike).agg(F.count(F.lit(1)).alias("n"))
    groups = single.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("first")
    )
    least = groups.groupBy("digest").agg(F.min("first.key").alias("least"))
    at_least = F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    ordered = groups.join(least, "digest").select("part", "bits", "good", "toxic", "n", at_least.alias("kept"))
    nameless = failures.where(F.col("key").isNull()).groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n"))
    nameless = nameless.select("part", "bits", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n", F.col("n").alias("kept"))
    # A group is its first rows and its later copies.
    pieces = F.array(
        F.struct(F.col("bits"), F.col("kept").alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(copy_bit)).alias("bits"), (F.col("n") - F.col("kept")).alias("n")),
    )
    return (
        ordered.unionByName(nameless)
        .select("part", "good", "toxic", F.inline(pieces))
        .groupBy("part", "bits")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("good", "toxic")])
    )


def selections(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders, and per order and step what is picked along each axis before and at that step.

    A selection is ``(1, 0)`` for pass, ``(0, 1)`` for fail, ``(1, 1)`` for all; the arrays have the axes
    (order, step, filter, pass or fail). ``before`` passes the earlier filters and takes all of the rest.
    """
    orders = list(itertools.permutations(range(filters)))
    before = np.ones((len(orders), filters, filters, 2), np.int64)
    at = np.ones_like(before)
    for i, order in enumerate(orders):
        for step, f in enumerate(order):
            earlier = list(order[:step])
            before[i, step, earlier] = at[i, step, earlier] = (1, 0)
            at[i, step, f] = (0, 1)
    return orders, before, at


def contract(counts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """``counts`` (kinds, 2, ..., 2) summed under each selection of ``picks`` (..., filter, 2)."""
    filters = counts.ndim - 1
    flat = picks.reshape(-1, filters, 2)
    axes = list(range(1, filters + 1))
    operands: list = [counts, [0, *axes]]
    for axis in axes:
        operands += [flat[:, axis - 1], [filters + 1, axis]]
    out = np.einsum(*operands, [0, filters + 1], optimize="greedy")
    return out.reshape(counts.shape[0], *picks.shape[:-2])


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every (order, step) from a part's table (kinds, 2, ..., 2)."""
    filters = counts.ndim - 1
    orders, before, at = selections(filters)
    removed = contract(counts, at)
    entering = contract(counts[:1], before)[0]
    current = np.array(orders)
    fails = np.ones((filters, filters, 2), np.int64)
    only = np.tile(np.array([1, 0], np.int64), (filters, filters, 1))
    fails[range(filters), range(filters)] = only[range(filters), range(filters)] = (0, 1)
    failing, alone = contract(counts[:1], fails)[0], contract(counts[:1], only)[0]
    total = np.zeros(filters, np.int64)
    np.add.at(total, current, removed[0])
    return {
        "kept": entering - removed[0],
        "removed": removed[0],
        "redundant": failing[current] - removed[0],
        "unique_fails": alone[current],
        "good_lost": removed[1],
        "toxic_lost": removed[2],
        "shapley": total[current],
    }


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(table: DataFrame, names: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, ...)`` of every part, order and step, zeros included.

    ``table`` is ``(part, bits, n, good, toxic)``; bit ``i`` stands for the filter ``names[i]``.
    """
    filters = len(names)
    schema = arrow_schema("part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
    cells = table.groupBy("part").agg(F.collect_list(F.struct("bits", *KINDS)).alias("cells"))
    labels = ["".join(names[f] for f in order) for order in itertools.permutations(range(filters))]

    def run(batches):
        for batch in batches:
            for part, entries in zip(*(batch.column(c).to_pylist() for c in ("part", "cells")), strict=True):
                counts = np.zeros((len(KINDS), 1 << filters), np.int64)
                for cell in entries:
                    counts[:, cell["bits"]] += [cell[k] for k in KINDS]
                # Bit i becomes axis i: the lowest bit is the last axis of a plain reshape.
                cube = counts.reshape(-1, *[2] * filters).transpose(0, *range(filters, 0, -1))
                found = steps(cube)
                n = len(labels) * filters
                columns = [
                    pa.array([part] * n),
                    pa.array(np.repeat(labels, filters)),
                    pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), len(labels))),
                    *[pa.array(found[m].ravel()) for m in MEASURES],
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return cells.mapInArrow(run, ddl)
