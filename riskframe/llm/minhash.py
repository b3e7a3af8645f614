"""Near-duplicates by a multi-index Hamming join of b-bit minwise signatures.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets are found by a
digest and joined first, so copies never meet each other. A set's signature has ``COMPONENTS``
minwise values of ``B_BITS`` bits. It is split into ``CHUNKS`` chunks; by the pigeonhole
principle two signatures that differ in at most ``GUARANTEED`` components have a chunk in which
at most ``ERRORS`` component differs. Each set is therefore entered under every chunk with every
choice of ``ERRORS`` components left out, and all pairs within that distance share an entry. Sets with a
similarity of 0.75 or more share one with a probability above 0.999998.

Pairs that share an entry are judged by a longer sketch (``SKETCH`` values of 8 bits, a pair is
close up to ``CLOSE`` differences; similar sets expect a quarter to differ). Only what connects sets
is ever listed, never all pairs of a group:

1. In every entry each set is compared with one member, the least by a hash; there are ``ORDERS``
   hashes. This joins most of a group of near copies.
2. In entries that still hold several groups, sets of different groups are compared in blocks of at
   most ``BLOCK``; a spanning forest of what is close is kept.
3. The connected groups of close sets hold every candidate pair. Their texts are fetched once, by id
   and text hash, and links are confirmed on whole sets, for all pairs of a group, by blocks of at
   most ``BLOCK`` sets; each block leaves a spanning forest of its links. Nothing is capped.

Null and empty texts, and texts without words, have an empty set, link with nothing and are kept.
Fewer than five words are one shingle. Texts are read whole. Null ids come last: a component's
id is its smallest id that isn't null, and null if there is none. Of rows with one id and one set
each has that id; ``kept`` marks one row of every component. An empty table gives none. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import ASCII_LOWER, WORD, arrow_schema, as_bytes, map_batches, release, slices, worker_memory
from riskframe.session import checkpointed, scratch_path

WORDS = 5
SIMILAR_PERCENT = 75
B_BITS = 16
CHUNKS, CHUNK, ERRORS = 10, 4, 1
COMPONENTS = CHUNKS * CHUNK
#: The largest distance at which a shared entry is certain.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
SKETCH = 128
#: Five standard deviations above the 32 differences that similar sets expect.
CLOSE = 56
ORDERS = 3
BLOCK = 512
#: Bits of the filter of wanted texts; a fixed size, and a full filter merely lets more texts pass.
FILTER_BITS = 1 << 26
#: Shingles compared at a time when a block's links are confirmed.
COLUMNS = 4096
MEMORY_WORDS = 100_000

_random = np.random.default_rng(5)
_XOR = _random.integers(0, 1 << 63, SKETCH, np.uint64)
_ODD = _random.integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a whole text, as ascending 64-bit hashes."""
    words = text.translate(ASCII_LOWER).split()
    known = worker_memory("shingles", dict)
    if len(known) > MEMORY_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    if not size:
        return h
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * _STEP + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """Low bits of the minimum of each hash function over a set: the signature and the sketch."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        least = np.minimum(least, ((s[i : i + 256, None] ^ _XOR) * _ODD).min(0))
    return least[:COMPONENTS].astype(f"<u{B_BITS // 8}").tobytes(), least.astype(np.uint8).tobytes()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, with the file sizes as statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def describe_sets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text_hash, n, digest, signature, sketch)`` of every row; the last three are null for an empty set."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        n, digests, marks = [], [], []
        for text in as_bytes(batch.column("text")):
            s = shingles(text)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            marks.append(signature(s) if len(s) else (None, None))
        return {
            "key": batch.column("key"),
            "text_hash": batch.column("text_hash"),
            "n": n,
            "digest": digests,
            "signature": [m[0] for m in marks],
            "sketch": [m[1] for m in marks],
        }

    return map_batches(rows, run, f"key {kind}, text_hash long, n long, digest binary, signature binary, sketch binary")


def distinct_sets(described: DataFrame) -> DataFrame:
    """One row per set, with its first id: the columns of ``describe_sets`` and ``set``, a number."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash"))
    return written(
        described.where("n > 0")
        .groupBy("digest")
        .agg(first.alias("first"), *[F.min(c).alias(c) for c in ("n", "signature", "sketch")])
        .select(
            F.monotonically_increasing_id().alias("set"),
            F.col("first.key").alias("key"),
            F.col("first.text_hash").alias("text_hash"),
            "n",
            "digest",
            "signature",
            "sketch",
        ),
        "sets",
    )


def entries(sets: DataFrame, extra: str) -> DataFrame:
    """``(entry, chunk, set, <extra long>)``: every chunk with every choice of a component left out."""
    schema = arrow_schema(f"entry long, chunk int, set long, {extra} long")
    keep = np.array([[i for i in range(CHUNK) if i != out] for out in range(CHUNK)])
    tag = (np.arange(CHUNKS)[:, None] * CHUNK + np.arange(CHUNK)[None, :]).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), f"<u{B_BITS // 8}")
            values = values.reshape(-1, CHUNKS, CHUNK)[:, :, keep].astype(np.uint64)
            total = np.broadcast_to(tag, values.shape[:3]).copy()
            for i in range(CHUNK - ERRORS):
                total = mixed(total * _STEP + values[..., i])
            each = CHUNKS * CHUNK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(total.reshape(-1).view(np.int64)),
                    pa.array(np.tile(np.repeat(np.arange(CHUNKS, dtype=np.int32), CHUNK), len(values))),
                    pa.array(np.repeat(batch.column("set").to_numpy(), each)),
                    pa.array(np.repeat(batch.column(extra).to_numpy(), each)),
                ],
                schema=schema,
            )

    return sets.select("set", "signature", extra).mapInArrow(run, f"entry long, chunk int, set long, {extra} long")


def close(sketch_a: np.ndarray, sketch_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs of rows are near enough, in size and sketch, to be in one group."""
    out = 100 * np.minimum(n_a, n_b) >= SIMILAR_PERCENT * np.maximum(n_a, n_b)
    at = np.flatnonzero(out)
    out[at] = (sketch_a[at] != sketch_b[at]).sum(1) <= CLOSE
    return out


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


class Forest:
    """Joins numbers; keeps the pairs that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int, pair: tuple[int, int]) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.pairs.append(pair)


def star_pairs(sets: DataFrame) -> DataFrame:
    """``(a, b)``: each set with the least member of its entries, where they are close."""
    rows = entries(sets, "n")
    order = F.xxhash64("set", F.col("chunk") % ORDERS)
    centres = rows.groupBy("entry").agg(F.min(F.struct(order.alias("order"), "set")).alias("centre"), F.count("*").alias("rows"))
    centres = centres.where("rows > 1").select("entry", F.col("centre.set").alias("b"))
    pairs = rows.join(centres, "entry").where("set != b").select(F.col("set").alias("a"), "b").distinct()
    left = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sets.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = pa.array(close(_sketches(batch.column("s_a")), _sketches(batch.column("s_b")), n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=schema)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def blocks_of(members: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """Deal the members of groups to tasks: ``task`` (a number per pair of blocks) and ``own`` (the block).

    ``size`` is ``(group, blocks)``. Every two members meet in at least one task.
    """
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.join(size, group).withColumn("own", own).select("*", others)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("task", F.xxhash64(group, low, high)).drop("other", "blocks")


def by_task(df: DataFrame, function, columns: list[str]) -> DataFrame:
    """Apply ``function(table) -> pairs`` to the rows of each task or of several whole tasks; ``(a, b)``."""
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            pairs = np.array(sorted(set(function(table))), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task").to_numpy()
            # The last task may go on in the next batch.
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1 if (task != task[-1]).any() else 0
            if held and (cut or held[-1].column("task")[-1].as_py() != task[0]):
                whole = 0 if held[-1].column("task")[-1].as_py() != task[0] else cut
                yield out(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held, batch, cut = [], batch.slice(whole), cut - whole
            if cut:
                yield out(pa.Table.from_batches([batch.slice(0, cut)]))
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield out(pa.Table.from_batches(held))
        release()

    rows = df.select("task", *columns).repartition("task").sortWithinPartitions("task", "set")
    return rows.mapInArrow(run, "a long, b long").distinct()


def cross_pairs(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``(a, b)``: pairs that join all groups ``(set, part)`` with close sets under one entry.

    A set that isn't in ``parts`` is a group by itself.
    """
    marked = sets.join(parts, "set", "left").withColumn("part", F.coalesce("part", "set"))
    rows = entries(marked, "part")
    several = (
        rows.groupBy("entry")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("rows"))
        .where("low != high")
        .select("entry", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = blocks_of(rows, "entry", several).join(sets.select("set", "n", "sketch"), "set")

    def compare(table: pa.Table) -> list[tuple[int, int]]:
        task, ids, part, n = (table[c].to_numpy() for c in ("task", "set", "part", "n"))
        sketch = _sketches(table["sketch"])
        forest = Forest()
        at = np.arange(len(task))
        # Rows of a task follow each other: compare at distance 1, 2, ... while any task reaches so far.
        for d in range(1, len(task)):
            at = at[at + d < len(task)]
            at = at[task[at] == task[at + d]]
            if not len(at):
                break
            pick = at[part[at] != part[at + d]]
            hit = pick[close(sketch[pick], sketch[pick + d], n[pick], n[pick + d])]
            for i in hit.tolist():
                forest.join(int(part[i]), int(part[i + d]), (int(ids[i]), int(ids[i + d])))
        return forest.pairs

    return by_task(dealt, compare, ["set", "part", "n", "sketch"])


def filter_bits(mark: np.ndarray) -> np.ndarray:
    """Three bit positions per mark (rows)."""
    h = mixed(mark.view(np.uint64))
    return np.stack([(h >> np.uint64(shift)) % np.uint64(FILTER_BITS) for shift in (0, 19, 38)], 1).astype(np.int64)


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """The bits of all wanted marks, put together by Spark; FILTER_BITS of them at any size."""
    schema = arrow_schema("word long, bits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_bits(batch.column("mark").to_numpy()).ravel()
            words, inverse = np.unique(at >> 6, return_inverse=True)
            out = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(out, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(out.view(np.int64))], schema=schema)

    found = wanted.select("mark").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = found.toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def fetch_sets(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``(set, shingles)`` of ``wanted`` sets, from the texts of ``docs`` found by id and text hash.

    A filter of the wanted rows' marks, hashes of both, keeps most other texts from being read into
    shingles; what is joined by id and text hash is a set, not a text.
    """
    mark = F.xxhash64("_key", "text_hash").alias("mark")
    wanted = wanted.select("set", F.col("key").alias("_key"), "text_hash")
    wanted = written(wanted.select("*", mark), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    texts = texts.select("_key", "text_hash", mark, "text")
    ddl = f"_key {texts.schema['_key'].dataType.simpleString()}, text_hash long, shingles binary"
    target = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = filter_bits(batch.column("mark").to_numpy())
            there = ((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            batch = batch.filter(pa.array(there))
            found = [shingles(t).tobytes() for t in as_bytes(batch.column("text"))]
            columns = [batch.column("_key"), batch.column("text_hash"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    read = texts.mapInArrow(run, ddl).alias("read")
    same = F.col("read._key").eqNullSafe(F.col("wanted._key")) & (F.col("read.text_hash") == F.col("wanted.text_hash"))
    found = read.join(wanted.alias("wanted"), same).select("set", "shingles")
    # Repeated rows bring one set several times.
    return found.groupBy("set").agg(F.min("shingles").alias("shingles"))


def links(sets: list[np.ndarray]) -> np.ndarray:
    """All pairs (i, j), i < j, of similar sets."""
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    # Shingles of one set alone intersect nothing; the others are counted by products of 0/1 columns.
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[rows[a:b], column[a:b] - first] = 1
        both += ones @ ones.T
    either = sizes[:, None] + sizes[None, :] - both
    return np.argwhere(np.triu(100 * both >= SIMILAR_PERCENT * either, 1))


def confirmed(docs: DataFrame, sets: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(a, b)``: links between whole sets that join all that are linked inside each group ``(set, part)``."""
    size = groups.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = blocks_of(groups, "part", size)
    whole = fetch_sets(docs, sets.join(groups.select("set"), "set", "left_semi"), key)

    def compare(table: pa.Table) -> list[tuple[int, int]]:
        task, ids = table["task"].to_numpy(), table["set"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        forest = Forest()
        edges = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                for i, j in links(sets[a:b]).tolist():
                    forest.join(ids[a + i], ids[a + j], (ids[a + i], ids[a + j]))
        return forest.pairs

    return by_task(dealt.join(whole, "set"), compare, ["set", "shingles"])


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer ``(a, b)`` that join the same sets: each set and its lesser neighbours are tied to the least of them."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    marked = edges.select(high.alias("a"), low.alias("b")).withColumn("least", F.min("b").over(Window.partitionBy("a")))
    ties = F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))))
    return marked.select(ties.alias("tie")).select("tie.a", "tie.b").where("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(set, part)`` of every set with an edge; ``part`` is the least set it reaches.

    The edges are thinned first: members of a large group have many neighbours in common, and what is left of
    it is little more than one edge a set, most of them to its least one. Then each step takes the least part among a set
    and its neighbours and then the part of that part, until nothing changes; the number of steps grows with the
    logarithm of the longest path.
    """
    edges = checkpointed(thinned(thinned(edges)))
    both = checkpointed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("set", "other").distinct())
    parts = checkpointed(both.groupBy("set").agg(F.min("other").alias("least")).select("set", F.least("set", "least").alias("part")))
    while True:
        near = both.join(parts.toDF("other", "near"), "other").groupBy("set").agg(F.min("near").alias("near"))
        step = parts.join(near, "set").select("set", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        jump = parts.toDF("via", "jump")
        step = checkpointed(
            step.join(jump, step["part"] == jump["via"]).select("set", "old", F.least("part", "jump").alias("part"))
        )
        parts = step.select("set", "part")
        if step.where("part != old").isEmpty():
            return parts


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component_id, kept, text_hash)`` of every row of ``docs``."""
    described = written(describe_sets(docs, key).withColumn("row", F.monotonically_increasing_id()), "described")
    sets = distinct_sets(described)
    near = connected(star_pairs(sets))
    more = cross_pairs(sets, near)
    groups = connected(near.where("set != part").toDF("a", "b").union(more))
    parts = connected(confirmed(docs, sets, groups, key))
    whole = sets.join(parts, "set", "left").select("digest", F.coalesce("part", "set").alias("part"), "key", "set")
    least = whole.groupBy("part").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "set")).alias("least")
    )
    named = whole.join(least, "part").select(
        "digest", F.col("least.key").alias("component"), (F.col("set") == F.col("least.set")).alias("first")
    )
    # One row stands for each component: of the first set's rows with the component's id, the first one.
    rows = described.select("row", "key", "n", "digest", "text_hash")
    marks = (
        rows.where("n > 0")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("mark"))
        .select("digest", F.col("mark.row").alias("mark"))
    )
    named = named.join(marks, "digest").select("digest", "component", F.when(F.col("first"), F.col("mark")).alias("mark"))
    empty = F.col("digest").isNull()
    return rows.join(named, "digest", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("key")).otherwise(F.col("component")).alias("component_id"),
        (empty | F.coalesce(F.col("row") == F.col("mark"), F.lit(False))).alias("kept"),
        "text_hash",
    )


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their own columns, that stand for their components.

    Rows without words are all kept. Of rows that repeat id and text one is kept.
    """
    kept = near_duplicates(docs, key).where("kept and n_shingles > 0")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    # A name that no column of the caller's has.
    mark = next(n for n in (f"_text_hash_{i}" for i in count()) if n not in docs.columns)
    marked = docs.withColumn(mark, F.xxhash64("text"))
    picked = kept.select(F.col(key).alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).alias("kept")
    same = F.col(f"docs.`{key}`").eqNullSafe(F.col("kept._kept_id")) & (F.col(f"docs.`{mark}`") == F.col("kept._kept_hash"))
    one = (
        marked.where(~wordless)
        .alias("docs")
        .join(picked, same, "left_semi")
        .dropDuplicates([key, mark])
        .drop(mark)
    )
    return docs.where(wordless).unionByName(one)
