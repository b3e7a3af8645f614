"""Which tokens of two tokenizers end at the same byte, and how often each pair of ids does so.

Both sides cover a space and the text with bytes: side A is byte-level BPE, side B a sentencepiece model
(which adds the space itself). Byte offsets at which a token of both ends cut the text into groups; the
tokens that end there are linked.

Alignment works on Arrow arrays, a slice of documents at a time: the ids of all its documents are list arrays,
flattened beside the index of their parent; token sizes are looked up and summed up cumulatively, less
the sum before the document; (document, end) makes one key, and an Acero hash join of both sides' keys finds the
common ends. Groups are list arrays over the same flat ids, cut at those ends, and ``binary_join`` writes
them. ``Table.group_by`` counts the pairs of each document; another counts those of each task, and Spark adds up
these partial counts.

Two linked tokens end together, so the bytes of one are the end of the other's. The number of id pairs for
which this holds (``pair_bound``) follows from the vocabularies alone, 324,297 for the ones used here, and
bounds the table of counts, which is sent to every task. Documents themselves are written once, with the counts of
their pairs, and read again to look these up; no text is tokenised twice and nothing of a document is shuffled.

Ids come from the tokenizer libraries by chunks: a chunk ends where a character that is no white space
meets a space or a line break. No token of either side reaches over such a place (``Aligner`` checks the
pieces), so chunks can be encoded by themselves or side by side, cut apart at their bytes, and their ids remembered.

A text that is null or empty, or whose tokens of one side don't add up to its bytes (as with U+2581, which
sentencepiece reads as a space), has no tokens: its counts are 0 and its digest is empty. Texts of any length are
aligned whole; repeated rows count each. Strings of special tokens are plain text. An empty table gives none.
Only the id and text columns are read, so other columns of any name are harmless.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from riskframe.llm.bpe import byte_characters
from riskframe.llm.common import arrow_schema, map_batches
from riskframe.session import scratch_path

#: A space may follow these without ending a chunk: white space by any definition.
ODD_SPACE = "\u180e\u200b\ufeff"
LOOSE = rf"\s{ODD_SPACE}"
CHUNK = re.compile(rf"[ \n]*[^ \n]+(?:(?<=[{LOOSE}])[ \n]+[^ \n]*)*|[ \n]+")
MARK = chr(0x2581)
#: Chunks longer than this are encoded but not remembered; the memory is emptied when full.
MEMORY_CHARS, MEMORY_CHUNKS, MEMORY_IDS = 64, 300_000, 1 << 23
#: Chunks encoded in one call of A's encoder, which has a cost of its own.
GROUP = 32
#: Rows of pair counts a task gathers before it adds them up.
GATHERED = 1 << 20


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE tokenizer file; ids of special tokens have none."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in byte_of for c in token):
            out[i] = bytes(map(byte_of.__getitem__, token))
    return out


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a sentencepiece model with byte fallback; control and unknown pieces have none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
    return out


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs have tokens of which one ends with the other."""
    counts: list[dict[bytes, int]] = []
    for tokens in (a, b):
        counts.append({})
        for t in filter(None, tokens):
            counts[-1][t] = counts[-1].get(t, 0) + 1
    of_a, of_b = counts
    # Equal tokens are met from both sides; count them from A's.
    ends = sum(n * of_b.get(t[k:], 0) for t, n in of_a.items() for k in range(len(t)))
    return ends + sum(n * of_a.get(t[k:], 0) for t, n in of_b.items() for k in range(1, len(t)))


class Encoder:
    """Ids of both sides in one worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), piece_tokens(path_b)
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = map(pa.array, self.sizes)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not self.b.is_byte(i) and re.search(rf"[^{MARK}{LOOSE}][{MARK}\n]", piece):
                raise ValueError(f"piece {piece!r} reaches over the end of a word")
        self.text_a, self.text_b = (pa.array(map(str, range(len(x)))) for x in (self.size_a, self.size_b))
        self.memory = Memory()

    def encode_a(self, chunks: list[str], raw: list[bytes]) -> Ids:
        """A's ids of chunks, ``GROUP`` of them put together: no token reaches over the end of one that others may follow."""
        groups, start = [], 0
        for stop in [*(i + 1 for i, c in enumerate(chunks) if c[-1].isspace() or c[-1] in ODD_SPACE), len(chunks)]:
            groups += ["".join(chunks[i : min(i + GROUP, stop)]) for i in range(start, stop, GROUP)]
            start = stop
        together = Ids.of(self.a.encode_batch_fast(groups, add_special_tokens=False), self.bytes_a, self.sizes[0])
        cut = together.cut_at(np.cumsum([len(x) for x in raw]))
        # Only a tokenizer whose tokens don't add up to the text has ends of chunks inside tokens.
        return cut or Ids.of(self.a.encode_batch_fast(chunks, add_special_tokens=False), self.bytes_a, self.sizes[0])

    def learn(self) -> None:
        """Ids of the chunks that wait in the memory.

        For B, a letter before a chunk takes the space that B adds, and no piece joins it with the chunk.
        """
        memory, chunks = self.memory, self.memory.fresh
        if not chunks:
            return
        raw = [c.encode() for c in chunks]
        of_a = self.encode_a(chunks, raw)
        of_b = Ids.of(self.b.encode(["a" + c for c in chunks], num_threads=1), self.bytes_b, self.sizes[1])
        fits = of_a.spell(raw) & of_b.spell([b" a" + x for x in raw])
        memory.add((of_a, of_b.without_first()), fits)

    def encode(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and of B by text; a text has none where the bytes of one side differ from its own."""
        if self.memory.full():
            self.memory = Memory()
        memory = self.memory
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        places = np.fromiter(map(memory.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self.learn()
        edges = np.r_[0, np.cumsum(counts)]
        bad = np.flatnonzero(~memory.fits[places])
        if len(bad):
            keep = np.ones(len(split), bool)
            keep[np.searchsorted(edges, bad, side="right") - 1] = False
            places = places[np.repeat(keep, counts)]
            edges = np.r_[0, np.cumsum(counts * keep)]
        return memory.lists(0, places, edges), memory.lists(1, places, edges)


class Memory(dict):
    """The place of every chunk met among the ids of each side. Chunks met for the first time wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []
        self.flat = [np.zeros(0, np.int32)] * 2
        self.lengths = [np.zeros(0, np.int64)] * 2
        self.fits = np.zeros(0, bool)

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self.fits) + len(self.fresh)
        self.fresh.append(chunk)
        return place

    def add(self, ids: tuple[Ids, Ids], fits: np.ndarray) -> None:
        """The ids of the chunks in ``fresh``. Long chunks are not remembered for other slices."""
        self.flat = [np.concatenate([x, i.flat]) for x, i in zip(self.flat, ids, strict=True)]
        self.lengths = [np.concatenate([x, i.lengths]) for x, i in zip(self.lengths, ids, strict=True)]
        self.fits = np.concatenate([self.fits, fits])
        for chunk in self.fresh:
            if len(chunk) > MEMORY_CHARS:
                del self[chunk]
        self.fresh = []

    def full(self) -> bool:
        return len(self.fits) > MEMORY_CHUNKS or max(map(len, self.flat)) > MEMORY_IDS

    def lists(self, side: int, places: np.ndarray, edges: np.ndarray) -> pa.ListArray:
        """One side's ids at ``places``, in lists that end at ``edges``."""
        sizes = self.lengths[side]
        offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        flat = pa.ListArray.from_arrays(offsets, self.flat[side]).take(pa.array(places)).flatten()
        ends = np.r_[0, np.cumsum(sizes[places])]
        return pa.ListArray.from_arrays(pa.array(ends[edges], pa.int32()), flat)


@dataclass
class Ids:
    """Ids of a list of texts, in one array; ``tokens`` and ``sizes`` belong to the vocabulary."""

    flat: np.ndarray
    lengths: np.ndarray
    tokens: list[bytes]
    sizes: np.ndarray

    @classmethod
    def of(cls, encoded: list, tokens: list[bytes], sizes: np.ndarray) -> Ids:
        """From what a tokenizer library returns: lists, or objects with a list ``ids``."""
        ids = [getattr(x, "ids", x) for x in encoded]
        lengths = np.array([len(x) for x in ids], np.int64)
        return cls(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths, tokens, sizes)

    def cut_at(self, ends: np.ndarray) -> Ids | None:
        """The same ids as those of texts that end at these bytes; None where an end is not that of a token."""
        sizes = self.sizes[self.flat]
        running = np.cumsum(sizes)
        after = np.searchsorted(running, ends) + 1
        if not len(running) or not sizes.all() or running[-1] != ends[-1] or (running[after - 1] != ends).any():
            return None
        return Ids(self.flat, np.diff(after, prepend=0), self.tokens, self.sizes)

    def spell(self, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each text add up to its bytes."""
        running = np.r_[0, np.cumsum(self.sizes[self.flat])]
        ends = running[np.cumsum(self.lengths)]
        spelled = b"".join(map(self.tokens.__getitem__, self.flat.tolist()))
        if (np.diff(ends, prepend=0) == [len(x) for x in raw]).all() and spelled == b"".join(raw):
            return np.ones(len(raw), bool)
        cuts = np.r_[0, ends].tolist()
        return np.array([spelled[a:b] == x for a, b, x in zip(cuts, cuts[1:], raw)], bool)

    def without_first(self) -> Ids:
        """The ids without the first of each text."""
        firsts = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        return Ids(np.delete(self.flat, firsts), np.maximum(self.lengths - 1, 0), self.tokens, self.sizes)


@functools.lru_cache(maxsize=2)
def encoder(path_a: str, path_b: str) -> Encoder:
    return Encoder(path_a, path_b)


def end_keys(lists: pa.ListArray, sizes: pa.Array) -> pa.Array:
    """One key per token: its document's place in the slice, and the byte at which it ends there."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    running = pc.cumulative_sum(pc.take(sizes, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), running]), lists.offsets.cast(pa.int64()))
    ends = pc.subtract(running, pc.take(before, parent))
    return pc.bit_wise_or(pc.shift_left(parent, pa.scalar(32, pa.int64())), ends)


def common_ends(keys_a: pa.Array, keys_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and B whose keys are equal: all such pairs, by place."""
    left = pa.table({"key": keys_a, "a": pa.array(np.arange(len(keys_a), dtype=np.int32))})
    right = pa.table({"key": keys_b, "b": pa.array(np.arange(len(keys_b), dtype=np.int32))})
    pairs = left.join(right, "key", join_type="inner", use_threads=False)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    order = np.lexsort((b, a))
    return a[order], b[order]


def last_of_key(places: np.ndarray, keys: pa.Array) -> np.ndarray:
    """The last place of each key among ``places`` (tokens without bytes share one)."""
    own = keys.to_numpy()[places]
    return places[np.r_[own[1:] != own[:-1], True]] if len(places) else places


def group_strings(lists: pa.ListArray, cuts: np.ndarray, names: pa.Array) -> pa.Array:
    """The ids of each group, comma-joined. Tokens behind a last cut have no group."""
    groups = pa.ListArray.from_arrays(pa.array(np.r_[0, cuts + 1], pa.int32()), pc.take(names, pc.list_flatten(lists)))
    return pc.binary_join(groups, ",")


@dataclass
class Alignment:
    """What a slice of documents gives; ``pair`` is ``A id * B's vocabulary + B id``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pair_lists: pa.ListArray
    times_lists: pa.ListArray


def align(a: pa.ListArray, b: pa.ListArray, work: Encoder) -> Alignment:
    """Groups, links and pair counts of documents from the ids of both sides."""
    docs = len(a)
    keys_a, keys_b = end_keys(a, work.size_a), end_keys(b, work.size_b)
    at_a, at_b = common_ends(keys_a, keys_b)
    parent = pc.list_parent_indices(a).to_numpy()
    last_b = np.zeros(len(keys_b), bool)
    last_b[last_of_key(at_b, keys_b)] = True
    cuts_a, cuts_b = last_of_key(at_a, keys_a), np.flatnonzero(last_b)
    texts = pc.binary_join_element_wise(
        group_strings(a, cuts_a, work.text_a), group_strings(b, cuts_b, work.text_b), "|"
    )
    n_groups = np.bincount(parent[cuts_a], minlength=docs)
    by_doc = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_groups)], pa.int32()), texts)
    pairs = pc.add(
        pc.multiply(pc.take(pc.list_flatten(a), pa.array(at_a)).cast(pa.int64()), len(work.size_b)),
        pc.take(pc.list_flatten(b), pa.array(at_b)).cast(pa.int64()),
    )
    links = pa.table({"doc": pa.array(parent[at_a].astype(np.int32)), "pair": pairs})
    counted = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    ends = np.cumsum(np.bincount(counted["doc"].to_numpy(), minlength=docs))
    offsets = pa.array(np.r_[0, ends], pa.int32())

    def lists(column: str) -> pa.ListArray:
        flat = counted[column].combine_chunks() if counted.num_rows else pa.array([], pa.int64())
        return pa.ListArray.from_arrays(offsets, flat.cast(pa.int64()))

    return Alignment(
        pc.list_value_length(a).to_numpy(),
        pc.list_value_length(b).to_numpy(),
        n_groups,
        np.bincount(parent[at_a], minlength=docs),
        pc.binary_join(by_doc, ";").to_pylist(),
        lists("pair"),
        lists("count_all"),
    )


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``, written to the shared folder.

    ``pairs`` holds a document's distinct linked id pairs and ``times`` how often each is linked. The digest
    is that of the groups as ``a1,a2|b1;a3|b2,b3``, empty for a document without tokens.
    """
    rows = docs.select(F.col(key).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> dict:
        work = encoder(path_a, path_b)
        found = align(*work.encode(batch.column("text").to_pylist()), work)
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
        return {
            "key": batch.column("key"),
            "n_a": found.n_a,
            "n_b": found.n_b,
            "n_groups": found.n_groups,
            "n_links": found.n_links,
            "groups_sha256": digests,
            "pairs": found.pair_lists,
            "times": found.times_lists,
        }

    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<bigint>, times array<bigint>"
    )
    path = scratch_path(docs.sparkSession, "aligned")
    map_batches(rows, run, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path).withColumnRenamed("key", key)


def _added(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("times", "sum")])
    return summed.rename_columns(["pair", "times"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, times)`` over all documents: each task's partial counts, added up by Spark."""
    schema = arrow_schema("pair long, times long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, waiting = [pa.table({"pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})], 0
        for batch in batches:
            columns = [pc.list_flatten(batch.column(c)).cast(pa.int64()) for c in ("pairs", "times")]
            tables.append(pa.Table.from_arrays(columns, names=["pair", "times"]))
            waiting += len(columns[0])
            if waiting > GATHERED:
                tables, waiting = [_added(tables)], 0
        yield from _added(tables).cast(schema).to_batches(max_chunksize=1 << 16)

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times"))


@dataclass(frozen=True)
class Counts:
    """Corpus counts of linked pairs, ascending by pair; ``best``: no pair of that B id has a higher one."""

    pair: np.ndarray
    times: np.ndarray
    best: np.ndarray

    def sums(self, pairs: pa.ListArray, times: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Links with a best pair, and the sum of all links' counts, by document."""
        flat, n = pc.list_flatten(pairs).to_numpy(), pc.list_flatten(times).to_numpy()
        at = np.searchsorted(self.pair, flat)
        edges = np.r_[0, np.cumsum(pc.list_value_length(pairs).to_numpy())]
        running = [np.r_[0, np.cumsum(x)] for x in (n * self.best[at], n * self.times[at])]
        return running[0][edges[1:]] - running[0][edges[:-1]], running[1][edges[1:]] - running[1][edges[:-1]]


def collect_counts(counts: DataFrame, vocabulary_b: int) -> Counts:
    """At most ``pair_bound`` rows of two numbers come to the driver."""
    table = counts.toArrow().sort_by("pair")
    pair, times = table["pair"].to_numpy(), table["times"].to_numpy()
    highest = np.zeros(vocabulary_b, np.int64)
    np.maximum.at(highest, pair % vocabulary_b, times)
    return Counts(pair, times, times == highest[pair % vocabulary_b])


def report(aligned: DataFrame, path_b: str, key: str = "doc_id") -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of the pairs."""
    spark = aligned.sparkSession
    counts = collect_counts(pair_counts(aligned), len(piece_tokens(path_b)))
    shared = spark.sparkContext.broadcast(counts)
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.withColumnRenamed(key, "key")
    ddl = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", n_best long, count_sum long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, total = shared.value.sums(batch.column("pairs"), batch.column("times"))
            columns = [*(batch.column(n) for n in names), pa.array(best, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl).withColumnRenamed("key", key)
