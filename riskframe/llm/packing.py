"""Packing of tokenised documents into sequences of a fixed window.

A document's ids are cut into full windows, which are sequences of their own, and one rest. The
rests are packed by their lengths: ``combinations`` enumerates every way to fill the window
exactly with two or three of the lengths that occur; ``solve`` finds how often to repeat each by
non-negative least squares against the histogram of lengths; ``rounded`` makes the counts whole
and keeps them within what the histogram holds. Rests the plan leaves over are packed greedily:
laid end to end and cut where a window is full, and the last, partly filled window is cut into
sequences whose lengths are powers of two, which need no padding. Nothing is padded, and every
id lies in exactly one piece.

What the driver holds is the histogram (``window - 1`` numbers) and the plan, whose size the
window bounds (below ``window ** 2 / 12 + window`` combinations of up to three lengths). Ranks
within a length and running sums come from ``running_totals`` with the scan's partitions as
buckets, so a length that most documents share stays spread. The ids are written once to the
shared folder and joined once with the assignments, one row per document.

Null text counts as empty: its only id is the end mark. Texts of any length are tokenised whole.
Repeated rows, also of one id, are packed each by themselves; null ids stay null. An empty table
gives no pieces. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from riskframe.llm.common import arrow_schema, map_batches, worker_memory
from riskframe.operators.rank import running_totals
from riskframe.session import checkpointed, scratch_path

WINDOW = 2048
END_ID = 1
MEMORY_CHARS, MEMORY_WORDS = 40, 150_000
JOINED_WORDS = 400
#: Letters that neither case nor normal form changes beyond themselves, then ASCII marks: two pre-tokens, or one.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
#: Marks that compose with letters; elsewhere A-Z may be lower-cased before the tokenizer does.
COMBINING = re.compile("[" + chr(0x300) + "-" + chr(0x36F) + "]")


# --- ids ---------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that words can be encoded by themselves."""

    def __init__(self, path: str, end_id: int, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # For plain words that are lower-cased and cut already: no normal form, no pattern.
        self.quick = Tokenizer.from_file(path)
        self.quick.encode_special_tokens = True
        self.quick.normalizer = None
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        # With ``special``: what the tokenizer takes for a token of its own, wherever it stands in a text.
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self.literals = [t.content.lower() for t in added]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max([*vocabulary.values(), end_id]) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([end_id], self.kind).tobytes()
        # Two generations: what is used again moves to the young one, so frequent words stay.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # A text without the common start of the literals holds none of them.
        self.start = os.path.commonprefix(self.literals)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def whole_ids(self, text: str) -> bytes:
        """Ids of a text with special tokens in it, as the tokenizer gives them unless told otherwise."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self.ids(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def plain_ids(self, words: list[str], pieces: list[int]) -> Iterator[bytes]:
        """Ids of words of so many pre-tokens, set apart by spaces; encoded together and cut at the ids that end a pre-token."""
        for i in range(0, len(words), JOINED_WORDS):
            text = " ".join(words[i : i + JOINED_WORDS]).lower()
            joined = self.quick.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(joined[0].ids, self.kind)
            last = np.flatnonzero(self.ends[ids])[np.cumsum(pieces[i : i + JOINED_WORDS]) - 1]
            raw, a = ids.tobytes(), 0
            for b in ((last + 1) * ids.itemsize).tolist():
                yield raw[a:b]
                a = b

    def fresh_ids(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words without white space, those of plain letters and marks many at a time."""
        plain, apart, pieces, rest = [], [], [], []
        for w in words:
            m = PLAIN.fullmatch(w)
            if m and w:
                cut = m.end(1)
                both = 0 < cut < len(w)
                plain.append(w)
                apart.append(f"{w[:cut]} {w[cut:]}" if both else w)
                pieces.append(1 + both)
            else:
                rest.append(w)
        yield from zip(plain, self.plain_ids(apart, pieces), strict=True)
        for w, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            yield w, np.array(found.ids, self.kind).tobytes()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. All but very long ones are remembered."""
        if len(self.young) > MEMORY_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [w for w in words if w not in young]
        known = {w: old[w] for w in missing if w in old}
        young.update(known)
        long = {}
        for w, ids in self.fresh_ids([w for w in missing if w not in known]):
            (young if len(w) <= MEMORY_CHARS else long)[w] = ids
        return [young[w] if w in young else long[w] for w in words]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids with the end mark, as unsigned integers of ``kind``.

        The words of all texts are split and told apart by Arrow; each distinct one is encoded once.
        """
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        column = pc.fill_null(column, "")
        whole = {}
        if self.literals:
            for k in np.flatnonzero(pc.match_substring(column, self.start, ignore_case=True).to_numpy(False)).tolist():
                text = column[k].as_py()
                if any(x in text.lower() for x in self.literals):
                    whole[k] = self.whole_ids(text) + self.end
        lowered = pc.ascii_lower(column)
        wide = np.flatnonzero(~pc.string_is_ascii(column).to_numpy(False)).tolist()
        kept = [k for k in wide if k not in whole and COMBINING.search(column[k].as_py())]
        if kept or whole:
            mask = np.zeros(len(column), bool)
            mask[kept + list(whole)] = True
            instead = pa.array(["" if k in whole else column[k].as_py() for k in np.flatnonzero(mask).tolist()], pa.string())
            lowered = pc.replace_with_mask(lowered, pa.array(mask), instead)
        words = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        raw = self.word_ids(coded.dictionary.to_pylist())
        width = len(self.end)
        sizes = np.array([len(x) for x in raw], np.int64) // width
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), np.frombuffer(b"".join(raw), self.kind))
        ids = lists.take(coded.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])]
        cuts = ends[words.offsets.to_numpy()].tolist()
        return [
            whole[k] if k in whole else ids[a:b].tobytes() + self.end
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        ]


def encoder(path: str, end_id: int) -> WordEncoder:
    return worker_memory(("packing", path, end_id), lambda: WordEncoder(path, end_id, special=True))


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """``(row, key, n, ids, width)``, written to the shared folder; ``row`` numbers the rows.

    ``ids`` holds ``n`` little-endian unsigned integers of ``width`` bytes.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        work = encoder(path, end_id)
        ids = work.encode(batch.column("text"))
        width = np.dtype(work.kind).itemsize
        return {
            "row": batch.column("row"),
            "key": batch.column("key"),
            "n": [len(x) // width for x in ids],
            "ids": ids,
            "width": [width] * len(ids),
        }

    target = scratch_path(docs.sparkSession, "ids")
    map_batches(rows, run, f"row long, key {kind}, n long, ids binary, width int").write.parquet(target)
    return docs.sparkSession.read.parquet(target).withColumnRenamed("key", key)


# --- the plan ----------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Every ascending pair and triple of ``lengths`` that sums to ``window``; pairs begin with 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    found = [np.zeros((0, 3), np.int64)]
    for a in range(window // 3 + 1):
        if not there[a]:
            continue
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        c = window - a - b
        keep = there[b] & there[c] & (c < window)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found)


def solve(parts: np.ndarray, histogram: np.ndarray, rounds: int = 60, chosen: int = 512) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|A x - histogram|``; A counts the lengths in each combination.

    Coordinate descent on a working set: each round adds the combinations of steepest descent to
    those in use and minimises exactly along one after the other, never below zero.
    """
    x = np.zeros(len(parts))
    if not len(parts):
        return x
    residual = histogram.astype(np.float64)
    residual[0] = 0.0
    # Squared norms: a length that occurs m times in a combination adds m ** 2.
    norm = np.array([(parts[:, :, None] == parts[:, None, :])[:, i].sum(1) * (parts[:, i] > 0) for i in range(3)]).sum(0)
    rows = parts.tolist()
    for _ in range(rounds):
        slope = residual[parts].sum(1)
        best = np.argpartition(-slope / norm, min(chosen, len(parts) - 1))[:chosen]
        work = np.union1d(best[slope[best] > 0.5], np.flatnonzero(x))
        if not len(work):
            break
        values, r = x[work].tolist(), residual.tolist()
        for k, (s, n) in enumerate(zip(work.tolist(), norm[work].tolist(), strict=True)):
            a, b, c = rows[s]
            step = max(-values[k], (r[a] + r[b] + r[c]) / n)
            values[k] += step
            r[a] -= step
            r[b] -= step
            r[c] -= step
            r[0] = 0.0
        x[work] = values
        residual = np.array(r)
    return x


def rounded(parts: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts near ``x`` that use no length more often than it occurs."""
    left = histogram.astype(np.int64).tolist()
    out = np.zeros(len(parts), np.int64)
    for s in sorted(np.flatnonzero(x >= 0.5).tolist(), key=lambda s: (-x[s], s)):
        need: dict[int, int] = {}
        for length in parts[s].tolist():
            if length:
                need[length] = need.get(length, 0) + 1
        out[s] = min(int(x[s] + 0.5), *(left[n] // m for n, m in need.items()))
        for n, m in need.items():
            left[n] -= m * int(out[s])
    return out


@dataclass(frozen=True)
class Plan:
    """Which sequence and offset the i-th rest of a length takes.

    Entry j covers the ranks of one length from ``start[j]`` on, ``each[j]`` of them per sequence.
    """

    window: int
    key: np.ndarray  # length * SPAN + first rank, ascending
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    planned: np.ndarray  # per length: how many rests the plan takes
    sequences: int

    SPAN = 1 << 44

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset by length and rank (from 0); -1 where the plan has no place."""
        inside = rank < self.planned[length]
        at = np.searchsorted(self.key, length * self.SPAN + rank, side="right") - 1
        at = np.where(inside, at, 0)
        if not len(self.key):
            return np.full(len(length), -1), np.full(len(length), -1)
        behind = length * self.SPAN + rank - self.key[at]
        sequence = self.sequence[at] + behind // self.each[at]
        offset = self.offset[at] + behind % self.each[at] * length
        return np.where(inside, sequence, -1), np.where(inside, offset, -1)


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """The plan for ``histogram[length]`` rests of each length below ``window``."""
    parts = combinations(np.flatnonzero(histogram), window)
    repeats = rounded(parts, solve(parts, histogram), histogram)
    used = np.zeros(window, np.int64)
    entries, sequences = [], 0
    for s in np.flatnonzero(repeats).tolist():
        n, offset = int(repeats[s]), 0
        for length in sorted({p for p in parts[s].tolist() if p}):
            each = parts[s].tolist().count(length)
            entries.append((length * Plan.SPAN + int(used[length]), each, sequences, offset))
            used[length] += n * each
            offset += each * length
        sequences += n
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 4).T
    return Plan(window, *columns, planned=used, sequences=sequences)


def end_cuts(total: int, window: int) -> list[tuple[int, int]]:
    """(begin, length) of the sequences of the last window of ``total`` ids laid end to end: powers of two."""
    begin, left, out = total // window * window, total % window, []
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((begin, size))
        begin, left = begin + size, left - size
    return out


# --- the job -----------------------------------------------------------------------------------


def pack(tokens: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """``(key, start, length, ids, doc_tokens, sequence_id, offset)`` of every piece of a ``tokenise`` table.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    """
    spark = tokens.sparkSession
    sizes = tokens.select(
        "row",
        F.shiftright("row", 33).alias("part"),
        F.expr(f"n div {window}").alias("full"),
        (F.col("n") % window).cast("int").alias("rest"),
    )
    histogram = np.zeros(window, np.int64)
    counts = sizes.groupBy("rest").agg(F.count("*").alias("rows"), F.sum("full").alias("full")).collect()
    for r in counts:
        histogram[r["rest"]] = r["rows"]
    n_full = sum(r["full"] for r in counts)
    histogram[0] = 0
    plan = make_plan(histogram, window)
    left_over = int(((histogram - plan.planned) * np.arange(window)).sum())
    shared = spark.sparkContext.broadcast(plan)

    one = F.lit(1).cast("long")
    ranked = running_totals(
        sizes.where("rest > 0").select("row", "part", "rest"), {"rank": one}, "part", [F.col("row")], by=["rest"]
    )

    def place(batch: pa.RecordBatch) -> dict:
        row, rest, rank = (batch.column(n).to_numpy() for n in ("row", "rest", "rank"))
        sequence, offset = shared.value.place(rest.astype(np.int64), rank - 1)
        return {"row": row, "rest": rest, "sequence": sequence, "offset": offset}

    placed = checkpointed(_map_numbers(ranked.select("row", "rest", "rank"), place, "row long, rest int, sequence long, offset long"))

    loose = running_totals(
        placed.where("sequence < 0").withColumn("part", F.shiftright("row", 33)),
        {"stop": F.col("rest").cast("long")},
        "part",
        [F.col("row")],
    )
    tail = end_cuts(left_over, window)
    base = plan.sequences + n_full
    pieces = loose.select("row", "rest", (F.col("stop") - F.col("rest")).alias("begin")).mapInArrow(
        _cutter(window, base, left_over, tail), "row long, begin long, length int, sequence long, offset long"
    )
    # A rest begins after its document's full windows; ``begin`` counts from there.
    planned = placed.where("sequence >= 0").select(
        "row", F.lit(0).cast("long").alias("begin"), F.col("rest").alias("length"), "sequence", "offset"
    )
    rests = (
        planned.unionByName(pieces)
        .groupBy("row")
        .agg(F.collect_list(F.struct("begin", "length", "sequence", "offset")).alias("rests"))
    )
    windows = running_totals(
        sizes.where("full > 0").select("row", "part", "full"), {"stop": F.col("full")}, "part", [F.col("row")]
    ).select("row", (F.col("stop") - F.col("full") + plan.sequences).alias("first"))
    joined = tokens.join(rests, "row", "left").join(windows, "row", "left")
    kind = tokens.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    target = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, n, ids, width, rests, first in zip(
                *(batch.column(c).to_pylist() for c in ("key", "n", "ids", "width", "rests", "first")), strict=True
            ):
                values = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for j in range(n // window):
                    a = j * window
                    out.append((k, a, window, values[a : a + window].tobytes(), n, first + j, 0))
                for r in rests or []:
                    a = n // window * window + r["begin"]
                    size = r["length"]
                    out.append((k, a, size, values[a : a + size].tobytes(), n, r["sequence"], r["offset"]))
                if len(out) > 4096:
                    yield _batch(out, target)
                    out = []
            if out:
                yield _batch(out, target)

    return (
        joined.select(F.col(key).alias("key"), "n", "ids", "width", "rests", "first")
        .mapInArrow(cut, schema)
        .withColumnRenamed("key", key)
    )


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target
    )


def _map_numbers(df: DataFrame, function, schema: str) -> DataFrame:
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _cutter(window: int, base: int, total: int, tail: list[tuple[int, int]]):
    """Cuts rests laid end to end at the windows' ends, and in the last window at those of ``tail``."""
    schema = arrow_schema("row long, begin long, length int, sequence long, offset long")
    last = total // window * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, rest, begin in zip(*(batch.column(n).to_pylist() for n in ("row", "rest", "begin")), strict=True):
                at, stop = begin, begin + rest
                while at < stop:
                    if at < last:
                        sequence, edge = at // window, at // window * window
                        end = edge + window
                    else:
                        k, (edge, size) = next((k, t) for k, t in enumerate(tail) if t[0] <= at < t[0] + t[1])
                        sequence, end = last // window + k, edge + size
                    size = min(end, stop) - at
                    out.append((row, at - begin, size, base + sequence, at - edge))
                    at += size
            if out:
                yield _batch(out, schema)

    return run
