"""N-grams of Arrow batches as numbers: what ``vocab`` counts and looks up inside a task.

The words of a slice of rows become codes, an n-gram is a code made of the code of its first n - 1 words and
of its last word, and only the distinct n-grams of a slice are ever written out as strings. A row is an array of
words, or a string, whose words are its characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a slice; a longer row is a slice of its own.
SLICE = 1 << 20
#: Keys below this bound are told apart by a table instead of a sort.
TABLE = 1 << 23


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE`` words."""
    cells = batch.column(column)
    length = pc.utf8_length if pa.types.is_string(cells.type) else pc.list_value_length
    ends = np.cumsum(pc.fill_null(length(cells), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (0 <= key < bound) in order, and the place of each key among them."""
    if bound > TABLE:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(bound, bool)
    there[keys] = True
    found = np.flatnonzero(there)
    place = np.zeros(bound, np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys]


def _coded(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    encoded = strings.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Grams:
    """The n-grams of one length: where they begin (places in the slice), their codes and the strings of the codes."""

    at: np.ndarray
    codes: np.ndarray
    terms: pa.Array

    def only(self, wanted: np.ndarray) -> Grams:
        """Those whose code is marked in ``wanted``."""
        kept = wanted[self.codes]
        return Grams(self.at[kept], self.codes[kept], self.terms)


class Slice:
    """The words of a run of rows."""

    def __init__(self, cells: pa.Array):
        if pa.types.is_string(cells.type):
            lengths = pc.fill_null(pc.utf8_length(cells), 0).to_numpy(zero_copy_only=False)
            text = "".join(t for t in cells.to_pylist() if t is not None)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            found, codes = distinct(points, 0x110000)
            terms = pa.array([chr(p) for p in found.tolist()], pa.string())
            known = np.ones(len(codes), bool)
        else:
            lengths = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(cells)
            known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            terms, codes = _coded(pc.fill_null(flat, "") if flat.null_count else flat)
        self.rows = len(cells)
        self.row = np.repeat(np.arange(self.rows), lengths)
        self.codes, self.terms, self.known = codes, terms, known

    def words(self) -> Grams:
        at = np.flatnonzero(self.known)
        return Grams(at, self.codes[at], self.terms)

    def longer(self, grams: Grams, n: int, separator: str, both: bool = True) -> Grams:
        """The n-grams whose first n - 1 words, and with ``both`` also whose last ones, are among ``grams``."""
        code = np.full(len(self.codes) + 1, -1, np.int64)
        code[grams.at] = grams.codes
        at, last = grams.at, grams.at + n - 1
        inside = last < len(self.codes)
        at, last = at[inside], last[inside]
        good = (self.row[at] == self.row[last]) & self.known[last]
        if both:
            good &= code[at + 1] >= 0
        at, last = at[good], last[good]
        width = max(len(self.terms), 1)
        keys, place = distinct(code[at] * width + self.codes[last], max(len(grams.terms), 1) * width)
        strings = pc.binary_join_element_wise(grams.terms.take(pa.array(keys // width)), self.terms.take(pa.array(keys % width)), separator)
        # Words that hold the separator can make one string in two ways.
        terms, merged = _coded(strings)
        return Grams(at, merged[place], terms)

    def by_row(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, code, tf)`` of every distinct n-gram of every row, in order."""
        width = max(len(grams.terms), 1)
        keys, counts = np.unique(self.row[grams.at] * width + grams.codes, return_counts=True)
        return keys // width, keys % width, counts


# --- the map of frequent parts -------------------------------------------------------------------


def places(terms: pa.Array, bits: int) -> np.ndarray:
    """The bit of every term in a map of ``bits`` bits."""
    values = np.array(terms.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    return (hashed % np.uint64(bits)).astype(np.int64)


def marked(terms: pa.Array, words: np.ndarray) -> np.ndarray:
    """Whether a map (64 bits to a number) holds the terms."""
    at = places(terms, 64 * len(words))
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def map_task(bits: int) -> Callable:
    """Terms to ``(word, bits)``, partial numbers of the map."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column("term"), bits))
            values = np.left_shift(np.int64(1), at & 63)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(values)], names=["word", "bits"])

    return task


# --- tasks ---------------------------------------------------------------------------------------


def count_task(column: str, n: int, low: int, separator: str, maps) -> Callable:
    """Rows to partial ``(term, tf, df)`` of the n-grams of length ``n`` whose parts the maps of all shorter lengths hold.

    ``maps`` is a broadcast list with an entry for each length from ``low`` on; lengths below have no map.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                rows = Slice(part.column(column))
                grams = rows.words()
                for m in range(1, n):
                    if m >= low:
                        grams = grams.only(marked(grams.terms, maps.value[m - low]))
                    grams = rows.longer(grams, m + 1, separator)
                size = len(grams.terms)
                _, code, _ = rows.by_row(grams)
                tf, df = np.bincount(grams.codes, minlength=size), np.bincount(code, minlength=size)
                there = tf > 0
                terms = grams.terms.filter(pa.array(there))
                yield pa.RecordBatch.from_arrays([terms, pa.array(tf[there]), pa.array(df[there])], names=["term", "tf", "df"])

    return task


def prefixes(terms: Sequence[str], separator: str) -> list[str]:
    """Every beginning of a term that can be a shorter n-gram of its words."""
    found = set()
    for term in terms:
        if separator == "":
            found.update(term[:i] for i in range(1, len(term)))
        else:
            i = term.find(separator)
            while i >= 0:
                found.add(term[:i])
                i = term.find(separator, i + 1)
    return sorted(found)


def lookup_task(column: str, low: int, high: int, separator: str, known, sublinear: bool = False) -> Callable:
    """Rows to ``(_key, _places, _values, _square)``: which terms of a list a row holds, and how often.

    ``known`` is broadcast: the list of terms, their ``prefixes`` and, if values are to be tf-idf weights, their idf.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, beginnings = (pa.array(x, pa.string()) for x in known.value[:2])
        idf = known.value[2]
        width = max(len(terms), 1)
        for batch in batches:
            for part in slices(batch, column):
                rows = Slice(part.column(column))
                grams, found = rows.words(), []
                for n in range(1, high + 1):
                    if n > 1:
                        begun = pc.is_in(grams.terms, beginnings).to_numpy(zero_copy_only=False)
                        grams = rows.longer(grams.only(begun), n, separator, both=False)
                    if n >= low:
                        place = pc.fill_null(pc.index_in(grams.terms, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                        own = grams.only(place >= 0)
                        found.append(rows.row[own.at] * width + place[own.codes])
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                row, place = keys // width, keys % width
                values = counts.astype(np.float64)
                if idf is not None:
                    values = (1 + np.log(values) if sublinear else values) * idf[place]
                ends = pa.array(np.searchsorted(row, np.arange(rows.rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), values)]
                squares = pa.array(np.bincount(row, values * values, rows.rows).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("_key"), *lists, squares], names=["_key", "_places", "_values", "_square"])

    return task
