"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words as the contracts define them; ``bytes.split()`` cuts at the same six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
LETTERS = re.compile(r"[^\W\d_]+")
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


_memory: dict[object, object] = {}


def release() -> None:
    """Give back to the system what Arrow and the C library keep of freed memory; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_memory(name: object, make: Callable):
    """What one operator remembers in a worker, made by ``make``. Another operator's is dropped first.

    Workers outlive stages; without this a pipeline would gather the memories of all its stages.
    """
    if name not in _memory:
        _memory.clear()
        _memory[name] = make()
    return _memory[name]


def id_remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches where their texts exceed ``SLICE_BYTES``; a single row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(
            [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()], np.int64
        )
        group = np.cumsum(sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        for a, b in zip(starts, np.r_[starts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)
    release()


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text"
) -> DataFrame:
    """Apply ``function`` to slices of Arrow batches; it returns columns in the order of ``schema``."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = function(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                    for f in target
                ],
                schema=target,
            )

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts ``keep`` keeps, whole, a slice of an Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(keep(as_bytes(batch.column(text))), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, limit: int, eligible: Column | None = None
) -> DataFrame:
    """``(doc_id, label, text)`` of at most ``limit`` labelled documents, drawn by a hash of the id.

    Labels other than 0 and 1 and null ids are left out; contradicting labels of one
    document count as 0, and a repeated id brings its smallest text. The picked ids
    (at most ``limit`` rows of two numbers) are broadcast, so no text moves unpicked.
    """
    rows = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    if eligible is not None:
        rows = rows.where(eligible)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(log_sigmoid(np.asarray(x, np.float64)))


class Sparse:
    """A bounded sample as sparse rows, for the fits."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        lengths = np.array([len(c) for c in columns], np.int64)
        self.rows = np.repeat(np.arange(len(columns), dtype=np.int32), lengths)
        self.columns = np.concatenate([*columns, np.zeros(0, np.int32)]).astype(np.int32)
        self.values = np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float32)
        self.shape = (len(columns), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.rows], self.shape[1])
