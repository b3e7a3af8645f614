"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The ranks are written straight into a sentencepiece BPE model: piece ``i`` is the token of
rank ``i`` with every byte mapped to one printable character, its score is ``-i``, and the
normaliser is the identity. Merging the best-scored pair first is then merging by rank. Each
match of the split pattern is encoded by itself, as in byte-level BPE; a match that is a token
as a whole keeps that id. Decoding maps ids back to pieces and pieces back to bytes.

Null text counts as empty; an empty text has no ids and decodes to no bytes. Texts of any
length are encoded whole; repeated rows are encoded each by themselves. A table without rows
gives none. Only the id and text columns are read, so other columns of any name are harmless.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import map_batches

#: White space as Unicode defines it (``str.isspace`` also has four control characters).
SPACE = "".join(
    map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
#: Chunks that end where a match of the split pattern must end.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks longer than this are encoded but not remembered; the memory is emptied when full.
MEMORY_CHARS, MEMORY_CHUNKS = 64, 400_000
UNKNOWN, BPE, PIECE_NORMAL = 2, 2, 1


def byte_characters() -> list[str]:
    """One printable character per byte: itself where printable, else from 256 upwards."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a tiktoken rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes | int | float) -> bytes:
    if isinstance(body, float):
        return _varint(number << 3 | 5) + struct.pack("<f", body)
    if isinstance(body, int):
        return _varint(number << 3) + _varint(body)
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces, then a trainer and an identity normaliser spec."""
    letters = byte_characters()
    pieces = [
        _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, PIECE_NORMAL)
        for i, t in enumerate(tokens)
    ]
    # The unknown piece comes last, so that ids are ranks.
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in one worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        self.byte_of = {c: b for b, c in self.letters.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        # ``\s`` of the pattern is the Unicode property.
        self.split = regex.compile(
            pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        )
        self.memory: dict[str, bytes] = {}
        table = [bytes(map(self.byte_of.__getitem__, self.model.id_to_piece(i))) for i in range(len(tokens))]
        self.table = table

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as little-endian unsigned 32-bit integers."""
        out = []
        for match in self.split.findall(chunk):
            raw = match.encode()
            whole = self.rank.get(raw)
            if whole is None:
                mapped = raw.decode("latin-1").translate(self.letters)
                whole = np.array(self.model.encode(mapped), "<u4").tobytes()
            out.append(whole)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        chunks = CHUNK.findall(text)
        memory = self.memory
        for c in set(chunks).difference(memory):
            if len(c) <= MEMORY_CHARS:
                memory[c] = self.chunk(c)
        ids = b"".join([memory[c] if c in memory else self.chunk(c) for c in chunks])
        if len(memory) > MEMORY_CHUNKS:
            memory.clear()
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids binary, n_tokens)``: ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file every executor can open; ``pattern`` splits texts before merging.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        work = codec(path, pattern)
        ids = [work.encode(t) for t in batch.column("text").to_pylist()]
        return {"key": batch.column("key"), "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    kind = rows.schema["key"].dataType.simpleString()
    out = map_batches(rows, run, f"key {kind}, ids binary, n_tokens long")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) beside the columns of an encoded table; null ids count as none."""
    # A name that no column of the caller's has.
    read = next(n for n in (f"_ids_{i}" for i in itertools.count()) if n not in df.columns)
    rows = df.withColumn(read, F.coalesce(F.col(ids), F.lit(b"")))
    names = [f.name for f in df.schema]

    def run(batch: pa.RecordBatch) -> dict:
        work = codec(path, pattern)
        out = {n: batch.column(n) for n in names}
        out["decoded"] = [work.decode(x) for x in batch.column(read).to_pylist()]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(rows, run, f"{schema}, decoded binary", read)
