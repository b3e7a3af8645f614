"""Document fingerprints: a quartile digest of hashed byte triplets, and its likeness.

Every window of five bytes contributes three triplets (its first byte with two of the next
four); each is hashed into one of ``BUCKETS`` counters. A digest has two bits per bucket, the
quartile of its count among the text's own counts, and the logarithm of the length, so equal
texts have equal digests. Two digests differ by the distance of their quartiles (opposite ends count ``FAR``),
plus the distance of their length steps up to ``LENGTH_MOST``; the likeness is 1 minus that
difference over ``BOUND``, never below 0. ``BOUND`` is the difference that independent digests have on average.

``neighbour_report`` compares each document with the next one by ascending id, and with an
edited text. Rows are dealt by id ranges, whose cuts are ids of the table itself; a row that
opens a range is also sent to the range before, so that each task sees the successor of its last
row. Texts move once, no window spans the table, and no text reaches the driver.

Null text counts as empty. Texts below three bytes have no triplet and differ by their length
step only; a prefix of the bytes' crc32 keeps unequal ones apart. Null ids come first; rows with one
id follow each other by text. A single row is its own successor; an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import arrow_schema, map_batches

BUCKETS = 256
FAR = 6
LENGTH_MOST = 64
#: Mean difference of two independent quartiles (3/8 at distance 1, 1/4 at 2, 1/8 at the far ends) per bucket.
BOUND = BUCKETS * (3 / 8 + 2 / 4 + FAR / 8)
#: The other two bytes of a triplet, counted from the first.
TRIPLETS = ((1, 2), (1, 3), (2, 4))
SHORT = 3
_DISTANCE = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])
_DISTANCE[0, 3] = _DISTANCE[3, 0] = FAR


def quartiles(text: bytes) -> np.ndarray:
    """The quartile 0 to 3 of each bucket's count."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for i, (a, b) in enumerate(TRIPLETS):
        n = len(data) - b
        if n <= 0:
            continue
        h = data[:n] * np.uint32(0x9E3779B1) + data[a : a + n] * np.uint32(0x85EBCA77)
        h += data[b : b + n] * np.uint32(0xC2B2AE3D) + np.uint32(i * 0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    ordered = np.sort(counts)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, None] > cuts[None, :]).sum(1).astype(np.uint8)


def length_step(n: int) -> int:
    """Steps of a tenth of a doubling."""
    return round(10 * math.log2(1 + n))


def fingerprint(text: bytes) -> str:
    """``<length step, 4 hex digits>-<crc32 of a short text, else 0>-<128 hex digits of quartiles>``."""
    q = quartiles(text)
    packed = (q[0::4] << 6 | q[1::4] << 4 | q[2::4] << 2 | q[3::4]).astype(np.uint8).tobytes()
    short = crc32(text) if len(text) < SHORT else 0
    return f"{length_step(len(text)):04x}-{short:x}-{packed.hex()}"


def unpack(digest: str) -> tuple[int, str, np.ndarray]:
    step, short, packed = digest.split("-")
    data = np.frombuffer(bytes.fromhex(packed), np.uint8)
    q = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1).ravel()
    return int(step, 16), short, q


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal digests."""
    if a == b:
        return 1.0
    (la, sa, qa), (lb, sb, qb) = unpack(a), unpack(b)
    difference = int(_DISTANCE[qa, qb].sum()) + min(LENGTH_MOST, abs(la - lb)) + (sa != sb)
    return max(0.0, 1.0 - difference / BOUND)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint)`` of every whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        return {"key": batch.column("key"), "fingerprint": [fingerprint(t or b"") for t in texts]}

    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """``(part, key, opens, text)``: rows in id order inside each partition, every range followed by
    the opening row(s) of the next one (``opens`` true), the last range by the first row of all.

    ``ranges`` defaults to the session's number of shuffle partitions.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = -(1 << 63)
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(key).cast("long"), F.lit(first)).alias("order"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    bounds = rows.agg(F.min("order").alias("least"), F.percentile_approx("order", shares, 10_000).alias("cuts")).first()
    least = bounds["least"]
    # Cuts are values of the table; the least value opens range 0.
    cuts = sorted({c for c in bounds["cuts"] or [] if c > least}) if least is not None else []
    table = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    opening = F.array_position(table, F.col("order")).cast("int")
    last = len(cuts)
    # The range of a row is the number of cuts up to its id: a search in a small constant array.
    at = F.when(opening > 0, opening).otherwise(_cuts_below(F.col("order"), cuts))
    back = F.when(opening > 0, opening - 1).when(F.col("order") == F.lit(least or 0), F.lit(last))
    sent = F.array(
        F.struct(at.alias("part"), F.lit(False).alias("opens")), F.struct(back.alias("part"), F.lit(True).alias("opens"))
    )
    return (
        rows.select("key", "order", "text", F.explode(F.filter(sent, lambda s: s["part"].isNotNull())).alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.opens").alias("opens"), "key", "order", "text")
        .repartitionById(last + 1, "part")
        # A single range holds its own opening row twice; the copy comes last.
        .sortWithinPartitions("part", "opens", "order", "text")
        .select("part", "opens", "key", "text")
    )


def _cuts_below(order, cuts: list[int]):
    """Number of ``cuts`` not above ``order``, as nested halvings of the constant list."""
    if not cuts:
        return F.lit(0)

    def search(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order >= cuts[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))


def neighbour_report(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )

    target = arrow_schema(schema)

    def row(key: int | None, text: str, own: str, following: str, other: str) -> tuple:
        changed = edited(text, following).encode()
        mark = fingerprint(changed)
        return key, len(text), hashlib.sha256(changed).hexdigest(), own, mark, likeness(own, mark), likeness(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, str] | None = None
        ended = False
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("opens", "key", "text"))
            for opens, k, t in zip(*columns, strict=True):
                # Of several rows that open the next range only the first one follows.
                if ended:
                    continue
                mark = fingerprint(t.encode())
                if held is not None:
                    out.append(row(*held, t, mark))
                ended = opens
                held = (k, t, mark)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target
                )

    return with_successor(docs, key, text, ranges).mapInArrow(run, schema).withColumnRenamed("key", key)
