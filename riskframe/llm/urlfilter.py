"""URL verdicts by host rules and by a Bloom filter cascade over the corpus's own hosts.

Level 0 of the cascade holds the listed keys, level 1 the other keys of the universe that level
0 lets through, level 2 the listed keys that level 1 lets through, and so on until a level lets
nothing wrong through. A key of the universe is listed if and only if the first level that
rejects it is an odd one. The universe is every distinct host of the table, so membership is
exact, and each url is judged by probing bits, without a join.

Bits come from ``xxhash64`` with the level as seed, computed by Spark; a level is gathered as
(word, bits) pairs that Spark combines by ``bit_or``. A level has about ``BITS_PER_KEY`` bits
per key it encodes, so what is broadcast follows the *list* (and the few errors of each level),
not the corpus; a list that would need more than ``MAX_LEVEL_BITS`` is refused.

A null url, or one without ``://``, has an empty host and path: no rule fits, and it is allowed
unless the empty host is listed. Repeated rows are judged alike; an empty table or an empty list gives a
cascade without levels, which lists nothing. Other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import LOWER, UPPER
from riskframe.session import checkpointed

BITS_PER_KEY = 10
PROBES = 7
MAX_LEVEL_BITS = 1 << 31
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER.decode(), LOWER.decode())
    return host, F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _pair(key: Column, level: int | Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key for a level."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.xxhash64(key, level), F.xxhash64(level, key)


def _positions(key: Column, level: int, bits: int) -> Column:
    a, b = _pair(key, level)
    # Double hashing: probe i is a + i * b, and the second hash is made odd.
    odd = b.bitwiseOR(F.lit(1))
    return F.array(
        *[F.pmod(F.shiftrightunsigned(a, 8) + F.lit(i) * F.shiftrightunsigned(odd, 8), F.lit(bits)) for i in range(PROBES)]
    )


@dataclass
class Cascade:
    """Levels of bits as arrays of 64-bit words."""

    levels: list[np.ndarray]

    def holds(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Add boolean ``name``: whether ``key`` (of the universe) is listed. Nulls are not."""
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        shared = df.sparkSession.sparkContext.broadcast(self.levels)

        @F.arrow_udf("boolean")
        def probe(positions: pa.Array) -> pa.Array:
            flat = positions.flatten().to_numpy(zero_copy_only=False).reshape(len(positions), len(shared.value), PROBES)
            first = np.full(len(positions), len(shared.value))
            for i in reversed(range(len(shared.value))):
                at = flat[:, i, :]
                words = shared.value[i][at >> 6]
                there = ((words >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                first = np.where(there, first, i)
            return pa.array(first % 2 == 1)

        filled = F.coalesce(F.col(key), F.lit(""))
        positions = F.flatten(
            F.array(*[_positions(filled, i, len(level) * 64) for i, level in enumerate(self.levels)])
        )
        return df.withColumn(name, F.col(key).isNotNull() & probe(positions))


def _level(keys: DataFrame, level: int, size: int) -> np.ndarray:
    """The bits of one level, combined by Spark and at most MAX_LEVEL_BITS large."""
    words = max(1, math.ceil(size * BITS_PER_KEY / 64))
    if words * 64 > MAX_LEVEL_BITS:
        raise ValueError("the list is too long to broadcast its filter")
    bit = F.explode(_positions(F.col("key"), level, words * 64)).alias("bit")
    pairs = (
        keys.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(words, np.uint64)
    out[pairs["word"].to_numpy(np.int64)] = pairs["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def build_cascade(universe: DataFrame, key: str, listed: Column) -> Cascade:
    """The cascade of the keys of ``universe`` for which ``listed`` holds.

    ``universe`` may repeat keys; null keys are left out.
    """
    keys = checkpointed(
        universe.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.coalesce(listed, F.lit(False)).alias("listed"))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    cascade = Cascade([])
    # Keys that the level so far let through, on either side; every level swaps the sides.
    inside, outside = keys.where("listed"), keys.where("not listed")
    for level in range(MAX_LEVELS):
        size = inside.count()
        if not size:
            return cascade
        cascade.levels.append(_level(inside, level, size))
        probe = Cascade([cascade.levels[-1]])
        inside, outside = checkpointed(_through(outside, probe, level)), inside
    raise RuntimeError("the cascade does not end")


def _through(keys: DataFrame, probe: Cascade, level: int) -> DataFrame:
    """Keys that one level lets through."""
    shared = keys.sparkSession.sparkContext.broadcast(probe.levels[0])

    @F.arrow_udf("boolean")
    def there(positions: pa.Array) -> pa.Array:
        at = positions.flatten().to_numpy(zero_copy_only=False).reshape(-1, PROBES)
        bits = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(bits.all(axis=1))

    return keys.where(there(_positions(F.col("key"), level, len(probe.levels[0]) * 64)))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: Column, url: str = "url", key: str = "page_id") -> DataFrame:
    """``(key, host, path, rule, verdict, listed)`` of every row.

    ``listed`` is a condition on column ``host`` that says which hosts of the corpus are on the list.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    cascade = build_cascade(rows, "host", listed)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        cascade.holds(rows, "host", "listed")
        .select(
            F.col("_key").alias(key),
            "host",
            "path",
            name.alias("rule"),
            F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
            "listed",
        )
    )
