"""Joins of a large table with a lookup table keyed by the join columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskframe.session import checkpointed

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 1e-3
SALTS = 64
# Items the frequency sketch follows. It misjudges a count by at most 3.5 / TRACKED of the rows,
# well below half of HOT_SHARE, so every key above HOT_SHARE is found.
TRACKED = 1 << 15


def measured_bytes(table: DataFrame) -> int:
    """Size of all values of ``table`` as text, found by one aggregate."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    return table.agg(size).first()["size"] or 0


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``df`` with ``table`` (one row per key); ``how`` is ``left`` or ``inner``.

    The table is computed once and measured. Up to ``max_bytes`` it is broadcast
    and ``df`` does not move. Beyond that both sides are shuffled, and keys that
    hold more than ``HOT_SHARE`` of the rows of ``df`` (at most ``1/HOT_SHARE``
    of them exist) are split: their rows in ``df`` get one of ``SALTS`` salts from
    a hash of ``spread_by`` and their single lookup row is repeated once per salt.
    """
    on = list(on)
    table = checkpointed(table)
    if measured_bytes(table) <= max_bytes:
        return df.join(F.broadcast(table), on, how)

    # A hash of the key is enough here: two keys with one hash are both salted.
    key_hash = F.xxhash64(*on)
    # One aggregate of mergeable sketches finds the hot keys and the total. Twice as many keys as can
    # be hot are asked for, and half the share is enough: salting a key too many does no harm.
    found = df.agg(
        F.call_function("approx_top_k", key_hash, F.lit(int(2 / HOT_SHARE)), F.lit(TRACKED)).alias("most"),
        F.count("*").alias("rows"),
    ).first()
    hot = [r["item"] for r in found["most"] or [] if r["count"] > found["rows"] * HOT_SHARE / 2]
    if not hot:
        return df.join(table, on, how)

    row_hash = F.xxhash64(*(spread_by or df.columns))
    is_hot = key_hash.isin(hot)
    salted = df.withColumn(
        "_salt", F.when(is_hot, F.pmod(row_hash, F.lit(SALTS)).cast("int")).otherwise(0)
    )
    repeated = table.withColumn(
        "_salt",
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
