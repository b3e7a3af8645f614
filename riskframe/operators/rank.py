"""Ranks and running totals over a whole table without a single-task window.

A window ordered over a whole table, or over one of two classes, sorts everything
in one task. Here rows first fall into buckets that respect the wanted order.
Bucket sums are small; a running total over them gives each bucket its offset, and
the totals inside a bucket add the rest.

``range_totals`` lets Spark deal the rows by ranges of the order: a partition is a bucket.
Rows move once, the totals inside a partition are summed as it is written, and only the
offsets, one row per partition and group, are looked up afterwards. No cut points
come to the driver, and the plan is the same for any number of rows.

``running_totals`` takes buckets that are already there, such as digits of a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from riskframe.operators.lookup import lookup_join
from riskframe.session import checkpointed

HASH_DIGITS = 3
# Hash buckets follow the rows, without an upper limit.
ROWS_PER_BUCKET = 20_000


def hash_key(key: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random sort key: md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(digest: Column, digits: int = HASH_DIGITS) -> Column:
    """Order-preserving bucket of a hexadecimal digest (16 ** digits buckets)."""
    return F.substring(digest, 1, digits)


def wanted_buckets(df: DataFrame) -> int:
    """One bucket for every ``ROWS_PER_BUCKET`` rows."""
    return max(1, df.count() // ROWS_PER_BUCKET)


def _inside(schema: StructType, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds running totals of the ``_amount_`` columns, begun anew at every change of ``_group``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_group").to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lengths = np.diff(np.r_[starts, len(group)])
            columns = []
            for n in names:
                total = np.cumsum(batch.column(f"_amount_{n}").to_numpy(zero_copy_only=False))
                before = np.r_[np.zeros(1, total.dtype), total[starts[1:] - 1]]
                if group[0] == last:
                    before[0] = -carried[n]
                total = total - np.repeat(before, lengths)
                carried[n] = total[-1]
                columns.append(pa.array(total))
            last = group[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return run


def range_totals(
    df: DataFrame,
    totals: Mapping[str, Column],
    order: Sequence[Column],
    by: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add inclusive running totals in ``order`` within the groups of ``by``, whose columns may be null.

    ``totals`` maps a new column to the amount summed (null counts as 0). ``<name>_all`` is the total of the
    whole group. Rows that ``order`` does not tell apart stay together, so it should tell all apart.
    ``parts`` is the number of ranges; by default Spark chooses it.
    """
    names = list(totals)
    whole = {n: dict(df.select(a.alias(n)).dtypes)[n] in ("tinyint", "smallint", "int", "bigint") for n, a in totals.items()}
    keyed = df.withColumn("_group", F.xxhash64(F.to_json(F.struct(*by))) if by else F.lit(0).cast("long")).withColumns(
        {f"_amount_{n}": F.coalesce(a.cast("long" if whole[n] else "double"), F.lit(0)) for n, a in totals.items()}
    )
    # Names of groups first: rows of one group follow each other.
    places = ["_group", *order]
    placed = keyed.repartitionByRange(parts, *places) if parts else keyed.repartitionByRange(*places)
    placed = placed.sortWithinPartitions(*places).withColumn("_bucket", F.spark_partition_id())
    schema = StructType([*placed.schema.fields])
    for n in names:
        schema.add(StructField(f"_inside_{n}", LongType() if whole[n] else DoubleType()))
    rows = checkpointed(placed.mapInArrow(_inside(schema, names), schema))
    sums = rows.groupBy("_group", "_bucket").agg(*[F.sum(f"_amount_{n}").alias(n) for n in names])
    over_group = Window.partitionBy("_group")
    before = over_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_group",
        "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_offset_{n}") for n in names],
        *[F.sum(n).over(over_group).alias(f"{n}_all") for n in names],
    )
    found = lookup_join(rows, offsets, ["_group", "_bucket"])
    found = found.withColumns({n: F.col(f"_offset_{n}") + F.col(f"_inside_{n}") for n in names})
    return found.select(*df.columns, *names, *[f"{n}_all" for n in names])


def running_totals(
    df: DataFrame,
    totals: Mapping[str, Column],
    bucket: str,
    order: Sequence[Column],
    by: Sequence[str] = (),
    descending: bool = False,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add inclusive running totals in ``order`` within the groups of ``by``.

    ``totals`` maps a new column to the amount summed. ``<name>_all`` is the total
    of the whole group. ``bucket`` is an existing column that agrees with ``order``;
    it is dropped from the result. Group columns may be null. ``attach`` gets the
    group totals, one row per group, and returns them with more columns; these join
    the small offset table, so the big table never moves by group alone.
    """
    # A struct key compares nulls as equal, in the join as in the window.
    keyed = df.withColumn("_key", F.struct(*by, bucket)).withColumns(
        {f"_amount_{n}": amount for n, amount in totals.items()}
    )
    sums = keyed.groupBy("_key").agg(*[F.sum(f"_amount_{n}").alias(n) for n in totals])
    bucket_order = F.col(f"_key.{bucket}")
    group = [F.col(f"_key.{c}") for c in by]
    over_group = Window.partitionBy(*group)
    over_buckets = over_group.orderBy(
        bucket_order.desc() if descending else bucket_order.asc()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(
        "_key",
        *[(F.sum(n).over(over_buckets) - F.col(n)).alias(f"_offset_{n}") for n in totals],
        *[F.sum(n).over(over_group).alias(f"{n}_all") for n in totals],
    )
    if attach is not None:
        whole = sums.groupBy(*[F.col(f"_key.{c}").alias(c) for c in by]).agg(
            *[F.sum(n).alias(n) for n in totals]
        )
        attached = attach(whole)
        extra = [c for c in attached.columns if c not in (*by, *totals)]
        offsets = (
            offsets.withColumn("_group", F.struct(*[F.col(f"_key.{c}").alias(c) for c in by]))
            .join(attached.select(F.struct(*by).alias("_group"), *extra), "_group")
            .drop("_group")
        )
    inside = (
        Window.partitionBy("_key")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.join(offsets, "_key")
        .withColumns(
            {n: F.col(f"_offset_{n}") + F.sum(f"_amount_{n}").over(inside) for n in totals}
        )
        .drop(
            "_key",
            bucket,
            *[f"_amount_{n}" for n in totals],
            *[f"_offset_{n}" for n in totals],
        )
    )


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int,
    by: Sequence[str] = (),
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``rank`` (from 1) in seeded pseudo-random order, and ``rank_all`` (group size)."""
    digest = hash_key(key, seed)
    # 16 ** digits buckets, as many as the rows ask for.
    digits = max(HASH_DIGITS, len(f"{wanted_buckets(df):x}"))
    bucketed = df.withColumn("_bucket", hash_bucket(digest, digits))
    one = F.lit(1).cast("long")
    return running_totals(
        bucketed, {"rank": one}, "_bucket", [digest, F.col(key)], by, attach=attach
    )


def key_rank(df: DataFrame, key: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add ``rank`` (from 1) in key order, and ``rank_all`` (group size); numbers and texts.

    Rows of one key are told apart by a number, so that any number of them spreads over tasks. It is
    written first, for a repeated task must find the same one.
    """
    numbered = checkpointed(df.withColumn("_number", F.monotonically_increasing_id()))
    one = F.lit(1).cast("long")
    return range_totals(numbered, {"rank": one}, [F.col(key), F.col("_number")], by, parts).drop("_number")
