"""Profiles of categorical and numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def schema_by_type(df: DataFrame) -> DataFrame:
    """``(dtype, columns)``: the column names of every type, from the schema alone."""
    rows = [(dtype, name) for name, dtype in df.dtypes]
    listed = df.sparkSession.createDataFrame(rows, "dtype string, name string")
    return listed.groupBy("dtype").agg(F.array_sort(F.collect_list("name")).alias("columns"))


def without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with NaN as null in those of ``columns`` that are floating point numbers."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns if c in floats})


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, nulls)`` from one aggregate over all columns; NaN counts as missing."""
    df = without_nan(df, columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "nulls")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)``, nulls excluded; all columns in one shuffle."""
    texts = df.select([F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").count()


def ascending(counts: DataFrame) -> DataFrame:
    """Value counts in the order of the report: by column, then rising count."""
    return counts.orderBy("column", "count", "value")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column, distinct_values)``, nulls excluded."""
    if approximate:
        counted = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return counted.unpivot([], list(columns), "column", "distinct_values")
    counts = value_counts(df, columns)
    # A column without values still has its row.
    empty = df.sparkSession.createDataFrame([(c, 0) for c in columns], "column string, n long")
    some = counts.select("column", F.lit(1).cast("long").alias("n"))
    return some.unionByName(empty).groupBy("column").agg(F.sum("n").alias("distinct_values"))


#: A double is ordered by its 64 bits, which are fixed ``DIGIT`` bits at a time.
DIGIT = 16


def order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one value."""
    bits = (values + 0.0).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, ~bits, bits | sign)


def double_of(bits: int) -> float:
    sign = 1 << 63
    raw = bits ^ sign if bits & sign else ~bits & (2 * sign - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _number(column: str) -> Column:
    """The column as a double, with NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _digit_counts(df: DataFrame, columns: Sequence[str], prefixes: Sequence[Sequence[int]], shift: int) -> DataFrame:
    """``(column, prefix, digit, n)``: values with one of the column's ``prefixes``, by the digit that follows it."""
    schema = pa.schema([("place", pa.int32()), ("prefix", pa.int32()), ("digit", pa.int32()), ("n", pa.int64())])
    wanted = [np.array(sorted(p), np.uint64) for p in prefixes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, known in enumerate(wanted):
                bits = order_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                # A shift by all 64 bits would be none.
                top = bits >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros_like(bits)
                digit = ((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                for k, prefix in enumerate(known):
                    found = np.bincount(digit[top == prefix], minlength=1 << DIGIT)
                    counts[i, k] = counts[i, k] + found if (i, k) in counts else found
        for (i, k), n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), x, np.int32)) for x in (i, k)] + [pa.array(at.astype(np.int32)), pa.array(n[at])],
                schema=schema,
            )

    numbers = df.select(*[_number(c).alias(f"_{i}") for i, c in enumerate(columns)])
    counted = numbers.mapInArrow(run, "place int, prefix int, digit int, n long")
    return counted.groupBy("place", "prefix", "digit").agg(F.sum("n").alias("n"))


def select_ranks(df: DataFrame, columns: Sequence[str], ranks: Sequence[Sequence[int]]) -> list[dict[int, float]]:
    """For every column the values at the wanted ranks (from 0, nulls and NaN left out).

    Each of four passes counts the values that agree with a wanted one so far by their next 16 bits,
    which tells the next 16 bits of every wanted value. What is shuffled are counts, at most 2^16 per task and
    wanted value, whatever the number of rows; a few numbers per wanted value reach the driver.
    """
    # Per column: rank -> (prefix, rank among the values of that prefix).
    state = [{r: (0, r) for r in wanted} for wanted in ranks]
    for shift in range(64 - DIGIT, -1, -DIGIT):
        prefixes = [sorted({p for p, _ in s.values()}) for s in state]
        counts = _digit_counts(df, columns, prefixes, shift)
        upto = F.sum("n").over(Window.partitionBy("place", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        asked = [
            (i, prefixes[i].index(p), r, within) for i, s in enumerate(state) for r, (p, within) in s.items()
        ]
        if not asked:
            break
        wanted = df.sparkSession.createDataFrame(asked, "place int, prefix int, rank long, within long")
        hits = (
            counts.withColumn("upto", upto)
            .join(F.broadcast(wanted), ["place", "prefix"])
            .where((F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("n")))
            .select("place", "prefix", "rank", "digit", (F.col("within") - F.col("upto") + F.col("n")).alias("within"))
        )
        for r in hits.collect():
            state[r["place"]][r["rank"]] = (prefixes[r["place"]][r["prefix"]] << DIGIT | r["digit"], r["within"])
    return [{r: double_of(p) for r, (p, _) in s.items()} for s in state]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(column, q1, q2, ...)``: exact quantiles with linear interpolation, of the values that are neither null nor NaN."""
    row = df.agg(*[F.count(_number(c)).alias(c) for c in columns]).first()
    filled = [c for c in columns if row[c]]
    places = [[float(s) * (row[c] - 1) for s in shares] for c in filled]
    ranks = [sorted({r for p in at for r in (floor(p), ceil(p))}) for at in places]
    found = []
    for c, at, values in zip(filled, places, select_ranks(df, filled, ranks), strict=True):
        low_high = [(values[floor(p)], values[ceil(p)], p - floor(p)) for p in at]
        found.append((c, *[low + (high - low) * part for low, high, part in low_high]))
    names = ", ".join(f"q{i} double" for i in range(1, len(shares) + 1))
    return df.sparkSession.createDataFrame(found, f"column string, {names}")


def sketched_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000
) -> DataFrame:
    """``(column, q1, q2, ...)``: quantiles whose rank is off by at most 1 / ``accuracy`` of the rows."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    picks = [F.percentile_approx(F.col(c).cast("double"), wanted, accuracy).alias(c) for c in columns]
    long = df.agg(*picks).unpivot([], list(columns), "column", "q")
    return long.select("column", *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(len(shares))])


def describe_numeric(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column, count, mean, std, min, q1, q2, q3, max)``; std has n - 1 below.

    NaN counts as missing. With ``approximate`` the quartiles come from a sketch, without a
    shuffle of the values.
    """
    df = without_nan(df, columns)
    stats = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[f(F.col(c)).cast("long" if n == "count" else "double").alias(n) for n, f in stats.items()],
            ).alias(c)
            for c in columns
        ]
    )
    moments = row.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("_r")).select("_r.*")
    quantiles = sketched_quantiles(df, columns) if approximate else exact_quantiles(df, columns)
    return moments.join(quantiles, "column", "left")


def profile(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """The whole report as one tidy table ``(column, stat, value)``."""
    nulls = null_counts(df, [*categorical, *numeric]).select(
        "column", F.lit("nulls").alias("stat"), F.col("nulls").cast("double").alias("value")
    )
    distinct = distinct_counts(df, categorical).select(
        "column", F.lit("distinct").alias("stat"), F.col("distinct_values").cast("double").alias("value")
    )
    counts = value_counts(df, categorical).select(
        "column",
        F.concat(F.lit("count:"), "value").alias("stat"),
        F.col("count").cast("double").alias("value"),
    )
    described = describe_numeric(df, numeric)
    stats = [c for c in described.columns if c != "column"]
    numbers = described.select(
        "column", *[F.col(c).cast("double").alias(c) for c in stats]
    ).unpivot(["column"], stats, "stat", "value")
    return reduce(DataFrame.unionByName, [nulls, distinct, counts, numbers])
