"""Exact sums of doubles: one rounding at the end, whatever the order, the partitions and the cancellation.

A finite double is a whole number of at most 55 bits times a power of two; the powers are its places. Rows are
summed by (keys, place) as whole numbers, in two halves of 32 bits, as decimals of 38 digits: a partial
aggregation merges them, and there are about two thousand places at most, whatever the number of rows. The places of a
key are put together as one whole number, which is divided once, rounded half to even.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Places begin at this power of two, below the least double.
LEAST = 1200


def place(x: Column) -> tuple[Column, Column]:
    """(place, whole number) of a finite double: x = whole * 2 ** (place - LEAST). Steps by powers of two are exact."""
    m = F.abs(x)
    shift = F.when(m < 2.0**-900, -200).when(m > 2.0**900, 200).otherwise(0)
    y = m * F.when(m < 2.0**-900, 2.0**200).when(m > 2.0**900, 2.0**-200).otherwise(1.0)
    # the logarithm may be off by one beside a power of two: 55 bits hold either
    low = F.when(m == 0, F.lit(0)).otherwise(F.floor(F.log2(F.when(y > 0, y).otherwise(1.0))).cast("int") - 53)
    whole = (y * F.pow(F.lit(2.0), (-low).cast("double"))).cast("bigint") * F.when(x < 0, -1).otherwise(1)
    return (low + shift + LEAST).cast("int"), whole


def _rounded(parts: str) -> Column:
    """The whole number of a key's places, divided once."""

    def run(places: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        def one(p, lo, hi) -> float:
            total = sum((int(a) + (int(b) << 32)) << int(k) for k, a, b in zip(p, lo, hi))
            try:
                return total / (1 << LEAST)  # of whole numbers: rounded once
            except OverflowError:
                return float("inf") if total > 0 else float("-inf")

        return pd.Series([one(*r) for r in zip(places, lows, highs)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(*[f"{parts}.{c}" for c in ("__p", "lo", "hi")])


def sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, sum) over the non-null values; values that are not finite make it their plain sum."""
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull()).withColumn("__x", x)
    finite = ~(F.isnan("__x") | (F.abs("__x") == float("inf")))
    p, whole = place(F.when(finite, F.col("__x")).otherwise(0.0))
    rows = rows.select(*keys, p.alias("__p"), whole.alias("__w"), F.when(~finite, F.col("__x")).alias("__odd"))
    low, high = F.col("__w").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftright("__w", 32)  # floors: low is never negative
    by = rows.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"), F.sum(low.cast("decimal(18,0)")).alias("__lo"), F.sum(high.cast("decimal(18,0)")).alias("__hi"), F.sum("__odd").alias("__odd"))
    parts = F.sort_array(F.collect_list(F.struct("__p", F.col("__lo").cast("string").alias("lo"), F.col("__hi").cast("string").alias("hi"))))
    one = by.groupBy(*keys).agg(F.sum("__n").alias("n"), parts.alias("__parts"), F.sum("__odd").alias("__odd"))
    return one.select(*keys, "n", F.coalesce("__odd", _rounded("__parts")).alias("sum"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, deviation) of the non-null values: the population's deviation, about the rounded mean."""
    mean = sums(df, keys, value).select(*keys, "n", F.try_divide("sum", "n").alias("mean"))
    known = F.broadcast(mean.select(*[F.col(k).alias(f"__{k}") for k in keys], "mean"))  # a row a key: its size is left to the caller
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    gap = F.col(value).cast("double") - F.col("mean")
    squares = sums(df.join(known, on).select(*keys, (gap * gap).alias("__sq")), keys, "__sq").select(*[F.col(k).alias(f"__{k}") for k in keys], F.sqrt(F.try_divide("sum", "n")).alias("deviation"))
    return mean.join(squares, on, "left").select(*keys, "n", "mean", "deviation")
