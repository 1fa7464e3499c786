"""Running sums and exact order statistics without a window over all rows in one task.

Rows are dealt out by ranges of (keys, order); each range is summed, the few sums of ranges are summed in
order, and a window within each range adds what stands before it. Tables of few rows take one plain window.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a plain window takes: the plan differs above it, and the result does not.
FEW = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder; a folder of our own only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, Column] | None = None, few: int | None = None) -> DataFrame:
    """``df`` with the sums of ``sums`` over the rows before each one of its keys, and of ``totals`` over all of them.

    The order must be total within the keys. Sums of no row are 0.
    """
    totals = totals or {}
    df = checkpointed(df)
    if df.count() <= (FEW if few is None else few):
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
        return df.withColumns(out | {n: F.sum(c).over(Window.partitionBy(*keys)) for n, c in totals.items()})
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    by = dealt.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in (sums | totals).items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(*keys, "__part", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums], *[F.sum(f"__{n}").over(Window.partitionBy(*keys)).alias(f"__{n}") for n in totals])
    both = dealt.alias("a").join(F.broadcast(by).alias("b"), _same("a", "b", [*keys, "__part"]))  # ranges times the keys within them
    here = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = both.select("a.*", *[f"b.__{n}" for n in (*sums, *totals)])
    out = {n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()} | {n: F.col(f"__{n}") for n in totals}
    return rows.withColumns(out).select(*df.columns, *out)


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], few: int | None = None) -> DataFrame:
    """(keys, n, quantiles): exact type-7 quantiles of the non-null values, by their ranks over runs of equal values.

    A quantile lies between two order statistics; the runs that hold them are found by their running counts.
    """
    runs = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return quantiles_of_runs(runs, keys, probabilities, few)


def quantiles_of_runs(runs: DataFrame, keys: list[str], probabilities: list[float], few: int | None = None) -> DataFrame:
    """The same from runs (keys, __v, __n): values, each once for its keys, and how often they occur."""
    runs = running(runs, keys, [F.asc("__v")], {"__before": F.col("__n")}, {"__all": F.col("__n")}, few)
    found = []
    for i, p in enumerate(probabilities):
        h = (F.col("__all") - 1) * F.lit(float(p))
        for name, at in ((f"__lo{i}", F.floor(h)), (f"__hi{i}", F.ceil(h))):
            found.append(F.max(F.when((F.col("__before") <= at) & (at < F.col("__before") + F.col("__n")), F.col("__v"))).alias(name))
    by = runs.groupBy(*keys).agg(F.max("__all").alias("n"), *found)
    out = []
    for i, p in enumerate(probabilities):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo)))
    return by.select(*keys, "n", F.array(*out).alias("quantiles"))
