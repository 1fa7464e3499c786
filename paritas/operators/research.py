"""Research statistics and integrity summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(p_values: DataFrame, name: str = "test", p: str = "p") -> DataFrame:
    """Holm-adjusted p: the running maximum of min(1, (m - rank + 1) p)."""
    order = Window.orderBy(p, name)
    ranked = p_values.withColumns({"rn": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy())})
    step = F.least(F.lit(1.0), (F.col("m") - F.col("rn") + 1) * F.col(p))
    return ranked.withColumn("step", step).select(name, p, F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def paired_mean(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference, its standard error and studentized value."""
    d = F.col(a) - F.col(b)
    se = F.sqrt(F.var_samp(d) / F.count(d))
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), se.alias("standard_error"), F.try_divide(F.avg(d), se).alias("t"))


def student_tail(t: float, df: int) -> float:
    """P(T > t) through the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def cf(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if not 0 < x < 1:
        both = 1.0 if x >= 1 else 0.0
    elif x < (a + 1) / (a + b + 2):
        both = front * cf(a, b, x) / a
    else:
        both = 1 - front * cf(b, a, 1 - x) / b
    return both / 2 if t > 0 else 1 - both / 2


def numeric_text(df: DataFrame, column: str) -> DataFrame:
    """Missing, unparsable, zero and negative counts and the range of a text column of numbers."""
    v = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    blank = F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
    bad = ~blank & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.when(~blank & ~bad, v)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(n(blank).alias("missing"), n(bad).alias("non_finite"), n(F.coalesce(x == 0, F.lit(False))).alias("zero"), n(F.coalesce(x < 0, F.lit(False))).alias("negative"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))


def blanks(df: DataFrame) -> DataFrame:
    """(column, missing): blank or null cells of every column, in one pass."""
    one = df.agg(*[F.sum((F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == "").cast("long")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns])).alias("x")).select("x.*")


def special_responses(df: DataFrame, rules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(category, column, n) for rules category -> column -> values."""
    cases = [(k, c, F.sum(F.col(c).isin(v).cast("long"))) for k, by in rules.items() for c, v in by.items()]
    one = df.agg(*[x.alias(f"c{i}") for i, (_, _, x) in enumerate(cases)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, (k, c, _) in enumerate(cases)])).alias("x")).select("x.*")


def table_digest(df: DataFrame) -> DataFrame:
    """An order-free digest: row count and the sum of 64-bit row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
