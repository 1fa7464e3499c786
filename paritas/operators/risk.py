"""Credit-risk diagnostics over entities (score, bad, weight)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions import ranked


def eligibility(df: DataFrame, mature: str = "label_mature", censored: str = "censored") -> DataFrame:
    """``df`` with ``status``: immature comes before censored."""
    return df.withColumn("status", F.when(~F.col(mature), "immature").when(F.col(censored), "censored").otherwise("eligible"))


def orient(score: Column, target: str = "unfavorable", kind: str = "probability") -> Column:
    if target == "unfavorable":
        return score
    return 1 - score if kind == "probability" else -score


def normalized_weights(df: DataFrame, weight: str = "w") -> DataFrame:
    """``df`` with weights as shares of the largest one; all are 0 where that is 0. The largest is one row."""
    most = df.agg(F.max(weight).alias("__most"))
    return df.join(F.broadcast(most)).withColumn(weight, F.coalesce(F.try_divide(weight, "__most"), F.lit(0.0))).drop("__most")


def band_of(score: Column, edges: list[float]) -> Column:
    """Index of the left-closed band: the number of edges at or below the score."""
    return sum(((score >= e).cast("int") for e in edges), F.lit(0))


def bands(df: DataFrame, edges: list[float]) -> DataFrame:
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("band"))
    by = df.withColumn("band", band_of(F.col("s"), edges)).groupBy("band").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum(F.when(F.col("bad"), F.col("w")).otherwise(0.0)).alias("wb")
    )
    out = every.join(by, "band", "left")
    return out.select("band", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("wb", "w").alias("bad_rate"), F.try_divide("ws", "w").alias("mean_score"))


def auc_gini(df: DataFrame) -> DataFrame:
    one = ranked.auc(df.withColumn("all", F.lit(1)), ["all"], "s", "bad", "w")
    return one.select("auc", (2 * F.col("auc") - 1).alias("gini"))


def calibration(df: DataFrame) -> DataFrame:
    """Calibration in the large and Brier score."""
    y = F.col("bad").cast("double")
    return df.agg(
        (F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum("w")) - F.try_divide(F.sum(F.col("w") * y), F.sum("w"))).alias("calibration_in_the_large"),
        F.try_divide(F.sum(F.col("w") * (F.col("s") - y) * (F.col("s") - y)), F.sum("w")).alias("brier_score"),
    )


def calibration_slope(df: DataFrame, iterations: int = 50, tolerance: float = 1e-10, clip: float = 1e-6) -> dict:
    """Weighted logistic regression of bad on logit(s) by Newton steps; each step is one pass of five sums."""
    s = F.least(F.greatest(F.col("s"), F.lit(clip)), F.lit(1 - clip))
    rows = df.select(F.ln(s / (1 - s)).alias("x"), F.col("bad").cast("double").alias("y"), F.col("w"))
    span = rows.agg(F.min("x"), F.max("x"), F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    if span[0] is None or span[0] == span[1]:
        return {"slope": None, "intercept": None, "reason": "constant_probability", "iterations": 0}
    if span[3] in (0, span[2]):
        return {"slope": None, "intercept": None, "reason": "separation", "iterations": 0}
    a = b = 0.0
    for step in range(1, iterations + 1):
        z = F.greatest(F.least(F.lit(a) + F.lit(b) * F.col("x"), F.lit(35.0)), F.lit(-35.0))
        t = rows.withColumn("p", 1 / (1 + F.exp(-z)))
        v, g = F.col("w") * F.col("p") * (1 - F.col("p")), F.col("w") * (F.col("y") - F.col("p"))
        h00, h01, h11, g0, g1 = t.agg(F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x")), F.sum(g), F.sum(g * F.col("x"))).first()
        det = h00 * h11 - h01 * h01
        if not det > 1e-12 * max(1.0, h00 * h11):
            return {"slope": None, "intercept": None, "reason": "singular", "iterations": step}
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if not math.isfinite(a + b) or abs(b) > 1e6:
            return {"slope": None, "intercept": None, "reason": "separation", "iterations": step}
        if max(abs(da), abs(db)) <= tolerance:
            return {"slope": b, "intercept": a, "reason": None, "iterations": step}
    return {"slope": None, "intercept": None, "reason": "non_convergence", "iterations": iterations}
