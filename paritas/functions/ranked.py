"""Rank statistics over tie runs: a groupBy on (scope, score), and running sums over the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.running import running


def auc(df: DataFrame, scope: list[str], score: str, positive: str, weight: str | None = None, few: int | None = None) -> DataFrame:
    """(scope..., auc): P(score of a positive > score of a negative) + half the ties; null if a class is empty."""
    w = F.col(weight) if weight else F.lit(1.0)
    runs = df.groupBy(*scope, score).agg(F.sum(F.when(F.col(positive), w).otherwise(0.0)).alias("f"), F.sum(F.when(F.col(positive), 0.0).otherwise(w)).alias("u"))
    runs = running(runs, scope, [F.asc(score)], {"below": F.col("u")}, few=few)
    return runs.groupBy(*scope).agg(F.try_divide(F.sum(F.col("f") * (F.col("below") + 0.5 * F.col("u"))), F.sum("f") * F.sum("u")).alias("auc"))


def ks(df: DataFrame, score: str, bad: str, weight: str, few: int | None = None) -> DataFrame:
    """(ks, ks_score, ks_scores): largest distance of the cumulative shares by falling score; the lowest and all such scores."""
    runs = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(bad), F.col(weight)).otherwise(0.0)).alias("b"), F.sum(F.when(F.col(bad), 0.0).otherwise(F.col(weight))).alias("g"))
    at = running(runs, [], [F.desc("s")], {"bb": F.col("b"), "gg": F.col("g")}, {"tb": F.col("b"), "tg": F.col("g")}, few)
    at = at.select("s", F.abs(F.try_divide(F.col("bb") + F.col("b"), F.col("tb")) - F.try_divide(F.col("gg") + F.col("g"), F.col("tg"))).alias("d"))
    top = F.broadcast(at.agg(F.max("d").alias("top")))  # one row
    return at.join(top).filter(F.abs(F.col("d") - F.col("top")) <= 1e-15).agg(F.max("top").alias("ks"), F.min("s").alias("ks_score"), F.array_sort(F.collect_list("s")).alias("ks_scores"))


def lift(df: DataFrame, score: str, bad: str, weight: str, fractions: list[float], few: int | None = None) -> DataFrame:
    """Whole tie runs by falling score until each fraction of the weight is reached."""
    runs = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(F.when(F.col(bad), F.col(weight)).otherwise(0.0)).alias("b"))
    runs = running(runs, [], [F.desc("s")], {"before": F.col("w")}, {"tw": F.col("w"), "tb": F.col("b")}, few)
    runs = runs.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    taken = runs.filter(F.col("before") < F.col("fraction") * F.col("tw"))
    out = taken.groupBy("fraction").agg(F.sum("n").alias("selected"), F.sum("w").alias("w"), F.sum("b").alias("b"), F.max("tw").alias("tw"), F.max("tb").alias("tb"))
    rate = F.try_divide(F.col("b"), F.col("w"))
    return out.select("fraction", "selected", rate.alias("bad_rate"), F.try_divide(F.col("b"), F.col("tb")).alias("capture"), F.try_divide(rate, F.try_divide(F.col("tb"), F.col("tw"))).alias("lift"))
