"""Class-stratified bootstrap of all risk diagnostics: bad and good entities are drawn apart, and paired by draw.

The draws of both classes meet their entities once and are counted by (draw, score): a small table of tie runs, from
which every diagnostic of a draw is a formula. Areas, distances and lifts are running sums within a draw; calibration
slopes are Newton steps of all draws together, each one pass of five sums over the runs. Only sums by draw
(resamples, a parameter) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.running import checkpointed
from paritas.operators import bootstrap, resample, risk

#: The streams' key, and their roles by class.
KEY, ROLES = "ad3.entity_stratified", {"bad": "comparison", "good": "reference"}
CORE, CALIBRATED = ("ks", "risk_auc", "gini"), ("brier_score", "calibration_in_the_large")


def positive_entities(df: DataFrame) -> DataFrame:
    """(entity_id, s, bad, w): weights as shares of the largest, without entities of no weight."""
    return risk.normalized_weights(df.select("entity_id", "s", "bad", "w")).filter(F.col("w") > 0)


def runs_of_draws(entities: DataFrame, resamples: int, seed: int, domain: str, few: int | None = None) -> DataFrame:
    """(draw, s, n, w, b, sw): entities, weight, bad weight and score times weight of each tie run of each draw."""
    spark = entities.sparkSession
    rows = entities.select("entity_id", "s", "bad", "w", F.lit("class").alias("attribute"), F.when(F.col("bad"), "bad").otherwise("good").alias("value"))
    placed = checkpointed(bootstrap.with_ordinal(rows, "entity_id", ["attribute", "value"], few))
    scopes = resample.numbered_scopes(placed)
    requests = spark.createDataFrame([(KEY, role, "class", c) for c, role in ROLES.items()], "key string, role string, attribute string, value string")
    met = resample.drawn(placed, scopes, resample.numbered_streams(scopes, requests), resamples, seed, domain)
    runs = checkpointed(met.groupBy("draw", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.when(F.col("bad"), F.col("w")).otherwise(0.0)).alias("b")))
    if not runs.filter("draw < 0").isEmpty():
        raise ValueError("a stream skips a candidate")
    return runs


def slopes(runs: DataFrame, epsilon: float, iterations: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(draw, v): calibration slopes of the draws that have one; the draws take their Newton steps together."""
    spark = runs.sparkSession
    p = F.least(F.greatest(F.col("s"), F.lit(epsilon)), F.lit(1 - epsilon))
    x = checkpointed(runs.select("draw", F.ln(p / (1 - p)).alias("x"), "w", "b"))
    # constant or separated draws have no slope
    span = x.groupBy("draw").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), *[f(F.when(c > 0, F.col("x"))).alias(n) for n, f, c in (("blo", F.min, F.col("b")), ("bhi", F.max, F.col("b")), ("glo", F.min, F.col("w") - F.col("b")), ("ghi", F.max, F.col("w") - F.col("b")))]
    )
    open_ = {r.draw: (0.0, 0.0) for r in span.filter("hi > lo AND NOT (ghi < blo OR bhi < glo)").select("draw").collect()}
    found = []
    for _ in range(iterations):
        if not open_:
            break
        state = F.broadcast(spark.createDataFrame([(k, *v) for k, v in open_.items()], "draw long, a double, c double"))  # a row a draw
        z = F.greatest(F.least(F.col("a") + F.col("c") * F.col("x"), F.lit(700.0)), F.lit(-700.0))
        t = x.join(state, "draw").withColumn("p", 1 / (1 + F.exp(-z)))
        v, g = F.col("w") * F.col("p") * (1 - F.col("p")), F.col("b") - F.col("w") * F.col("p")
        sums = t.groupBy("draw").agg(*[F.sum(e).alias(n) for n, e in (("h0", v), ("h1", v * F.col("x")), ("h2", v * F.col("x") * F.col("x")), ("g0", g), ("g1", g * F.col("x")))]).collect()
        for r in sums:
            a, c = open_.pop(r.draw)
            det = r.h0 * r.h2 - r.h1 * r.h1
            if det <= 1e-18:
                continue
            da, dc = (r.g0 * r.h2 - r.g1 * r.h1) / det, (r.g1 * r.h0 - r.g0 * r.h1) / det
            a, c = a + da, c + dc
            if max(abs(da), abs(dc)) <= tolerance:
                found.append((r.draw, float(c)))
            elif np.isfinite(a + c) and max(abs(a), abs(c)) <= 1e6:
                open_[r.draw] = (a, c)
    return spark.createDataFrame(found, "draw long, v double")


def draw_values(runs: DataFrame, edges: list[float], fractions: list[float], probability: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """(metric_key, draw, v) of every diagnostic that a draw has."""
    whole = Window.partitionBy("draw")
    down = whole.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    t = runs.withColumn("g", F.col("w") - F.col("b")).withColumns({"tb": F.sum("b").over(whole), "tg": F.sum("g").over(whole), "cb": F.coalesce(F.sum("b").over(down), zero), "cg": F.coalesce(F.sum("g").over(down), zero)})
    t = t.filter("tb > 0 AND tg > 0").withColumn("band", risk.band_of(F.col("s"), edges))
    tw = F.col("tb") + F.col("tg")
    one = {
        "ks": F.max(F.abs((F.col("cb") + F.col("b")) / F.col("tb") - (F.col("cg") + F.col("g")) / F.col("tg"))),
        # a bad entity beats the good ones of lower scores, and half of those of its own
        "risk_auc": F.sum(F.col("b") * (F.col("tg") - F.col("cg") - 0.5 * F.col("g"))) / (F.max("tb") * F.max("tg")),
    }
    if probability:
        s = F.col("s")
        one |= {"brier_score": F.sum(F.col("b") * (s - 1) * (s - 1) + F.col("g") * s * s) / F.max(tw), "calibration_in_the_large": F.sum(F.col("w") * s) / F.max(tw) - F.max("tb") / F.max(tw)}
    for i in range(len(edges) + 1):
        own = F.col("band") == i
        one[f"band.{i}.observed_bad_rate"] = F.try_divide(F.sum(F.when(own, F.col("b"))), F.sum(F.when(own, F.col("w"))))
    for f in fractions:
        taken = F.col("cb") + F.col("cg") < F.lit(f) * tw
        b, w = F.sum(F.when(taken, F.col("b"))), F.sum(F.when(taken, F.col("w")))
        one |= {f"top.{f:g}.bad_capture": b / F.max("tb"), f"top.{f:g}.selected_bad_rate": F.try_divide(b, w), f"top.{f:g}.lift": F.try_divide(b, w) / (F.max("tb") / F.max(tw))}
    names = list(one)
    by = t.groupBy("draw").agg(*[c.alias(f"m{i}") for i, c in enumerate(one.values())])
    by = by.withColumn(f"m{len(names)}", 2 * F.col(f"m{names.index('risk_auc')}") - 1)
    long = by.select("draw", F.explode(F.array(*[F.struct(F.lit(n).alias("metric_key"), F.col(f"m{i}").alias("v")) for i, n in enumerate([*names, "gini"])])).alias("m")).select("m.metric_key", "draw", "m.v")
    if probability:
        long = long.unionByName(slopes(runs, epsilon).select(F.lit("calibration_slope").alias("metric_key"), "draw", "v"))
    return long.filter("v IS NOT NULL")


def evidence(df: DataFrame, edges: list[float], fractions: list[float], resamples: int, minimum_valid: int, seed: int, domain: str = bootstrap.DOMAIN, probability: bool = True, few: int | None = None) -> DataFrame:
    """(metric_key, valid, reliable, lower, upper): 95 % intervals of all diagnostics; no rows where a class is empty."""
    values = draw_values(runs_of_draws(positive_entities(df), resamples, seed, domain, few), edges, fractions, probability)
    out = bootstrap.interval(values, ["metric_key"], 0.95, minimum_valid)
    return out.select("metric_key", F.col("valid").alias("valid_resamples"), (F.col("valid") >= minimum_valid).alias("reliable"), "lower", "upper")


def reliable(df: DataFrame, found: DataFrame, minimum_total: int, minimum_bad: int, minimum_good: int, minimum_valid: int, probability: bool = True) -> DataFrame:
    """One row: supports, the fewest valid draws of the core diagnostics, and whether all reach their minima."""
    n = positive_entities(df).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.col("bad").cast("long")).alias("bad"))
    core = CORE + CALIBRATED * probability
    fewest = found.filter(F.col("metric_key").isin(*core)).agg(F.coalesce(F.min("valid_resamples"), F.lit(0)).alias("valid_resamples"))
    both = n.join(F.broadcast(fewest)).withColumn("bad", F.coalesce("bad", F.lit(0))).withColumn("good", F.col("entities") - F.col("bad"))  # one row each
    ok = (F.col("entities") >= minimum_total) & (F.col("bad") >= minimum_bad) & (F.col("good") >= minimum_good) & (F.col("valid_resamples") >= minimum_valid)
    return both.select("entities", "bad", "good", "valid_resamples", ok.alias("reliable"))
