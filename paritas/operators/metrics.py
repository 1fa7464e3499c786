"""Scopes, group metrics, comparisons, reliability gates and screening flags.

Input rows are (attributes..., y, d, s, w). They are aggregated once by the attributes together; scopes
(overall, and each configured group of each attribute) are then drawn from that small table, so the
large table is never exploded. Configured groups without rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.config import Label
from paritas.functions import ranked

#: Names of metrics, in canonical order.
SCOPE_METRICS = ("selection_rate", "denial_rate", "accuracy", "precision", "true_positive_rate", "false_positive_rate", "false_negative_rate", "brier_score", "roc_auc")
COMPARISONS = ("selection_rate_difference", "adverse_impact_ratio", "demographic_parity_difference", "equal_opportunity_difference", "equalized_odds_gap")
_CELLS = {"tp": "y AND d", "fp": "NOT y AND d", "fn": "y AND NOT d", "tn": "NOT y AND NOT d"}


def ordered_sum(x: Column) -> Column:
    """A sum of doubles that no order of rows changes, where all terms are below a million: they are added as decimals of 18 places."""
    whole = F.sum(F.when(F.abs(x) < 1e6, x).cast("decimal(28,18)")).cast("double")
    return F.when(F.max(F.abs(x)) < 1e6, whole).otherwise(F.sum(x))


def scope_array(attributes) -> Column:
    own = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]
    return F.array(F.struct(F.lit("__scope__").alias("attribute"), F.lit("overall").alias("value")), *own)


def scope_dimension(spark, allowed: dict[str, list[Label]]) -> DataFrame:
    rows = [("__scope__", "overall"), *[(a, str(v).lower() if isinstance(v, bool) else str(v)) for a, vs in allowed.items() for v in vs]]
    return spark.createDataFrame(rows, "attribute string, value string")


def scope_stats(rows: DataFrame, allowed: dict[str, list[Label]]) -> DataFrame:
    """Counts (n, tp, ...), weights (w, wtp, ...) and weighted squared errors by scope."""
    sums = [F.count("*").alias("n"), F.sum("w").alias("w"), ordered_sum(F.expr("w * (s - CAST(y AS INT)) * (s - CAST(y AS INT))")).alias("sq")]
    for k, cond in _CELLS.items():
        sums += [F.sum(F.expr(f"CAST({cond} AS BIGINT)")).alias(k), F.sum(F.expr(f"IF({cond}, w, 0D)")).alias(f"w{k}")]
    names = ["n", "w", "sq", *_CELLS, *[f"w{k}" for k in _CELLS]]
    small = rows.groupBy(*allowed).agg(*sums).withColumn("scope", F.explode(scope_array(allowed)))
    by_scope = small.groupBy("scope.attribute", "scope.value").agg(*[F.sum(c).alias(c) for c in names])
    joined = F.broadcast(scope_dimension(rows.sparkSession, allowed)).join(by_scope, ["attribute", "value"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long") if c in ("n", *_CELLS) else F.lit(0.0)) for c in names}
    return joined.withColumns(zero)


def scope_auc(rows: DataFrame, attributes) -> DataFrame:
    small = rows.groupBy(*attributes, "s", "y").agg(F.sum("w").alias("w"))
    long = small.withColumn("scope", F.explode(scope_array(attributes))).select("scope.attribute", "scope.value", "s", "y", "w")
    return ranked.auc(long, ["attribute", "value"], "s", "y", "w")


def _metric(name: str, num: Column, den: Column, empty: Column, none: str, zero: str) -> Column:
    reason = F.when(F.col("n") == 0, "empty_population").when(empty, none).when(den == 0, zero)
    value = F.when(reason.isNull(), F.try_divide(num, den))
    return F.struct(F.lit(name).alias("metric"), value.alias("value"), num.cast("double").alias("numerator"), den.cast("double").alias("denominator"), reason.alias("reason"))


def scope_metrics(stats: DataFrame, probability: bool = True, aucs: DataFrame | None = None) -> DataFrame:
    """Long rows (attribute, value, metric, metric_value, numerator, denominator, reason, n)."""
    c = F.col
    fav, unf, sel = c("tp") + c("fn") == 0, c("fp") + c("tn") == 0, c("tp") + c("fp") == 0
    never = F.lit(False)
    out = [
        _metric("selection_rate", c("wtp") + c("wfp"), c("w"), never, "", "zero_total_weight"),
        _metric("denial_rate", c("wfn") + c("wtn"), c("w"), never, "", "zero_total_weight"),
        _metric("accuracy", c("wtp") + c("wtn"), c("w"), never, "", "zero_total_weight"),
        _metric("precision", c("wtp"), c("wtp") + c("wfp"), sel, "no_favorable_decisions", "zero_favorable_decision_weight"),
        _metric("true_positive_rate", c("wtp"), c("wtp") + c("wfn"), fav, "no_favorable_outcomes", "zero_favorable_outcome_weight"),
        _metric("false_positive_rate", c("wfp"), c("wfp") + c("wtn"), unf, "no_unfavorable_outcomes", "zero_unfavorable_outcome_weight"),
        _metric("false_negative_rate", c("wfn"), c("wtp") + c("wfn"), fav, "no_favorable_outcomes", "zero_favorable_outcome_weight"),
        _metric("brier_score", c("sq"), c("w"), F.lit(not probability), "metric_not_applicable", "zero_total_weight"),
    ]
    if aucs is not None:
        stats = stats.join(aucs, ["attribute", "value"], "left")
        why = F.when(c("n") == 0, "empty_population").when(fav, "no_favorable_outcomes").when(unf, "no_unfavorable_outcomes")
        why = why.when(c("wtp") + c("wfn") == 0, "zero_favorable_outcome_weight").when(c("wfp") + c("wtn") == 0, "zero_unfavorable_outcome_weight")
        den = (c("wtp") + c("wfn")) * (c("wfp") + c("wtn"))
        out.append(F.struct(F.lit("roc_auc").alias("metric"), F.when(why.isNull(), c("auc")).alias("value"), (c("auc") * den).alias("numerator"), den.alias("denominator"), why.alias("reason")))
    long = stats.select("attribute", F.col("value").alias("group_value"), "n", "tp", "fp", "fn", "tn", F.explode(F.array(*out)).alias("m"))
    return long.select("attribute", F.col("group_value").alias("value"), "m.metric", F.col("m.value").alias("metric_value"), "m.numerator", "m.denominator", "m.reason", "n", "tp", "fp", "fn", "tn")


def compare(stats: DataFrame, reference: dict[str, str]) -> DataFrame:
    """One row per group but the reference, with its comparisons to the reference."""
    rate = {"sr": ("wtp + wfp", "w"), "tpr": ("wtp", "wtp + wfn"), "fpr": ("wfp", "wfp + wtn")}
    wide = stats.filter("attribute <> '__scope__'").select("attribute", "value", "n", *[F.expr(f"try_divide({a}, {b})").alias(k) for k, (a, b) in rate.items()])
    named = F.create_map(*[F.lit(x) for pair in reference.items() for x in pair])
    is_ref = F.coalesce(F.element_at(named, F.col("attribute")) == F.col("value"), F.lit(False))
    ref = wide.filter(is_ref).select("attribute", F.col("value").alias("reference"), *[F.col(c).alias(f"{c}_r") for c in ("n", *rate)])
    both = wide.filter(~is_ref).join(F.broadcast(ref), "attribute")  # one row per attribute
    dt, df = F.col("tpr") - F.col("tpr_r"), F.col("fpr") - F.col("fpr_r")

    def undefined(rate: str) -> Column:
        return F.when(F.col(rate).isNull(), "comparison_metric_undefined").when(F.col(f"{rate}_r").isNull(), "reference_metric_undefined")

    reason = undefined("sr").when(F.col("sr_r") == 0, "zero_reference_selection_rate")
    return both.select(
        "attribute", "value", "reference", F.col("sr").alias("comparison_rate"), F.col("sr_r").alias("reference_rate"),
        (F.col("sr") - F.col("sr_r")).alias("selection_rate_difference"),
        F.try_divide("sr", "sr_r").alias("adverse_impact_ratio"),
        reason.alias("air_reason"),
        dt.alias("equal_opportunity_difference"),
        F.when(dt.isNotNull() & df.isNotNull(), F.greatest(F.abs(dt), F.abs(df))).alias("equalized_odds_gap"),
        undefined("sr").alias("difference_reason"), undefined("tpr").alias("opportunity_reason"), F.when(dt.isNull() | df.isNull(), "component_metric_undefined").alias("odds_reason"),
        (F.col("n") + F.col("n_r")).alias("sample_count"), F.least("n", "n_r").alias("smaller"),
    )


def reliability(metrics: DataFrame, minimum: int) -> DataFrame:
    """``metrics`` with limitation codes; undefined metrics carry none. Counts are unweighted."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    by_outcome = F.col("metric").isin("accuracy", "precision", "true_positive_rate", "false_positive_rate", "false_negative_rate", "brier_score", "roc_auc")
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") < minimum, "small_group"),
            F.when(by_outcome & (F.least(pos, neg) < minimum), "severe_outcome_imbalance"),
            F.when((F.col("metric") == "precision") & (F.col("tp") + F.col("fp") < minimum), "sparse_decision_support"),
        )
    )
    codes = F.when(F.col("reason").isNull(), codes).otherwise(F.array().cast("array<string>"))
    state = F.when(F.col("reason") == "metric_not_applicable", "not_applicable").when(F.col("reason").isNotNull(), "undefined").when(F.size(codes) == 0, "reliable").otherwise("unreliable")
    return metrics.withColumn("limitations", codes).withColumn("reliability", state)


def air_flags(comparisons: DataFrame, threshold: float, minimum: int) -> DataFrame:
    """Groups whose defined and reliable ratio lies strictly below the threshold."""
    return comparisons.filter(F.col("air_reason").isNull() & (F.col("smaller") >= minimum) & (F.col("adverse_impact_ratio") < threshold))
