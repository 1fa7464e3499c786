"""Reason and flag contracts of the evidence operators, as data, and record migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons why a metric is undefined.
UNDEFINED = (
    "empty_population", "zero_total_weight", "no_favorable_decisions", "zero_favorable_decision_weight", "no_favorable_outcomes", "zero_favorable_outcome_weight", "no_unfavorable_outcomes",
    "zero_unfavorable_outcome_weight", "metric_not_applicable", "comparison_metric_undefined", "reference_metric_undefined", "zero_reference_selection_rate", "component_metric_undefined",
)

#: The range of each metric; others lie within [0, 1].
RANGES = {
    "selection_rate_difference": (-1.0, 1.0), "demographic_parity_difference": (-1.0, 1.0), "equal_opportunity_difference": (-1.0, 1.0), "adverse_impact_ratio": (0.0, float("inf")),
}

#: Words of a verdict that no text of a result may hold.
VERDICTS = r"(?i)\b(is|are|was|were)\s+(not\s+)?(compliant|legal|illegal|lawful|unlawful)\b|\bnon-?compliant\b"


def out_of_range(metrics: DataFrame) -> DataFrame:
    """Metric rows whose value lies outside its range, or that have a value and a reason; should be empty."""
    low = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v[0])) for k, v in RANGES.items()], F.lit(0.0))
    high = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v[1])) for k, v in RANGES.items()], F.lit(1.0))
    v = F.col("metric_value")
    outside = F.coalesce((v < low) | (v > high) | F.isnan(v), F.lit(False))  # an undefined metric has no value to check
    bad = outside | (v.isNotNull() & F.col("reason").isNotNull()) | (v.isNull() & F.col("reason").isNull())
    return metrics.filter(bad)


def has_verdict(text: str) -> bool:
    import re

    return bool(re.search(VERDICTS, text))


def migrate(record: dict) -> dict:
    """A record of schema 1.0 as 2.0: reliability was not assessed, limitations had no metric keys."""
    if record.get("schema_version") != "1.0":
        raise ValueError("only schema 1.0 can be migrated")
    metrics = [m | {"reliability": "not_assessed", "limitations": []} for m in record.get("metrics", [])]
    limits = [x | {"metric_keys": []} for x in record.get("limitations", [])]
    return record | {"schema_version": "2.0", "metrics": metrics, "limitations": limits}
