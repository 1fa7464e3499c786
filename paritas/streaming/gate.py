"""An extension beyond batch: the leakage gate and monthly cash flow over a stream of signal records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators.altdata import feature_gate


def gated(records: DataFrame, as_of: str, execution: str) -> DataFrame:
    """Stateless: each record with its disposition and code."""
    t = [F.lit(x).cast("timestamp") for x in (as_of, execution)]
    g = feature_gate(F.col("event_time"), F.col("event_time"), F.col("observed_at"), F.col("revision_of").isNotNull(), F.col("status"), *t)
    return records.withColumn("gate", g).select(*records.columns, "gate.disposition", "gate.code")


def windowed_flow(records: DataFrame, lateness: str = "40 days", width: str = "30 days") -> DataFrame:
    """Inflow and outflow by source and event-time window; records later than the watermark are dropped by Spark."""
    w = records.withWatermark("event_time", lateness).groupBy(F.window("event_time", width), "source_id")
    sums = [F.sum(F.when(F.col("event_type") == k, F.col("amount")).otherwise(0.0)).alias(k) for k in ("inflow", "outflow")]
    return w.agg(*sums, F.count("*").alias("records")).select(F.col("window.start").alias("start"), "source_id", *("inflow", "outflow", "records"))
