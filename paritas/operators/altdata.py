"""Alternative-data evidence: leakage gates, revision graphs, quality scopes, signal profiles.

Signal rows have at least (record_id, source_id, entity_id, event_type, event_time, observed_at, amount).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(c: Column, end: bool = False) -> Column:
    """A date as an instant: its first, or its last microsecond."""
    day = c.cast("timestamp")
    return day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND") if end else day


def _decided(disposition: str, code: str | None = None) -> Column:
    return F.struct(F.lit(disposition).alias("disposition"), F.lit(code).cast("string").alias("code"))


def feature_gate(start: Column, end: Column, observed: Column, revises: Column, status: Column, as_of: Column, execution: Column) -> Column:
    """Ordered rules of a feature record: (disposition, code)."""
    return (
        F.when((end > execution) | (observed > execution), _decided("error", "ad_future_timestamp"))
        .when(end > as_of, _decided("error", "ad_feature_after_decision"))
        .when((observed > as_of) & revises, _decided("exclude", "ad_revision_after_decision"))
        .when(observed > as_of, _decided("exclude", "ad_observed_after_decision"))
        .when(status == "pending", _decided("unavailable", "ad_pending_record"))
        .otherwise(_decided("eligible", None))
    )


def coverage_gate(assessed: Column, as_of: Column, execution: Column) -> Column:
    return F.when(assessed > execution, "error").when(assessed > as_of, "exclude").otherwise("eligible")


def outcome_gate(start: Column, end: Column, observed: Column, mature_at: Column, as_of: Column, window_start: Column, window_end: Column, execution: Column) -> Column:
    """Ordered rules of an outcome record: (disposition, code). A label that is not mature yet is unavailable, not wrong."""
    return (
        F.when((end > execution) | (observed > execution), _decided("error", "ad_future_timestamp"))
        .when(mature_at > execution, _decided("unavailable", "ad_label_immature"))
        .when(start <= as_of, _decided("error", "ad_outcome_not_post_decision"))
        .when((start < window_start) | (end > window_end), _decided("exclude", "ad_outcome_outside_window"))
        .otherwise(_decided("eligible"))
    )


def terminal_records(records: DataFrame, eligible: Column | None = None) -> DataFrame:
    """Eligible records that no other eligible record revises: what a gate rejects replaces nothing."""
    if eligible is not None:
        records = records.filter(eligible)
    revised = records.filter("revision_of IS NOT NULL").select("source_id", F.col("revision_of").alias("record_id")).distinct()
    return records.join(revised, ["source_id", "record_id"], "left_anti")


def overlaps_and_gaps(records: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``overlap`` (either neighbour) and ``gap`` (over a second after the row before)."""
    w = Window.partitionBy(*keys).orderBy("period_start", "record_id")
    before, after = F.lag("period_end").over(w), F.lead("period_start").over(w)
    overlap = F.coalesce(F.col("period_start") <= before, F.lit(False)) | F.coalesce(after <= F.col("period_end"), F.lit(False))
    return records.withColumn("overlap", overlap).withColumn("gap", F.coalesce(F.col("period_start") > before + F.expr("INTERVAL 1 SECOND"), F.lit(False)))


def provider_coverage(records: DataFrame) -> DataFrame:
    by = records.groupBy("source_id").agg(F.countDistinct("entity_id").alias("entities"), F.count("*").alias("records"))
    total = records.agg(F.countDistinct("entity_id").alias("population"))
    return by.join(F.broadcast(total)).select("source_id", "entities", "records", F.try_divide("entities", "population").alias("rate"))


def signals_not_provided(entities: DataFrame, records: DataFrame, families: list[str]) -> DataFrame:
    """(entity_id, family) without a record; families are few and are laid out per entity."""
    every = entities.select("entity_id", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    return every.join(records.select("entity_id", "family").distinct(), ["entity_id", "family"], "left_anti")


def obligations(due: DataFrame, payments: DataFrame) -> DataFrame:
    """Per obligation (key, amount_due, due_date): what was paid, and the first date that covered it."""
    w = Window.partitionBy("key").orderBy("paid_on", "payment_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = due.join(payments, "key", "left").withColumn("cum", F.sum("paid").over(w))
    done = F.min(F.when(F.col("cum") >= F.col("amount_due"), F.col("paid_on")))
    return run.groupBy("key", "amount_due", "due_date").agg(F.coalesce(F.sum("paid"), F.lit(0)).alias("paid"), done.alias("completed_on")).withColumn(
        "state", F.when(F.col("completed_on") <= F.col("due_date"), "timely").when(F.col("completed_on").isNotNull(), "late").when(F.col("paid") > 0, "partial").otherwise("unpaid")
    )


def outside_gaps(due: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Obligations whose due date lies in no reporting gap of their key: an equi-join with a range condition."""
    d, g = due.alias("d"), gaps.alias("g")
    on = [F.col(f"d.{k}") == F.col(f"g.{k}") for k in keys] + [F.col("d.due_date").between(F.col("g.gap_start"), F.col("g.gap_end"))]
    return d.join(g, on, "left_anti")
