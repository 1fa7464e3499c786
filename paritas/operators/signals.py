"""Signal profiles: cash flow, rent and utilities, one row per entity.

Records are authoritative feature records of one family: (record_id, source_id, entity_id, event_type,
status, event_time, observed_at, amount, reversal_of) and what a profile names besides. A record that
another one reverses does not count, nor does a pending or unavailable one. Null amounts count as 0. What
cannot be observed is unavailable and never read as behaviour. Only (entity, month) and obligation keys
are shuffled; an entity without records has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of the contract.
CASH_CODES = {
    "ad_balance_history_unavailable": "balance_observation_count = 0",
    "ad_cashflow_category_unresolved": "unresolved > 0",
    "ad_cashflow_reversal_observed": "reversal_count > 0",
    "ad_insufficient_calendar_coverage": "NOT complete",
    "ad_provider_reporting_gap": "gaps > 0",
    "ad_uncertain_transfer": "uncertain_transfer_count > 0",
}
DUE_CODES = {
    "ad_obligation_schedule_unavailable": "scheduled_obligation_count = 0",
    "ad_provider_nonparticipation": "reporting_gap_count > 0",
    "ad_provider_reporting_gap": "reporting_gap_count > 0",
    "ad_unmatched_obligation": "strays > 0",
}
RENT_CODES = DUE_CODES | {"ad_rent_partial_payment_observed": "any_partial", "ad_rent_waiver_observed": "any_waiver"}
UTILITY_CODES = DUE_CODES | {
    "ad_service_interruption_observed": "service_interruption_count > 0",
    "ad_utility_adjustment_observed": "adjustment_count > 0",
    "ad_utility_estimated_bill_observed": "any_estimate",
}


def _codes(rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(code)) for code, rule in sorted(rules.items())]))


def _kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def _marked(records: DataFrame) -> DataFrame:
    """Records with ``stands`` (neither pending nor unavailable) and ``counts`` (stands, and nothing reverses it)."""
    targets = records.filter("reversal_of IS NOT NULL").select("entity_id", F.col("reversal_of").alias("record_id")).distinct().withColumn("undone", F.lit(True))
    stands = ~F.coalesce(F.col("status").isin("pending", "unavailable"), F.lit(False))
    rows = records.join(targets, ["entity_id", "record_id"], "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(18,2)")))
    return rows.withColumn("stands", stands).withColumn("counts", F.col("stands") & F.col("undone").isNull()).drop("undone")


def cash_flow_profile(records: DataFrame, start: str, end: str, minimum: int = 3) -> DataFrame:
    """Totals, monthly inflow over the window's calendar, balances, transfers and reversals.

    Also needs (category_id, transfer_scope). Mean, deviation and coefficient are null unless at least
    ``minimum`` months are observed and no month has a reporting gap.
    """
    if minimum < 1:
        raise ValueError("minimum must be positive")
    calendar = F.expr(f"CAST(months_between(trunc(DATE'{end}', 'MM'), trunc(DATE'{start}', 'MM')) AS INT) + 1")
    rows = _marked(records).withColumn("month", F.trunc("event_time", "month"))
    counts = F.col("counts") & ~_kind("reversal")
    total = {k: F.sum(F.when(counts & _kind(k), F.col("amount")).otherwise(0)) for k in ("inflow", "outflow", "fee")}
    tally = {
        "balance_observation_count": counts & _kind("balance"), "negative_balance_count": counts & _kind("balance") & (F.col("amount") < 0),
        "internal_transfer_count": counts & _kind("transfer") & (F.col("transfer_scope") == "internal"), "uncertain_transfer_count": counts & _kind("transfer") & (F.col("transfer_scope") == "uncertain"),
        "fee_event_count": counts & _kind("fee"), "reversal_count": _kind("reversal"), "unresolved": counts & _kind("inflow", "outflow") & F.col("category_id").isNull(),
        "active": counts, "gaps": F.col("status") == "unavailable",
    }
    undo = records.filter("reversal_of IS NOT NULL").select("entity_id", F.col("reversal_of").alias("record_id"))
    undone = undo.join(records.select("entity_id", "record_id", "amount"), ["entity_id", "record_id"]).groupBy("entity_id").agg(F.sum("amount").alias("reversed"))
    monthly = rows.groupBy("entity_id", "month").agg(*[v.alias(k) for k, v in total.items()], *[F.count_if(v).alias(k) for k, v in tally.items()])
    # at most as many values as the window has months
    inflows = F.collect_list(F.col("inflow").cast("double"))
    by = monthly.groupBy("entity_id").agg(
        *[F.sum(k).alias(k) for k in (*total, *tally)], inflows.alias("seen"), F.count_if((F.col("active") > 0) & (F.col("gaps") == 0)).alias("observed_period_count")
    ).withColumn("calendar_period_count", calendar.cast("long"))
    by = by.withColumn("complete", (F.col("observed_period_count") >= minimum) & (F.col("gaps") == 0)).withColumn("mean", F.col("inflow").cast("double") / F.col("calendar_period_count"))
    square = F.expr("aggregate(seen, 0D, (t, v) -> t + (v - mean) * (v - mean)) + (calendar_period_count - size(seen)) * mean * mean")
    by = by.withColumn("deviation", F.sqrt(square / F.col("calendar_period_count"))).join(undone, "entity_id", "left")
    return by.select(
        "entity_id", F.when(F.col("complete"), "available").otherwise("unavailable").alias("state"), "calendar_period_count", "observed_period_count",
        (F.col("calendar_period_count") - F.col("observed_period_count")).alias("missing_period_count"),
        *[F.col(k).alias(f"{k}_total") for k in total], (F.col("inflow") - F.col("outflow") - F.col("fee")).alias("net_cash_flow"),
        F.when(F.col("complete"), F.col("mean")).alias("mean_monthly_inflow"), F.when(F.col("complete"), F.col("deviation")).alias("monthly_inflow_population_stddev"),
        F.when(F.col("complete"), F.try_divide("deviation", "mean")).alias("monthly_inflow_coefficient_of_variation"),
        "balance_observation_count", F.try_divide("balance_observation_count", "calendar_period_count").alias("balance_availability_rate"),
        "negative_balance_count", F.try_divide("negative_balance_count", "balance_observation_count").alias("negative_balance_rate"),
        "internal_transfer_count", "uncertain_transfer_count", "fee_event_count", "reversal_count", F.coalesce("reversed", F.lit(0)).alias("reversed_amount"), _codes(CASH_CODES).alias("reason_codes"),
    )


def _due_profile(records: DataFrame, kinds: tuple[str, ...], grace: int, extra: list[Column]) -> DataFrame:
    """What rent and utilities share: obligations, what was paid for them and when, over those that can be observed."""
    if grace < 0:
        raise ValueError("grace days cannot be negative")
    rows = _marked(records)
    key = ["entity_id", "source_id", "obligation_id"]
    owed, pays, alters = _kind(*kinds) & F.col("stands"), _kind("payment", "partial_payment"), _kind("adjustment", "waiver") & F.col("counts")
    day = F.to_date("event_time")
    every = Window.partitionBy(*key)
    run = every.orderBy(day, "observed_at", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def of_obligation(c: str) -> Column:
        return F.max_by(F.when(owed, F.col(c)), F.when(owed, F.col("record_id")))

    linked = pays & F.col("counts")
    foreign = (linked | alters) & (F.col("currency") != of_obligation("currency").over(every))
    steps = rows.filter(_kind(*kinds, "payment", "partial_payment", "adjustment", "waiver")).select(
        "*", (of_obligation("amount").over(every) + F.sum(F.when(alters, F.col("amount")).otherwise(0)).over(every)).alias("owing"),
        F.sum(F.when(linked, F.col("amount")).otherwise(0)).over(run).alias("so_far"), F.coalesce(foreign, F.lit(False)).alias("foreign"),
    )
    keys = steps.groupBy(*key).agg(
        F.max(owed).alias("scheduled"), of_obligation("amount").alias("amount"), of_obligation("due_date").alias("due_date"), F.max("owing").alias("owing"), F.count_if(linked).alias("linked"), F.count_if(pays).alias("payments"),
        F.sum(F.when(linked, F.col("amount")).otherwise(0)).alias("paid"), F.min(F.when(linked & (F.col("so_far") >= F.col("owing")), day)).alias("completed_on"), F.max(linked & _kind("partial_payment")).alias("partial"),
        F.when(F.max("foreign"), F.raise_error(F.lit("ad_linkage_family_mismatch"))).alias("mixed"),
    ).filter("mixed IS NULL")
    plan = keys.groupBy("entity_id").agg(
        F.count_if("scheduled").alias("scheduled_obligation_count"), F.sum(F.when(F.col("scheduled"), F.col("amount")).otherwise(0)).alias("scheduled_amount"), F.sum(F.when(~F.col("scheduled"), F.col("payments")).otherwise(0)).alias("strays")
    )
    gaps = records.filter(_kind("reporting_unavailable")).select("entity_id", F.to_date("period_start").alias("a"), F.to_date("period_end").alias("b"))
    o, g = keys.filter("scheduled AND linked > 0").alias("o"), gaps.alias("g")
    seen = o.join(g, (F.col("o.entity_id") == F.col("g.entity_id")) & F.col("o.due_date").between(F.col("g.a"), F.col("g.b")), "left_anti").groupBy("entity_id").agg(
        F.count("*").alias("observable_obligation_count"), F.count("completed_on").alias("fully_paid_count"), F.count_if(F.col("completed_on") <= F.date_add("due_date", grace)).alias("timely_paid_count"),
        F.count_if("partial").alias("partial_payment_count"), F.sum("owing").alias("observable_obligation_amount"), F.sum("paid").alias("linked_payment_amount"),
    )
    whole = rows.groupBy("entity_id").agg(
        F.count_if(_kind("reversal")).alias("reversal_count"), F.count_if(_kind("reporting_unavailable")).alias("reporting_gap_count"), F.max(_kind("partial_payment")).alias("any_partial"), F.max(_kind("waiver")).alias("any_waiver"), *extra
    )
    counts = ["scheduled_obligation_count", "strays", "observable_obligation_count", "fully_paid_count", "timely_paid_count", "partial_payment_count", "scheduled_amount", "observable_obligation_amount", "linked_payment_amount"]
    out = whole.join(plan, "entity_id", "left").join(seen, "entity_id", "left").fillna(0, counts)
    n, m = "observable_obligation_count", "scheduled_obligation_count"
    rates = {"provider_coverage_rate": (n, m), "fully_paid_rate": ("fully_paid_count", n), "timely_paid_rate": ("timely_paid_count", n), "partial_payment_rate": ("partial_payment_count", n)}
    out = out.withColumn("state", F.when(F.col(n) > 0, "available").otherwise("unavailable"))
    out = out.withColumns({k: F.try_divide(a, b) for k, (a, b) in rates.items()})
    return out.withColumn("amount_coverage_rate", F.try_divide(F.col("linked_payment_amount").cast("double"), F.col("observable_obligation_amount").cast("double")))


def rent_profile(records: DataFrame, grace: int) -> DataFrame:
    """Obligations of rent; on time means within ``grace`` days. Also needs (obligation_id, due_date, currency, period_start, period_end)."""
    out = _due_profile(records, ("obligation",), grace, [])
    return out.withColumn("grace_days", F.lit(grace)).withColumn("reason_codes", _codes(RENT_CODES)).drop("strays", "any_partial", "any_waiver")


def utility_profile(records: DataFrame) -> DataFrame:
    """Bills of utilities, estimated ones included, with adjustments, interruptions, providers and services (null is one).

    Also needs what rent does, and (provider_id, service_type).
    """
    bill = _kind("bill", "estimated_bill") & F.col("stands")

    def kinds(c: str) -> Column:
        return F.countDistinct(F.when(bill, F.col(c))) + F.max((bill & F.col(c).isNull()).cast("long"))

    extra = [
        F.sum(F.when(bill, F.col("amount")).otherwise(0)).alias("original_billed_amount"), F.sum(F.when(_kind("adjustment"), F.col("amount")).otherwise(0)).alias("adjustment_total"),
        F.count_if(bill).alias("bills"), F.count_if(bill & _kind("estimated_bill")).alias("estimated_bill_count"), F.max(_kind("estimated_bill")).alias("any_estimate"), F.count_if(_kind("adjustment")).alias("adjustment_count"),
        F.count_if(_kind("service_interruption")).alias("service_interruption_count"), kinds("provider_id").alias("provider_count"), kinds("service_type").alias("service_type_count"),
    ]
    out = _due_profile(records, ("bill", "estimated_bill"), 0, extra).withColumn("reason_codes", _codes(UTILITY_CODES))
    out = out.withColumn("net_adjusted_obligation", F.col("original_billed_amount") + F.col("adjustment_total"))
    out = out.withColumn("estimated_bill_rate", F.try_divide("estimated_bill_count", "bills")).withColumn("adjustment_rate", F.try_divide("adjustment_count", "bills"))
    return out.drop("strays", "bills", "any_partial", "any_waiver", "any_estimate")
