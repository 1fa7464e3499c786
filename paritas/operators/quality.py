"""Quality evidence of alternative data by scope: eligibility, coverage, freshness, providers and reasons.

A record's reasons are one array, an entity's are another one. Records are summed by (entity, source) first, and only
then meet the scopes of their entity: a record is never repeated for the scopes that overlap on it, and an
entity is one row of a scope and source, so distinct entities are counts. Links are checked over all records
before any is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions import typed
from paritas.operators import lineage
from paritas.operators.altdata import feature_gate, instant

#: The closed contract of reasons, by what becomes of a record or an entity.
DISPOSITIONS = {
    "error": (
        "ad_missing_required_field", "ad_unknown_field", "ad_duplicate_record_identity", "ad_source_not_declared", "ad_source_family_mismatch", "ad_source_version_mismatch",
        "ad_unsupported_event_type", "ad_invalid_identifier", "ad_permission_reference_unavailable", "ad_invalid_window_order", "ad_feature_performance_overlap", "ad_feature_after_decision",
        "ad_outcome_not_post_decision", "ad_future_timestamp", "ad_unrecognized_outcome_label", "ad_non_monotonic_history", "ad_invalid_amount", "ad_currency_missing",
        "ad_revision_target_missing", "ad_reversal_target_missing", "ad_linkage_family_mismatch",
    ),
    "exclude": ("ad_observed_after_decision", "ad_revision_after_decision", "ad_outcome_outside_window", "ad_currency_inconsistent"),
    "unavailable": (
        "ad_label_immature", "ad_unmatched_obligation", "ad_signal_not_provided", "ad_provider_reporting_gap", "ad_obligation_schedule_unavailable", "ad_due_date_unavailable",
        "ad_balance_history_unavailable", "ad_insufficient_calendar_coverage", "ad_coverage_stratum_unavailable", "ad_provider_nonparticipation", "ad_pending_record",
        "ad_sparse_report_cell", "ad_complementary_suppression", "ad_insufficient_fold_support", "ad_high_cardinality_unsupported", "ad_proxy_model_nonconvergence",
    ),
    "observe": (
        "ad_period_overlap", "ad_temporal_gap", "ad_uncertain_transfer", "ad_small_group", "ad_proxy_holdout_unstable", "ad_cashflow_reversal_observed", "ad_cashflow_category_unresolved",
        "ad_rent_partial_payment_observed", "ad_rent_waiver_observed", "ad_utility_estimated_bill_observed", "ad_utility_adjustment_observed", "ad_service_interruption_observed",
    ),
}
CONTRACT = {code: kind for kind, codes in DISPOSITIONS.items() for code in codes}
#: What an event of a family says about its record.
OBSERVED = {
    ("rent", "partial_payment"): "ad_rent_partial_payment_observed", ("rent", "waiver"): "ad_rent_waiver_observed", ("utility", "estimated_bill"): "ad_utility_estimated_bill_observed",
    ("utility", "adjustment"): "ad_utility_adjustment_observed", ("utility", "service_interruption"): "ad_service_interruption_observed",
}


def disposition_of(codes: Column, kind: str) -> Column:
    """Whether one of an array of codes has this disposition."""
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in DISPOSITIONS[kind]]))


def record_reasons(records: DataFrame, sources: DataFrame, as_of: Column, execution: Column) -> DataFrame:
    """``records`` with ``start``, ``end`` (instants) and ``reasons``; raises where a record fails the gate."""
    known = F.broadcast(sources.select("source_id", "currency_policy", "default_currency"))  # declared, one row a source
    df = records.join(known, "source_id").withColumns({"start": instant(F.col("evidence_start")), "end": instant(F.col("evidence_end"), end=dict(records.dtypes)["evidence_end"] == "date")})
    df = df.withColumn("__gate", feature_gate(F.col("start"), F.col("end"), F.col("observed_at"), F.col("revision_of").isNotNull(), F.col("status"), as_of, execution))
    errors = {r[0] for r in df.filter("__gate.disposition = 'error'").select("__gate.code").distinct().collect()}
    if errors:
        raise ValueError("ad_future_timestamp" if "ad_future_timestamp" in errors else min(errors))
    cash, event = F.col("signal_family") == "cash_flow", F.col("event_type")
    tests = [
        (F.col("currency").isNotNull() & (F.col("currency_policy") == "single_currency") & (F.col("currency") != F.col("default_currency")), F.lit("ad_currency_inconsistent")),
        (F.col("__gate.code").isNotNull(), F.col("__gate.code")),
        ((F.col("status") == "unavailable") | (event == "reporting_unavailable"), F.lit("ad_provider_reporting_gap")),
        (F.col("reversal_of").isNotNull() & cash, F.lit("ad_cashflow_reversal_observed")),
        (cash & event.isin("inflow", "outflow") & F.col("category_id").isNull(), F.lit("ad_cashflow_category_unresolved")),
        (F.col("transfer_scope") == "uncertain", F.lit("ad_uncertain_transfer")),
        *[((F.col("signal_family") == f) & (event == e), F.lit(code)) for (f, e), code in OBSERVED.items()],
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))).drop("__gate", "currency_policy", "default_currency")


def with_authority(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Records with ``authoritative`` (the last eligible terminal version of its root) and, for these, reasons of their periods."""
    key = lineage.KEY
    fit = df.filter(~disposition_of(F.col("reasons"), "exclude") & ~disposition_of(F.col("reasons"), "unavailable"))
    revised = fit.filter("revision_of IS NOT NULL").select("source_id", "source_version", F.col("revision_of").alias("record_id")).distinct()
    last = lineage.latest_by_root(fit.join(revised, key, "left_anti"), roots, times_must_differ=False).select(*key).withColumn("authoritative", F.lit(True))
    out = df.join(last, key, "left").withColumn("authoritative", F.coalesce("authoritative", F.lit(False)))
    dates = dict(df.dtypes)
    periods = out.filter("authoritative AND period_start IS NOT NULL").select(*key, "entity_id", "observed_at", instant(F.col("period_start")).alias("__a"), instant(F.col("period_end"), end=dates["period_end"] == "date").alias("__b"))
    w = Window.partitionBy("source_id", "entity_id").orderBy("__a", "observed_at", "record_id")  # one entity's history
    before, after = F.lag("__b").over(w), F.lead("__a").over(w)
    overlap = F.coalesce(F.col("__a") <= before, F.lit(False)) | F.coalesce(after <= F.col("__b"), F.lit(False))
    gap = F.coalesce((F.col("__a") > before + F.expr("INTERVAL 1 SECOND")), F.lit(False))
    seen = periods.select(*key, F.array_compact(F.array(F.when(overlap, F.lit("ad_period_overlap")), F.when(gap, F.lit("ad_temporal_gap")))).alias("__more"))
    return out.join(seen, key, "left").withColumn("reasons", F.concat("reasons", F.coalesce("__more", F.array().cast("array<string>")))).drop("__more")


def entity_scopes(entities: DataFrame, groups: list[str], records: DataFrame, coverages: DataFrame, strata: list, families: list[str], as_of: Column, execution: Column) -> tuple[DataFrame, DataFrame]:
    """(entity_id, scopes, late, uncovered, missing) of every entity, and the dimension of scopes."""
    spark = entities.sparkSession
    if not coverages.filter(F.col("evidence_available") & (F.col("assessed_at") > execution)).isEmpty():
        raise ValueError("ad_future_timestamp")
    dimension = [("overall", "overall", None, None, None)]
    dimension += [(f"family.{f}", "signal_family", f, None, None) for f in sorted(families)]
    dimension += [(f"coverage.{typed.token(v)}", "coverage", None, "coverage_stratum", str(v)) for v in sorted(strata)] + [("coverage.unavailable", "coverage", None, "coverage_stratum", None)]
    for g in sorted(groups):
        values = sorted(r[0] for r in entities.select(g).distinct().collect() if r[0] is not None)  # labels, not rows
        dimension += [(f"group.{typed.token(g)}.{typed.token(v)}", "audit_group", None, g, str(v)) for v in values]
    names = spark.createDataFrame([(i, *d) for i, d in enumerate(dimension)], "place int, scope_key string, scope_kind string, signal_family string, attribute string, `group` string")
    supplied = records.groupBy("entity_id").agg(F.collect_set("signal_family").alias("__supplied"))  # a few families
    e = entities.join(coverages.select("entity_id", "coverage_stratum", "assessed_at", "evidence_available"), "entity_id", "left").join(supplied, "entity_id", "left")
    covered = F.coalesce(F.col("evidence_available"), F.lit(False))
    late = covered & (F.col("assessed_at") > as_of)
    if not e.filter(covered & ~F.coalesce(F.col("coverage_stratum").isin(list(strata)), F.lit(False))).isEmpty():
        raise ValueError("coverage_stratum must be an allowed one")
    missing = F.array_except(F.array(*[F.lit(f) for f in sorted(families)]), F.coalesce("__supplied", F.array().cast("array<string>")))
    keys = {(a, v): k for k, _, _, a, v in dimension if a}
    of = [F.lit("overall"), F.when(covered & ~late, F.coalesce(*[F.when(F.col("coverage_stratum") == v, F.lit(keys["coverage_stratum", str(v)])) for v in strata])).otherwise(F.lit("coverage.unavailable"))]
    for g in groups:
        own = [(v, k) for (a, v), k in keys.items() if a == g]
        if own:
            of.append(F.element_at(F.create_map(*[F.lit(x) for pair in own for x in pair]), F.col(g).cast("string")))
    return e.select("entity_id", F.array_compact(F.array(*of)).alias("scopes"), late.alias("late"), (~covered).alias("uncovered"), missing.alias("missing")), names


def quality(entities: DataFrame, groups: list[str], records: DataFrame, coverages: DataFrame, strata: list, sources: DataFrame, as_of: Column, execution: Column) -> dict[str, DataFrame]:
    """``scopes``, ``providers`` and ``reasons`` of the whole population; raises where evidence is faulty."""
    if not sources.filter(F.col("coverage_end") > execution).isEmpty():
        raise ValueError("ad_future_timestamp")
    records = lineage.checkpointed(records)  # read many times from here on
    for df, what in ((entities, "population entity"), (coverages, "credit coverage")):
        if not df.groupBy("entity_id").count().filter("count > 1").isEmpty():
            raise ValueError(f"{what} identities must be unique")
    for df, what in ((records, "signal record"), (coverages, "credit coverage")):
        if not df.join(entities.select("entity_id"), "entity_id", "left_anti").isEmpty():
            raise ValueError(f"every {what} must belong to the declared population")
    families = sorted(r[0] for r in sources.select("signal_family").distinct().collect())
    roots = lineage.checked_roots(records, sources)
    lineage.authoritative_records(records, sources, as_of, execution, roots)  # raises at equal times
    members, names = entity_scopes(entities, groups, records, coverages, strata, families, as_of, execution)
    names = F.broadcast(names)  # a row a label
    members = lineage.checkpointed(members)
    rows = lineage.checkpointed(with_authority(record_reasons(records, sources, as_of, execution), roots))

    # records by entity and source
    out_, away = disposition_of(F.col("reasons"), "exclude"), disposition_of(F.col("reasons"), "unavailable")
    auth = F.col("authoritative")
    count = lambda c: F.sum(c.cast("long"))
    by_entity = rows.groupBy("entity_id", "source_id", "signal_family").agg(
        F.count(F.lit(1)).alias("n"), count(auth).alias("authoritative"), count(~out_ & ~away).alias("eligible"), count(out_).alias("excluded"), count(~out_ & away).alias("unavailable"),
        count(F.col("revision_of").isNotNull()).alias("revisions"), count(F.col("reversal_of").isNotNull()).alias("reversals"),
        F.min(F.when(auth, F.col("start"))).alias("first"), F.max(F.when(auth, F.col("end"))).alias("last"), F.max(F.when(auth, F.col("observed_at"))).alias("seen"),
    )
    scoped = by_entity.join(members.select("entity_id", "scopes"), "entity_id")
    scoped = scoped.withColumn("scope_key", F.explode(F.concat("scopes", F.array(F.concat(F.lit("family."), "signal_family"))))).drop("scopes")
    sums = ("n", "authoritative", "eligible", "excluded", "unavailable", "revisions", "reversals")
    measured = scoped.groupBy("scope_key").agg(*[F.sum(c).alias(c) for c in sums], F.min("first").alias("first"), F.max("last").alias("last"), F.max("seen").alias("seen"))

    # entities by scope: a family's scope looks at that family's signals only
    gone = F.col("uncovered") | (F.size("missing") > 0)
    own = F.transform("scopes", lambda s: F.struct(s.alias("scope_key"), gone.alias("gone")))
    each = F.array(*[F.struct(F.lit(f"family.{f}").alias("scope_key"), (F.col("uncovered") | F.array_contains("missing", f)).alias("gone")) for f in families]) if families else F.array().cast("array<struct<scope_key:string,gone:boolean>>")
    people = members.select("late", F.explode(F.concat(own, each)).alias("x")).groupBy("x.scope_key").agg(F.count(F.lit(1)).alias("entities"), count(F.col("late")).alias("late"), count(~F.col("late") & F.col("x.gone")).alias("gone"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    at = as_of.cast("timestamp")
    scopes = names.join(people, "scope_key", "left").join(measured, "scope_key", "left").select(
        "place", "scope_key", "scope_kind", "signal_family", "attribute", "group", zero("entities").alias("entity_count"), zero("n").alias("input_record_count"), zero("authoritative").alias("authoritative_record_count"),
        zero("eligible").alias("eligible_record_count"), zero("excluded").alias("excluded_record_count"), zero("unavailable").alias("unavailable_record_count"), zero("late").alias("excluded_entity_count"),
        zero("gone").alias("unavailable_entity_count"), zero("revisions").alias("revision_count"), zero("reversals").alias("reversal_count"), F.col("first").alias("observation_start"), F.col("last").alias("observation_end"),
        seconds(F.col("last"), F.col("first")).alias("observation_duration_seconds"), seconds(at, F.col("last")).alias("freshness_seconds"), seconds(at, F.col("seen")).alias("refresh_lag_seconds"),
    )
    # providers: an entity is one row of a scope and source
    found = scoped.filter("authoritative > 0").groupBy("scope_key", "source_id").agg(F.count(F.lit(1)).alias("k"), F.sum("authoritative").alias("r"))
    every = scopes.select("place", "scope_key", F.col("signal_family").alias("__family"), "entity_count").crossJoin(F.broadcast(sources.select("source_id", "provider_id", "signal_family")))  # labels times sources
    every = every.filter(F.col("__family").isNull() | (F.col("__family") == F.col("signal_family")))
    providers = every.join(found, ["scope_key", "source_id"], "left").select(
        "scope_key", "source_id", "provider_id", "signal_family", zero("k").alias("entity_count"), zero("r").alias("record_count"), F.coalesce(F.try_divide(zero("k"), F.col("entity_count")), F.lit(0.0)).alias("entity_coverage_rate")
    )
    # reasons of records, out of the records in scope of their source; of entities, out of the entities in scope
    said = rows.select("entity_id", "source_id", "signal_family", F.explode(F.array_distinct("reasons")).alias("code")).groupBy("entity_id", "source_id", "signal_family", "code").agg(F.count(F.lit(1)).alias("k"))
    said = said.join(members.select("entity_id", "scopes"), "entity_id").withColumn("scope_key", F.explode(F.concat("scopes", F.array(F.concat(F.lit("family."), "signal_family")))))
    said = said.groupBy("scope_key", "code", "signal_family", "source_id").agg(F.sum("k").alias("count"))
    bases = scoped.groupBy("scope_key", "signal_family", "source_id").agg(F.sum("n").alias("denominator"))
    of_records = said.join(bases, ["scope_key", "signal_family", "source_id"]).withColumn("unit", F.lit("record"))
    whole = F.array_compact(F.array(F.when(F.col("late"), F.struct(F.lit("ad_observed_after_decision").alias("code"), F.lit(None).cast("string").alias("f"))), F.when(F.col("uncovered"), F.struct(F.lit("ad_coverage_stratum_unavailable").alias("code"), F.lit(None).cast("string").alias("f")))))
    lacking = F.transform("missing", lambda f: F.struct(F.lit("ad_signal_not_provided").alias("code"), f.alias("f")))
    people_said = members.select("scopes", F.explode(F.concat(whole, lacking)).alias("x")).select("scopes", "x.code", F.col("x.f").alias("signal_family"))
    reach = F.when(F.col("signal_family").isNull(), F.array(*[F.lit(f"family.{f}") for f in families]) if families else F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("family."), "signal_family")))
    people_said = people_said.withColumn("scope_key", F.explode(F.concat("scopes", reach))).groupBy("scope_key", "code", "signal_family").agg(F.count(F.lit(1)).alias("count"))
    of_entities = people_said.join(scopes.select("scope_key", F.col("entity_count").alias("denominator")), "scope_key").withColumns({"unit": F.lit("entity"), "source_id": F.lit(None).cast(dict(said.dtypes)["source_id"])})
    kinds = F.create_map(*[F.lit(x) for pair in CONTRACT.items() for x in pair])
    reasons = of_records.unionByName(of_entities).select("scope_key", "code", F.element_at(kinds, F.col("code")).alias("disposition"), "count", "unit", F.concat(F.when(F.col("unit") == "record", "records").otherwise("entities"), F.lit("_in_scope")).alias("population"), "denominator", "source_id", "signal_family")
    return {"scopes": scopes, "providers": providers, "reasons": reasons}
