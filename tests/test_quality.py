"""Quality scopes: hand-made records, and random ones against a walk over them one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paritas.functions import typed
from paritas.operators import quality

RECORD = "source_id string, source_version string, record_id string, entity_id string, signal_family string, currency string, evidence_start timestamp, evidence_end timestamp, observed_at timestamp, status string, event_type string, category_id string, transfer_scope string, period_start timestamp, period_end timestamp, revision_of string, reversal_of string"
SOURCE = "source_id string, source_version string, signal_family string, provider_id string, currency_policy string, default_currency string, coverage_end timestamp"
AS_OF, EXECUTION = datetime(2026, 1, 1), datetime(2026, 2, 1)
SOURCES = [("bank", "1", "cash_flow", "p1", "single_currency", "USD", None), ("home", "1", "rent", "p2", "multi_currency", None, datetime(2025, 12, 31))]


def record(i, entity="e1", at=datetime(2025, 12, 1), seen=datetime(2025, 12, 1), status="posted", event="inflow", currency="USD", category="c", transfer=None, period=None, revises=None, reverses=None, source="bank"):
    start, end = period or (at, at)
    return (source, "1", i, entity, {"bank": "cash_flow", "home": "rent"}[source], currency, start, end, seen, status, event, category, transfer, *(period or (None, None)), revises, reverses)


def made(spark, records, entities, coverages, sources=SOURCES):
    e = spark.createDataFrame(entities, "entity_id string, g string, h string")
    c = spark.createDataFrame(coverages, "entity_id string, coverage_stratum string, assessed_at timestamp, evidence_available boolean")
    out = quality.quality(e, ["g", "h"], spark.createDataFrame(records, RECORD).repartition(3), c, ["thin", "thick"], spark.createDataFrame(sources, SOURCE), F.lit(AS_OF), F.lit(EXECUTION))
    return {k: v.collect() for k, v in out.items()}


COVERED = ("e1", "thick", datetime(2025, 12, 1), True)


def test_five_records(spark):
    records = [record("original"), record("revision", seen=datetime(2025, 12, 2), revises="original"), record("pending", status="pending"), record("late", seen=datetime(2026, 1, 2)), record("wrong", currency="EUR")]
    got = made(spark, records, [("e1", "A", None), ("e2", "B", None)], [COVERED], SOURCES[:1])
    scopes = {r.scope_key: r for r in got["scopes"]}
    r = scopes["overall"]
    assert (r.entity_count, r.input_record_count, r.authoritative_record_count, r.eligible_record_count, r.excluded_record_count, r.unavailable_record_count) == (2, 5, 1, 2, 2, 1)
    assert (r.unavailable_entity_count, r.excluded_entity_count, r.revision_count, r.observation_start, r.refresh_lag_seconds) == (1, 0, 1, datetime(2025, 12, 1), 30 * 86400)
    assert {(p.scope_key, p.source_id, p.entity_coverage_rate) for p in got["providers"]} >= {("overall", "bank", 0.5), (f"group.{typed.token('g')}.{typed.token('A')}", "bank", 1.0), ("coverage.unavailable", "bank", 0.0)}
    reasons = {(x.code, x.signal_family): (x["count"], x.denominator, x.unit, x.population, x.disposition) for x in got["reasons"] if x.scope_key == "overall"}
    assert reasons == {
        ("ad_observed_after_decision", "cash_flow"): (1, 5, "record", "records_in_scope", "exclude"), ("ad_currency_inconsistent", "cash_flow"): (1, 5, "record", "records_in_scope", "exclude"),
        ("ad_pending_record", "cash_flow"): (1, 5, "record", "records_in_scope", "unavailable"), ("ad_signal_not_provided", "cash_flow"): (1, 2, "entity", "entities_in_scope", "unavailable"),
        ("ad_coverage_stratum_unavailable", None): (1, 2, "entity", "entities_in_scope", "unavailable"),
    }
    assert {k for k in scopes if k.startswith("coverage.")} == {f"coverage.{typed.token(v)}" for v in ("thick", "thin")} | {"coverage.unavailable"}
    assert scopes["family.cash_flow"].input_record_count == 5 and scopes[f"coverage.{typed.token('thin')}"].observation_start is None


def test_periods_and_no_signal(spark):
    day = datetime
    periods = [record("a", period=(day(2025, 1, 1), day(2025, 1, 31))), record("b", period=(day(2025, 1, 15), day(2025, 2, 15))), record("c", period=(day(2025, 3, 1), day(2025, 3, 31)))]
    got = made(spark, periods, [("e1", "A", "x"), ("e3", None, "x")], [COVERED])
    said = {x.code: x["count"] for x in got["reasons"] if x.scope_key == "overall" and x.unit == "record"}
    assert said == {"ad_period_overlap": 2, "ad_temporal_gap": 1}
    lacking = {(x.signal_family, x.scope_key): x["count"] for x in got["reasons"] if x.code == "ad_signal_not_provided"}
    assert lacking["rent", "overall"] == 2 and lacking["cash_flow", "overall"] == 1 and ("rent", "family.cash_flow") not in lacking
    none = made(spark, [], [("e2", "B", None)], [])
    r = {x.scope_key: x for x in none["scopes"]}["overall"]
    assert (r.input_record_count, r.unavailable_entity_count, r.freshness_seconds) == (0, 1, None)


@pytest.mark.parametrize(
    "change,message",
    [
        ({"records": [record("a", at=datetime(2026, 2, 2), seen=datetime(2026, 2, 2))]}, "ad_future_timestamp"),
        ({"records": [record("a", at=datetime(2026, 1, 5), seen=datetime(2026, 1, 6))]}, "ad_feature_after_decision"),
        ({"records": [record("a", entity="zz")]}, "declared population"),
        ({"records": [record("a"), record("a")]}, "ad_duplicate_record_identity"),
        ({"entities": [("e1", "A", None), ("e1", "B", None)]}, "unique"),
        ({"coverages": [("e1", "other", datetime(2025, 1, 1), True)]}, "allowed"),
        ({"coverages": [("e1", "thin", datetime(2026, 3, 1), True)]}, "ad_future_timestamp"),
        ({"sources": [(*SOURCES[0][:6], datetime(2026, 3, 1)), SOURCES[1]]}, "ad_future_timestamp"),
    ],
)
def test_faulty_evidence_raises(spark, change, message):
    given = {"records": [record("a")], "entities": [("e1", "A", None)], "coverages": [COVERED]} | change
    with pytest.raises(ValueError, match=message):
        made(spark, **given)


def test_contract_is_closed():
    assert len(quality.CONTRACT) == 53 == sum(len(v) for v in quality.DISPOSITIONS.values())


def test_random_population(spark):
    rng = random.Random(7)
    entities = [(f"e{i}", rng.choice(["A", "B", None]), rng.choice(["x", "y"])) for i in range(25)]
    coverages = [(e, rng.choice(["thin", "thick"]), rng.choice([datetime(2025, 6, 1), datetime(2026, 1, 15)]), rng.random() < 0.8) for e, *_ in entities[:20]]
    records = []
    for n in range(220):
        entity, source = rng.choice(entities[:22])[0], rng.choice(["bank", "home"])
        at = datetime(2025, rng.randint(1, 12), rng.randint(1, 28))
        older = [r for r in records if r[0] == source and r[3] == entity]
        target = rng.choice(older) if older and rng.random() < 0.4 else None
        seen = max(at, target[8]) + timedelta(hours=n + 1) if target else rng.choice([at, datetime(2026, 1, 3)]) + timedelta(seconds=n)
        event = rng.choice(["inflow", "partial_payment", "waiver", "reporting_unavailable", "payment"])
        link = rng.choice(["revises", "reverses"])
        records.append(record(f"r{n}", entity, at, seen, rng.choice(["posted", "posted", "pending", "unavailable"]), event, "USD" if entity < "e2" else "EUR", rng.choice(["c", None]), rng.choice([None, "uncertain"]), (at, at + timedelta(days=rng.randint(0, 40))) if rng.random() < 0.4 and at.month < 11 else None, target[2] if target and link == "revises" else None, target[2] if target and link == "reverses" else None, source))
    got = made(spark, records, entities, coverages)

    rows = [dict(zip([c.split(" ")[0] for c in RECORD.split(", ")], r)) for r in records]
    for r in rows:
        why = set()
        if r["source_id"] == "bank" and r["currency"] != "USD":
            why.add("ad_currency_inconsistent")
        if r["observed_at"] > AS_OF:
            why.add("ad_revision_after_decision" if r["revision_of"] else "ad_observed_after_decision")
        elif r["status"] == "pending":
            why.add("ad_pending_record")
        if r["status"] == "unavailable" or r["event_type"] == "reporting_unavailable":
            why.add("ad_provider_reporting_gap")
        cash = r["signal_family"] == "cash_flow"
        if cash and r["reversal_of"]:
            why.add("ad_cashflow_reversal_observed")
        if cash and r["event_type"] == "inflow" and r["category_id"] is None:
            why.add("ad_cashflow_category_unresolved")
        if r["transfer_scope"]:
            why.add("ad_uncertain_transfer")
        if not cash and r["event_type"] in ("partial_payment", "waiver"):
            why.add(f"ad_rent_{r['event_type']}_observed")
        r["why"] = why
        kinds = {quality.CONTRACT[c] for c in why}
        r["fate"] = "excluded" if "exclude" in kinds else "unavailable" if "unavailable" in kinds else "eligible"
    by_id = {r["record_id"]: r for r in rows}
    fit = [r for r in rows if r["fate"] == "eligible"]
    revised = {r["revision_of"] for r in fit}
    last = {}
    for r in fit:
        if r["record_id"] not in revised:
            root = r
            while root["revision_of"]:
                root = by_id[root["revision_of"]]
            if root["record_id"] not in last or last[root["record_id"]]["observed_at"] < r["observed_at"]:
                last[root["record_id"]] = r
    auth = {r["record_id"] for r in last.values()}
    for key in {(r["source_id"], r["entity_id"]) for r in rows}:
        own = sorted((r for r in rows if (r["source_id"], r["entity_id"]) == key and r["record_id"] in auth and r["period_start"]), key=lambda r: (r["period_start"], r["observed_at"], r["record_id"]))
        for a, b in zip(own, own[1:]):
            if b["period_start"] <= a["period_end"]:
                a["why"].add("ad_period_overlap")
                b["why"].add("ad_period_overlap")
            elif (b["period_start"] - a["period_end"]).total_seconds() > 1:
                b["why"].add("ad_temporal_gap")
    cover = {c[0]: c for c in coverages}
    have = {(r["entity_id"], r["signal_family"]) for r in rows}
    said = {}
    for e, *_ in entities:
        c = cover.get(e)
        said[e] = [("ad_coverage_stratum_unavailable", None)] if c is None or not c[3] else [("ad_observed_after_decision", None)] if c[2] > AS_OF else []
        said[e] += [("ad_signal_not_provided", f) for f in ("cash_flow", "rent") if (e, f) not in have]
    gone = lambda e: any(f is None for _, f in said[e])
    scopes = {"overall": (None, {e[0] for e in entities}), "family.cash_flow": ("cash_flow", {e[0] for e in entities}), "family.rent": ("rent", {e[0] for e in entities})}
    scopes |= {f"coverage.{typed.token(v)}": (None, {e for e, c in cover.items() if c[1] == v and not gone(e)}) for v in ("thin", "thick")} | {"coverage.unavailable": (None, {e[0] for e in entities if gone(e[0])})}
    for at, name in ((1, "g"), (2, "h")):
        scopes |= {f"group.{typed.token(name)}.{typed.token(v)}": (None, {e[0] for e in entities if e[at] == v}) for v in {e[at] for e in entities} - {None}}
    assert {r.scope_key for r in got["scopes"]} == scopes.keys()
    found = {r.scope_key: r for r in got["scopes"]}
    reasons = {(x.scope_key, x.code, x.signal_family, x.source_id): (x["count"], x.denominator) for x in got["reasons"]}
    want = {}
    for key, (family, people) in scopes.items():
        mine = [r for r in rows if r["entity_id"] in people and family in (None, r["signal_family"])]
        own = [r for r in mine if r["record_id"] in auth]
        r = found[key]
        assert (r.entity_count, r.input_record_count, r.authoritative_record_count) == (len(people), len(mine), len(own)), key
        assert (r.eligible_record_count, r.excluded_record_count, r.unavailable_record_count) == tuple(sum(x["fate"] == f for x in mine) for f in ("eligible", "excluded", "unavailable"))
        codes = {e: [(c, f) for c, f in said[e] if family is None or f in (None, family)] for e in people}
        late = {e for e in people if ("ad_observed_after_decision", None) in codes[e]}
        assert (r.excluded_entity_count, r.unavailable_entity_count) == (len(late), sum(bool(codes[e]) and e not in late for e in people))
        assert (r.revision_count, r.reversal_count) == (sum(bool(x["revision_of"]) for x in mine), sum(bool(x["reversal_of"]) for x in mine))
        if own:
            first, end = min(x["evidence_start"] for x in own), max(x["evidence_end"] for x in own)
            assert (r.observation_start, r.observation_end, r.observation_duration_seconds, r.freshness_seconds) == (first, end, (end - first).total_seconds(), (AS_OF - end).total_seconds())
            assert r.refresh_lag_seconds == (AS_OF - max(x["observed_at"] for x in own)).total_seconds()
        for x in mine:
            for code in x["why"]:
                k = (key, code, x["signal_family"], x["source_id"])
                want[k] = (want.get(k, (0,))[0] + 1, sum(y["source_id"] == x["source_id"] for y in mine))
        for e in people:
            for code, f in codes[e]:
                k = (key, code, f, None)
                want[k] = (want.get(k, (0,))[0] + 1, len(people))
        for p in (p for p in got["providers"] if p.scope_key == key):
            had = [x for x in own if x["source_id"] == p.source_id]
            assert (p.record_count, p.entity_count) == (len(had), len({x["entity_id"] for x in had}))
    assert reasons == want
