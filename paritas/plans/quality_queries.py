"""Queries over quality scopes of the orders of a customer as signal records: name -> (DataFrame, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.functions import typed
from paritas.operators import quality
from paritas.plans.base import SEGMENTS, table
from paritas.plans.lineage_queries import ROOTS, sources, versions

AS_OF, EXECUTION, STRATA = "2024-03-01 00:00:00", "2024-12-31 00:00:00", ["thin", "thick"]
_RENT, _UTILITY = ("obligation", "payment", "partial_payment", "waiver", "reporting_unavailable"), ("bill", "estimated_bill", "adjustment", "service_interruption", "payment")


def _quality(s, d, part):
    k, who = F.col("record_id"), F.col("entity_id")
    event = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % 5 + 1).cast("int"))
    records = versions(s, d).withColumns({
        "currency": F.when(who % 29 == 0, "EUR").otherwise("USD"), "observed_at": F.when(who % 17 == 0, F.col("observed_at") + F.expr("INTERVAL 60 DAY")).otherwise(F.col("observed_at")),
        "event_type": F.when(F.col("signal_family") == "rent", event(_RENT)).otherwise(event(_UTILITY)), "category_id": F.lit(None).cast("string"), "transfer_scope": F.when(k % 13 == 0, "uncertain"),
        "period_start": F.when(k % 3 == 1, F.col("evidence_start")), "period_end": F.when(k % 3 == 1, F.date_add("evidence_start", (k % 4).cast("int"))),
    })
    c = table(s, d, "customer")
    i = F.col("c_custkey")
    entities = c.select(i.alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    coverages = c.filter(i % 7 != 0).select(i.alias("entity_id"), F.when(i % 3 == 0, "thin").otherwise("thick").alias("coverage_stratum"), F.when(i % 11 == 0, "2024-04-01").otherwise("2024-01-01").cast("timestamp").alias("assessed_at"), (i % 13 != 0).alias("evidence_available"))
    n = F.col("source_id")
    declared = sources(s).select("*", F.concat(F.lit("p"), n % 2).alias("provider_id"), F.when(n < 2, "single_currency").otherwise("multi_currency").alias("currency_policy"), F.when(n < 2, "USD").alias("default_currency"), F.lit(None).cast("timestamp").alias("coverage_end"))
    return quality.quality(entities, ["segment"], records, coverages, STRATA, declared, F.lit(AS_OF).cast("timestamp"), F.lit(EXECUTION).cast("timestamp"))[part]


def _list(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_SEGMENT_KEYS = " ".join(f"WHEN '{v}' THEN 'group.{typed.token('segment')}.{typed.token(v)}'" for v in SEGMENTS)
_STRATUM = {v: f"coverage.{typed.token(v)}" for v in STRATA}
_BASE = f"""WITH RECURSIVE {ROOTS},
rec AS (SELECT v.* REPLACE (CASE WHEN entity_id % 17 = 0 THEN observed_at + INTERVAL 60 DAY ELSE observed_at END AS observed_at), source_id < 2 AND entity_id % 29 = 0 AS wrong,
  CASE WHEN signal_family = 'rent' THEN {_list(_RENT)}[record_id % 5 + 1] ELSE {_list(_UTILITY)}[record_id % 5 + 1] END AS event, record_id % 13 = 0 AS unsure, record_id % 3 = 1 AS lasting, root FROM v JOIN roots USING (source_id, record_id)),
w AS (SELECT *, CASE WHEN observed_at > '{AS_OF}'::TIMESTAMP AND revision_of IS NOT NULL THEN 'ad_revision_after_decision' WHEN observed_at > '{AS_OF}'::TIMESTAMP THEN 'ad_observed_after_decision' WHEN status = 'pending' THEN 'ad_pending_record' END AS gate, event = 'reporting_unavailable' AS gap FROM rec),
x AS (SELECT *, CASE WHEN wrong OR coalesce(gate, '') LIKE '%after_decision' THEN 'excluded' WHEN gap OR gate IS NOT NULL THEN 'unavailable' ELSE 'eligible' END AS fate FROM w),
auth AS (SELECT * FROM x WHERE fate = 'eligible' AND NOT EXISTS (SELECT 1 FROM x o WHERE o.fate = 'eligible' AND o.source_id = x.source_id AND o.revision_of = x.record_id) QUALIFY row_number() OVER (PARTITION BY source_id, root ORDER BY observed_at DESC) = 1),
per AS (SELECT record_id, a, a + to_days((record_id % 4)::INT + 1) - INTERVAL 1 MICROSECOND AS z, source_id, entity_id, observed_at FROM auth WHERE lasting),
pn AS (SELECT record_id, a, z, lag(z) OVER h AS pz, lead(a) OVER h AS na FROM per WINDOW h AS (PARTITION BY source_id, entity_id ORDER BY a, observed_at, record_id)),
why AS (SELECT record_id, 'ad_currency_inconsistent' AS code FROM x WHERE wrong UNION ALL SELECT record_id, gate FROM x WHERE gate IS NOT NULL UNION ALL SELECT record_id, 'ad_provider_reporting_gap' FROM x WHERE gap
  UNION ALL SELECT record_id, 'ad_uncertain_transfer' FROM x WHERE unsure UNION ALL SELECT record_id, 'ad_rent_' || event || '_observed' FROM x WHERE signal_family = 'rent' AND event IN ('partial_payment', 'waiver')
  UNION ALL SELECT record_id, CASE event WHEN 'service_interruption' THEN 'ad_' ELSE 'ad_utility_' END || event || '_observed' FROM x WHERE signal_family = 'utility' AND event IN ('estimated_bill', 'adjustment', 'service_interruption')
  UNION ALL SELECT record_id, 'ad_period_overlap' FROM pn WHERE a <= pz OR na <= z UNION ALL SELECT record_id, 'ad_temporal_gap' FROM pn WHERE a > pz + INTERVAL 1 SECOND),
p AS (SELECT c_custkey AS e, c_mktsegment AS seg, c_custkey % 7 = 0 OR c_custkey % 13 = 0 AS bare, c_custkey % 7 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 11 = 0 AS late, CASE WHEN c_custkey % 3 = 0 THEN '{_STRATUM["thin"]}' ELSE '{_STRATUM["thick"]}' END AS stratum FROM customer),
fam AS (SELECT e, f, NOT EXISTS (SELECT 1 FROM v WHERE v.entity_id = p.e AND v.signal_family = f) AS lacking FROM p, (VALUES ('rent'), ('utility')) t(f)),
lack AS (SELECT e, bool_or(lacking) AS lacking FROM fam GROUP BY e),
mem AS (SELECT e, 'overall' AS k, NULL::VARCHAR AS f FROM p UNION ALL SELECT e, CASE WHEN bare OR late THEN 'coverage.unavailable' ELSE stratum END, NULL::VARCHAR FROM p UNION ALL SELECT e, CASE seg {_SEGMENT_KEYS} END, NULL::VARCHAR FROM p UNION ALL SELECT e, 'family.' || f, f FROM fam),
y AS (SELECT mem.k, x.* FROM x JOIN mem ON mem.e = x.entity_id AND (mem.f IS NULL OR mem.f = x.signal_family)),
keys AS (SELECT DISTINCT k, f FROM mem)"""
_SCOPES = _BASE + f""", n AS (SELECT k, count(*) AS n, count(*) FILTER (fate = 'eligible') AS ok, count(*) FILTER (fate = 'excluded') AS ex, count(*) FILTER (fate = 'unavailable') AS un, count(revision_of) AS rv, count(reversal_of) AS rs FROM y GROUP BY k),
m AS (SELECT k, count(*) AS n, min(y.a) AS a, max(y.b) AS b, max(y.observed_at) AS seen FROM y JOIN auth USING (record_id) GROUP BY k),
g AS (SELECT mem.k, count(*) AS n, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND (bare OR CASE WHEN mem.f IS NULL THEN lack.lacking ELSE fam.lacking END)) AS gone FROM mem JOIN p ON p.e = mem.e JOIN lack ON lack.e = mem.e LEFT JOIN fam ON fam.e = mem.e AND fam.f = mem.f GROUP BY mem.k)
SELECT keys.k AS scope_key, coalesce(g.n, 0)::BIGINT AS entity_count, coalesce(n.n, 0)::BIGINT AS input_record_count, coalesce(m.n, 0)::BIGINT AS authoritative_record_count, coalesce(ok, 0)::BIGINT AS eligible_record_count, coalesce(ex, 0)::BIGINT AS excluded_record_count,
  coalesce(un, 0)::BIGINT AS unavailable_record_count, coalesce(late, 0)::BIGINT AS excluded_entity_count, coalesce(gone, 0)::BIGINT AS unavailable_entity_count, coalesce(rv, 0)::BIGINT AS revision_count, coalesce(rs, 0)::BIGINT AS reversal_count,
  m.a AS observation_start, m.b AS observation_end, round(epoch('{AS_OF}'::TIMESTAMP) - epoch(seen), 3) AS refresh_lag_seconds FROM keys LEFT JOIN g ON g.k = keys.k LEFT JOIN n ON n.k = keys.k LEFT JOIN m ON m.k = keys.k"""
_PROVIDERS = _BASE + """, z AS (SELECT k, source_id, count(*) AS r, count(DISTINCT entity_id) AS e FROM y JOIN auth USING (record_id, source_id, entity_id) GROUP BY 1, 2), t AS (SELECT k, count(*) AS n FROM mem GROUP BY k)
SELECT keys.k AS scope_key, i::BIGINT AS source_id, 'p' || (i % 2)::VARCHAR AS provider_id, CASE WHEN i % 2 = 0 THEN 'rent' ELSE 'utility' END AS signal_family, coalesce(e, 0)::BIGINT AS entity_count, coalesce(r, 0)::BIGINT AS record_count, round(coalesce(e / t.n, 0.0), 9) AS entity_coverage_rate
FROM keys JOIN range(4) s(i) ON f IS NULL OR f = CASE WHEN i % 2 = 0 THEN 'rent' ELSE 'utility' END LEFT JOIN z ON z.k = keys.k AND z.source_id = i JOIN t ON t.k = keys.k"""
_REASONS = _BASE + """, d AS (SELECT k, source_id, count(*) AS n FROM y GROUP BY 1, 2), t AS (SELECT k, count(*) AS n FROM mem GROUP BY k),
s AS (SELECT e, 'ad_observed_after_decision' AS code, NULL::VARCHAR AS f FROM p WHERE late UNION ALL SELECT e, 'ad_coverage_stratum_unavailable', NULL::VARCHAR FROM p WHERE bare UNION ALL SELECT e, 'ad_signal_not_provided', f FROM fam WHERE lacking)
SELECT y.k AS scope_key, code, count(*) AS count, 'record' AS unit, max(d.n) AS denominator, y.source_id, signal_family FROM y JOIN why USING (record_id) JOIN d ON d.k = y.k AND d.source_id = y.source_id GROUP BY y.k, code, y.source_id, signal_family
UNION ALL SELECT mem.k, code, count(*), 'entity', max(t.n), NULL::BIGINT, s.f FROM mem JOIN s ON s.e = mem.e AND (mem.f IS NULL OR s.f IS NULL OR s.f = mem.f) JOIN t ON t.k = mem.k GROUP BY mem.k, code, s.f"""

QUERIES = {
    "quality_scopes": (
        lambda s, d: _quality(s, d, "scopes").select("scope_key", "entity_count", "input_record_count", "authoritative_record_count", "eligible_record_count", "excluded_record_count", "unavailable_record_count", "excluded_entity_count", "unavailable_entity_count", "revision_count", "reversal_count", "observation_start", "observation_end", F.round("refresh_lag_seconds", 3).alias("refresh_lag_seconds")),
        _SCOPES,
    ),
    "quality_providers": (lambda s, d: _quality(s, d, "providers").select("scope_key", "source_id", "provider_id", "signal_family", "entity_count", "record_count", F.round("entity_coverage_rate", 9).alias("entity_coverage_rate")), _PROVIDERS),
    "quality_reasons": (lambda s, d: _quality(s, d, "reasons").select("scope_key", "code", "count", "unit", "denominator", "source_id", "signal_family"), _REASONS),
}
