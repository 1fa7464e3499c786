"""Queries over signal profiles: name -> (DataFrame, SQL). Events serve as ledgers, 100 records an entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.operators import signals
from paritas.plans.base import table

_TYPES = {
    "cash": "inflow outflow fee balance transfer inflow outflow reversal inflow balance".split(),
    "rent": "obligation payment partial_payment payment waiver reversal payment payment payment payment".split(),
    "utility": "bill payment adjustment payment service_interruption reversal payment partial_payment payment payment".split(),
}
_START, _END, _GRACE = "2024-01-01", "2024-04-30", 5


def _ledger(s, d, family):
    k, ten = F.col("event_id"), F.floor(F.col("event_id") / 10)
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES[family]]), (k % 10 + 1).cast("int"))
    if family != "cash":
        kind = F.when(k % 1000 == 9, "reporting_unavailable").otherwise(kind)
    if family == "utility":
        kind = F.when((k % 40 == 0), "estimated_bill").otherwise(kind)
    start = F.lit(f"{_START} 00:00:00").cast("timestamp")
    time = start + F.make_dt_interval((k * 7 % 120).cast("int"))
    amount = F.floor("value").cast("decimal(18,2)")
    amount = F.when(kind.isin("obligation", "bill", "estimated_bill"), amount * 3).when(kind == "adjustment", -(k % 5)).when(kind == "balance", amount - 50).otherwise(amount)
    return table(s, d, "events").select(
        k.alias("record_id"), (ten % 3).alias("source_id"), F.floor(k / 100).alias("entity_id"), kind.alias("event_type"), F.when(k % 997 == 0, "unavailable").when(k % 23 == 0, "pending").otherwise("posted").alias("status"),
        time.alias("event_time"), time.alias("observed_at"), amount.cast("decimal(18,2)").alias("amount"), F.when(kind == "reversal", k - 2).alias("reversal_of"), F.when(k % 40 != 0, k % 7).alias("category_id"),
        F.when(k % 30 == 4, "internal").when(k % 30 == 14, "uncertain").otherwise("external").alias("transfer_scope"), F.when(k % 77 != 6, ten).alias("obligation_id"),
        F.to_date(start + F.make_dt_interval((ten * 13 % 120).cast("int"))).alias("due_date"), F.lit("USD").alias("currency"), time.alias("period_start"), (time + F.expr("INTERVAL 3 DAY")).alias("period_end"),
        F.when(ten % 7 != 0, ten % 4).alias("provider_id"), F.when(ten % 2 == 0, "power").otherwise("water").alias("service_type"),
    )


def _ledger_sql(family):
    kind = f"{_TYPES[family]}[event_id % 10 + 1]"
    if family != "cash":
        kind = f"CASE WHEN event_id % 1000 = 9 THEN 'reporting_unavailable' ELSE {kind} END"
    if family == "utility":
        kind = f"CASE WHEN event_id % 40 = 0 THEN 'estimated_bill' ELSE {kind} END"
    return f"""WITH e AS (SELECT * EXCLUDE (event_type), event_id // 10 AS ten, {kind} AS event_type, DATE '{_START}' + (event_id * 7 % 120)::INT AS day, floor(value) AS v FROM events),
l AS (SELECT event_id AS record_id, ten % 3 AS source_id, event_id // 100 AS entity_id, event_type, CASE WHEN event_id % 997 = 0 THEN 'unavailable' WHEN event_id % 23 = 0 THEN 'pending' ELSE 'posted' END AS status, day,
  CASE WHEN event_type IN ('obligation', 'bill', 'estimated_bill') THEN v * 3 WHEN event_type = 'adjustment' THEN -(event_id % 5) WHEN event_type = 'balance' THEN v - 50 ELSE v END AS amount,
  CASE WHEN event_type = 'reversal' THEN event_id - 2 END AS reversal_of, event_id % 40 = 0 AS bare, event_id % 30 AS k30, CASE WHEN event_id % 77 <> 6 THEN ten END AS obligation_id,
  DATE '{_START}' + (ten * 13 % 120)::INT AS due_date, CASE WHEN ten % 7 <> 0 THEN ten % 4 END AS provider_id, ten % 2 AS service FROM e),
r AS (SELECT *, status NOT IN ('pending', 'unavailable') AS stands, stands AND (entity_id, record_id) NOT IN (SELECT (entity_id, reversal_of) FROM l WHERE reversal_of IS NOT NULL) AS ok FROM l)"""


def _codes(*rules):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules) + ")"


_CASH_SQL = f"""{_ledger_sql("cash")}, a AS (SELECT *, date_trunc('month', day) AS month FROM r WHERE ok AND event_type <> 'reversal'),
months AS (SELECT entity_id, unnest(range(DATE '{_START}', DATE '{_END}', INTERVAL 1 MONTH)) AS month FROM (SELECT DISTINCT entity_id FROM l)),
flow AS (SELECT m.entity_id, m.month, coalesce(sum(amount) FILTER (event_type = 'inflow'), 0) AS v FROM months m LEFT JOIN a ON a.entity_id = m.entity_id AND a.month = m.month GROUP BY 1, 2),
f AS (SELECT entity_id, avg(v) AS mean, stddev_pop(v) AS dev FROM flow GROUP BY 1),
holes AS (SELECT DISTINCT entity_id, date_trunc('month', day) AS month FROM l WHERE status = 'unavailable'),
seen AS (SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT entity_id, month FROM a EXCEPT SELECT * FROM holes) GROUP BY 1),
t AS (SELECT entity_id, coalesce(sum(amount) FILTER (event_type = 'inflow'), 0) AS i, coalesce(sum(amount) FILTER (event_type = 'outflow'), 0) AS o, coalesce(sum(amount) FILTER (event_type = 'fee'), 0) AS f,
  count(*) FILTER (event_type = 'balance') AS bal, count(*) FILTER (event_type = 'balance' AND amount < 0) AS neg, count(*) FILTER (event_type = 'transfer' AND k30 = 4) AS internal, count(*) FILTER (event_type = 'transfer' AND k30 = 14) AS uncertain,
  count(*) FILTER (event_type = 'fee') AS fees, count(*) FILTER (event_type IN ('inflow', 'outflow') AND bare) AS unresolved FROM a GROUP BY 1),
u AS (SELECT x.entity_id, sum(y.amount) AS undone FROM l x JOIN l y ON y.entity_id = x.entity_id AND y.record_id = x.reversal_of GROUP BY 1),
w AS (SELECT entity_id, count(*) FILTER (event_type = 'reversal') AS reversals FROM l GROUP BY 1),
z AS (SELECT w.entity_id, w.reversals, t.* EXCLUDE entity_id, coalesce(s.n, 0) AS seen, coalesce(h.hole, false) AS hole, f.mean, f.dev, coalesce(s.n, 0) >= 3 AND h.hole IS NULL AS complete, u.undone
  FROM w LEFT JOIN t USING (entity_id) LEFT JOIN seen s USING (entity_id) LEFT JOIN f USING (entity_id) LEFT JOIN u USING (entity_id) LEFT JOIN (SELECT DISTINCT entity_id, true AS hole FROM holes) h USING (entity_id))
SELECT entity_id, CASE WHEN complete THEN 'available' ELSE 'unavailable' END AS state, 4::BIGINT AS calendar_period_count, seen AS observed_period_count, 4 - seen AS missing_period_count, i::DOUBLE AS inflow_total, o::DOUBLE AS outflow_total,
  f::DOUBLE AS fee_total, (i - o - f)::DOUBLE AS net_cash_flow, round(CASE WHEN complete THEN mean END, 6) AS mean_monthly_inflow, round(CASE WHEN complete THEN dev END, 6) AS monthly_inflow_population_stddev,
  round(CASE WHEN complete AND mean <> 0 THEN dev / mean END, 6) AS monthly_inflow_coefficient_of_variation, bal AS balance_observation_count, round(bal / 4, 6) AS balance_availability_rate, neg AS negative_balance_count,
  round(CASE WHEN bal > 0 THEN neg / bal END, 6) AS negative_balance_rate, internal AS internal_transfer_count, uncertain AS uncertain_transfer_count, fees AS fee_event_count, reversals AS reversal_count, coalesce(undone, 0)::DOUBLE AS reversed_amount,
  {_codes(("ad_balance_history_unavailable", "bal = 0"), ("ad_cashflow_category_unresolved", "unresolved > 0"), ("ad_cashflow_reversal_observed", "reversals > 0"), ("ad_insufficient_calendar_coverage", "NOT complete"), ("ad_provider_reporting_gap", "hole"), ("ad_uncertain_transfer", "uncertain > 0"))} AS reason_codes FROM z"""


def _due_sql(family, kinds, grace, more, codes, joins=""):
    return f"""{_ledger_sql(family)}, d AS (SELECT * FROM r WHERE event_type IN {kinds} AND stands),
p AS (SELECT r.*, d.record_id IS NOT NULL AS known FROM r LEFT JOIN d ON d.entity_id = r.entity_id AND d.source_id = r.source_id AND d.obligation_id IS NOT DISTINCT FROM r.obligation_id WHERE r.event_type IN ('payment', 'partial_payment')),
alter AS (SELECT entity_id, source_id, obligation_id, sum(amount) AS v FROM r WHERE ok AND event_type IN ('adjustment', 'waiver') GROUP BY ALL),
k AS (SELECT d.entity_id, d.record_id, d.due_date, d.amount, d.amount + coalesce(alter.v, 0) AS owing, d.obligation_id, d.source_id FROM d LEFT JOIN alter ON alter.entity_id = d.entity_id AND alter.source_id = d.source_id AND alter.obligation_id IS NOT DISTINCT FROM d.obligation_id),
step AS (SELECT k.entity_id, k.record_id, k.due_date, k.owing, p.amount, p.event_type, p.day, sum(p.amount) OVER (PARTITION BY k.record_id ORDER BY p.day, p.record_id) AS cum
  FROM k JOIN p ON p.entity_id = k.entity_id AND p.source_id = k.source_id AND p.obligation_id IS NOT DISTINCT FROM k.obligation_id AND p.ok),
o AS (SELECT entity_id, record_id, due_date, any_value(owing) AS owing, sum(amount) AS paid, min(day) FILTER (cum >= owing) AS done, bool_or(event_type = 'partial_payment') AS part FROM step GROUP BY 1, 2, 3),
gap AS (SELECT entity_id, day FROM l WHERE event_type = 'reporting_unavailable'),
s AS (SELECT entity_id, count(*) AS n, count(done) AS paid, count(*) FILTER (done <= due_date + {grace}) AS timely, count(*) FILTER (part) AS part, sum(owing) AS owing, sum(o.paid) AS sum_paid FROM o
  WHERE NOT EXISTS (FROM gap WHERE gap.entity_id = o.entity_id AND o.due_date BETWEEN gap.day AND gap.day + 3) GROUP BY 1),
sched AS (SELECT entity_id, count(*) AS m, sum(amount) AS amount FROM d GROUP BY 1), stray AS (SELECT DISTINCT entity_id FROM p WHERE NOT known),
w AS (SELECT entity_id, count(*) FILTER (event_type = 'reversal') AS reversals, count(*) FILTER (event_type = 'reporting_unavailable') AS gaps, bool_or(event_type = 'partial_payment') AS parts, bool_or(event_type = 'waiver') AS waivers,
  count(*) FILTER (event_type = 'adjustment') AS adj, count(*) FILTER (event_type = 'service_interruption') AS cuts, bool_or(event_type = 'estimated_bill') AS guess FROM l GROUP BY 1){joins},
z AS (SELECT w.*, coalesce(m, 0) AS m, coalesce(sched.amount, 0) AS amount, coalesce(n, 0) AS n, coalesce(paid, 0) AS paid, coalesce(timely, 0) AS timely, coalesce(part, 0) AS part, coalesce(owing, 0) AS owing, coalesce(sum_paid, 0) AS sum_paid,
  w.entity_id IN (SELECT entity_id FROM stray) AS stray FROM w LEFT JOIN sched USING (entity_id) LEFT JOIN s USING (entity_id))
SELECT z.entity_id, CASE WHEN n > 0 THEN 'available' ELSE 'unavailable' END AS state, m AS scheduled_obligation_count, z.amount::DOUBLE AS scheduled_amount, n AS observable_obligation_count, round(CASE WHEN m > 0 THEN n / m END, 6) AS provider_coverage_rate,
  paid AS fully_paid_count, round(CASE WHEN n > 0 THEN paid / n END, 6) AS fully_paid_rate, timely AS timely_paid_count, round(CASE WHEN n > 0 THEN timely / n END, 6) AS timely_paid_rate, part AS partial_payment_count,
  round(CASE WHEN n > 0 THEN part / n END, 6) AS partial_payment_rate, owing::DOUBLE AS observable_obligation_amount, sum_paid::DOUBLE AS linked_payment_amount, round(CASE WHEN owing <> 0 THEN sum_paid / owing END, 6) AS amount_coverage_rate,
  reversals AS reversal_count, gaps AS reporting_gap_count, {more}, {codes} AS reason_codes"""


_DUE = [("ad_obligation_schedule_unavailable", "m = 0"), ("ad_provider_nonparticipation", "gaps > 0"), ("ad_provider_reporting_gap", "gaps > 0")]
_RENT_SQL = _due_sql("rent", "('obligation')", _GRACE, f"{_GRACE}::INT AS grace_days", _codes(*_DUE, ("ad_rent_partial_payment_observed", "parts"), ("ad_rent_waiver_observed", "waivers"), ("ad_unmatched_obligation", "stray"))) + " FROM z"
_UTILITY_SQL = (
    _due_sql(
        "utility", "('bill', 'estimated_bill')", 0,
        """coalesce(b.v, 0)::DOUBLE AS original_billed_amount, coalesce(adjusted.v, 0)::DOUBLE AS adjustment_total, (coalesce(b.v, 0) + coalesce(adjusted.v, 0))::DOUBLE AS net_adjusted_obligation, coalesce(b.guesses, 0) AS estimated_bill_count,
  round(CASE WHEN m > 0 THEN b.guesses / m END, 6) AS estimated_bill_rate, adj AS adjustment_count, round(CASE WHEN m > 0 THEN adj / m END, 6) AS adjustment_rate, cuts AS service_interruption_count, coalesce(b.providers, 0) AS provider_count, coalesce(b.services, 0) AS service_type_count""",
        _codes(*_DUE, ("ad_service_interruption_observed", "cuts > 0"), ("ad_unmatched_obligation", "stray"), ("ad_utility_adjustment_observed", "adj > 0"), ("ad_utility_estimated_bill_observed", "guess")),
        """, b AS (SELECT entity_id, sum(amount) AS v, count(*) FILTER (event_type = 'estimated_bill') AS guesses, count(DISTINCT coalesce(provider_id, -1)) AS providers, count(DISTINCT service) AS services FROM d GROUP BY 1),
adjusted AS (SELECT entity_id, sum(amount) AS v FROM l WHERE event_type = 'adjustment' GROUP BY 1)""",
    )
    + " FROM z LEFT JOIN b USING (entity_id) LEFT JOIN adjusted USING (entity_id)"
)


def _plain(df):
    """Amounts as doubles, quotients rounded, codes joined: what both sides can hash alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(c, ",").alias(c) if kinds[c].startswith("array") else F.round(F.col(c).cast("double"), 6).alias(c) if kinds[c].startswith(("decimal", "double")) else F.col(c) for c in df.columns])


QUERIES = {
    "cashflow_profile": (lambda s, d: _plain(signals.cash_flow_profile(_ledger(s, d, "cash"), _START, _END)), _CASH_SQL),
    "rent_profile": (lambda s, d: _plain(signals.rent_profile(_ledger(s, d, "rent"), _GRACE)), _RENT_SQL),
    "utility_profile": (lambda s, d: _plain(signals.utility_profile(_ledger(s, d, "utility"))), _UTILITY_SQL),
}
