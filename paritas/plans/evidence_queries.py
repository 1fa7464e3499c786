"""Queries over risk, alternative-data, disclosure, proxy, bootstrap and research operators: name -> (DataFrame, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.functions import ranked
from paritas.operators import altdata, bootstrap, disclosure, proxy, research, risk, screening
from paritas.plans.base import AS_OF, AUDIT, EXECUTION, SEGMENTS, SIGNALS, audit, signals, table

EDGES, FRACTIONS = [0.25, 0.5, 0.75], [0.05, 0.1, 0.2, 0.5]


def _risk(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("entity_id"), (((F.col("o_orderkey") * 37) % 101) / F.lit(100.0)).alias("s"), (F.col("o_orderstatus") == "P").alias("bad"), (1 + F.col("o_orderkey") % 5).cast("double").alias("w"))


RISK = "risk AS (SELECT o_orderkey AS entity_id, ((o_orderkey * 37) % 101) / 100.0::DOUBLE AS s, o_orderstatus = 'P' AS bad, (1 + o_orderkey % 5)::DOUBLE AS w FROM orders)"
RUNS = RISK + ", runs AS (SELECT s, count(*) AS n, sum(w) AS w, sum(CASE WHEN bad THEN w ELSE 0 END) AS b, sum(CASE WHEN bad THEN 0 ELSE w END) AS g FROM risk GROUP BY s)"


def _ts(x):
    return F.lit(x).cast("timestamp")


def _gate(s, d):
    r = signals(s, d)
    g = altdata.feature_gate(F.col("event_time"), F.col("event_time"), F.col("observed_at"), F.col("revision_of").isNotNull(), F.col("status"), _ts(AS_OF), _ts(EXECUTION))
    return r.withColumn("g", g).select("record_id", "source_id", "entity_id", "g.disposition", "g.code")


_GATE_SQL = f"""{SIGNALS}, gate AS (SELECT *, CASE WHEN event_time > '{EXECUTION}'::TIMESTAMP OR observed_at > '{EXECUTION}'::TIMESTAMP THEN 'error|ad_future_timestamp'
  WHEN event_time > '{AS_OF}'::TIMESTAMP THEN 'error|ad_feature_after_decision' WHEN observed_at > '{AS_OF}'::TIMESTAMP AND revision_of IS NOT NULL THEN 'exclude|ad_revision_after_decision'
  WHEN observed_at > '{AS_OF}'::TIMESTAMP THEN 'exclude|ad_observed_after_decision' WHEN status = 'pending' THEN 'unavailable|ad_pending_record' ELSE 'eligible|' END AS dc FROM signals)"""


def _periods(s, d):
    return signals(s, d).select("record_id", "source_id", "entity_id", F.col("event_time").alias("period_start"), (F.col("event_time") + F.expr("make_interval(0, 0, 0, CAST(record_id % 6 AS INT))")).alias("period_end"))


_FAMILIES = {"inflow": "cash_flow", "outflow": "rent", "fee": "utility"}


def _family(s, d):
    c = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _FAMILIES.items()])
    return signals(s, d).select("entity_id", c.alias("family"))


_FAMILY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FAMILIES.items()) + " END"


def _due(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") / 2).cast("decimal(18,2)").alias("amount_due"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("due_date"))


def _payments(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("payment_id"), F.col("l_shipdate").alias("paid_on"), F.round("l_extendedprice").cast("decimal(18,2)").alias("paid"))


def _gaps(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("TIMESTAMP'1994-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 300 AS INT))").alias("gap_start"), F.expr("TIMESTAMP'1996-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 300 AS INT))").alias("gap_end"))


def _members(s, d):
    a = audit(s, d)
    cohort = F.when(F.col("entity_id") < 40, "launch").otherwise("later")  # a few entities in tables of any size
    cells = F.array(
        F.struct(F.lit("population").alias("t"), F.lit("all").alias("c")), F.struct(F.lit("group.grp").alias("t"), F.col("grp").alias("c")), F.struct(F.lit("group.prio").alias("t"), F.col("prio").alias("c")),
        F.struct(F.lit("outcome").alias("t"), F.col("y").cast("string").alias("c")), F.struct(F.lit("intersection").alias("t"), F.concat_ws("/", "grp", "prio").alias("c")),
        F.struct(F.lit("cohort").alias("t"), cohort.alias("c")), F.struct(F.lit("cohort.prio").alias("t"), F.concat_ws("/", cohort, "prio").alias("c")),
    )
    return a.select("entity_id", F.explode(cells).alias("x")).select(F.col("x.t").alias("table_id"), F.col("x.c").alias("cell_id"), "entity_id")


MEMBERS = AUDIT + """, members AS (SELECT 'population' AS table_id, 'all' AS cell_id, entity_id FROM base UNION ALL SELECT 'group.grp', grp, entity_id FROM base UNION ALL SELECT 'group.prio', prio, entity_id FROM base
 UNION ALL SELECT 'outcome', y::VARCHAR, entity_id FROM base UNION ALL SELECT 'intersection', grp || '/' || prio, entity_id FROM base
 UNION ALL SELECT 'cohort', CASE WHEN entity_id < 40 THEN 'launch' ELSE 'later' END, entity_id FROM base UNION ALL SELECT 'cohort.prio', CASE WHEN entity_id < 40 THEN 'launch' ELSE 'later' END || '/' || prio, entity_id FROM base)"""
_MINIMUM = 60
_DOMAIN, _PROTOCOL, _FOLD_SEED = "proxy-fold-v1", "v1", 7


def _complementary(s, d):
    return disclosure.release(_members(s, d), _MINIMUM, totals=frozenset({"population:all"}))


def _one_table(s, d):
    """Segments with a small cohort beside them, and their total."""
    a = audit(s, d)
    own = F.when(F.col("entity_id") < 40, "launch").otherwise(F.col("grp"))
    tables = F.array(F.struct(F.lit("population").alias("t"), F.lit("all").alias("c")), F.struct(F.lit("cohort").alias("t"), own.alias("c")))
    m = a.select("entity_id", F.explode(tables).alias("x")).select(F.col("x.t").alias("table_id"), F.col("x.c").alias("cell_id"), "entity_id")
    return disclosure.release(m, _MINIMUM, totals=frozenset({"population:all"}))


def _screened(s, d):
    """Orders of some days hold out; the segment is screened with a score, beside two other features."""
    a = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    rows = a.select(
        k.cast("string").alias("entity_id"), F.when(k % 5 == 0, "holdout").otherwise("development").alias("window"), F.col("c_mktsegment").alias("label"), F.when(k % 17 != 0, F.col("c_acctbal") / 1000 + F.length("c_mktsegment")).alias("candidate"),
        (k % 7).cast("double").alias("b0"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("b1"),
    )
    folded = rows.withColumn("fold", F.when(F.col("window") == "development", proxy.fold_of(F.col("entity_id"), 3, _FOLD_SEED, _PROTOCOL, _DOMAIN)).cast("int"))
    return screening.screen(folded, "label", ["candidate"], ["b0", "b1"], {"b1"}, 3)


def _rows(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 0).alias("d"))


_R, _SEED, _KEY = 40, 7, "overall.selection_rate"


def _draws(s, d):
    # positions of all suppliers
    return bootstrap.draws(s, table(s, d, "supplier").count(), _R, _SEED, _KEY)


_DRAWS_SQL = f"""WITH m AS (SELECT encode('{bootstrap.DOMAIN[:-1]}') || '\\x00'::BLOB || encode('{_SEED}') || '\\x00'::BLOB || encode('{_KEY}') || '\\x00'::BLOB || encode('scope') AS m), n AS (SELECT count(*) AS n FROM supplier),
b AS (SELECT id, n, sha256(m || unhex(printf('%016x', id))) AS h FROM (SELECT m, n, unnest(range(0, n * {_R} // 4 + 4)) AS id FROM m, n)),
w AS (SELECT n, id * 4 + k AS spot, ('0x' || substr(h, (16 * k + 1)::INT, 16))::UBIGINT AS c FROM b, range(4) u(k))
SELECT (spot // n)::BIGINT AS draw, (spot % n)::BIGINT AS i, (c % n)::BIGINT AS "index" FROM w WHERE spot < n * {_R}"""


def _interval(s, d):
    rows = _rows(s, d)
    # draws are over positions of the whole table; one position for an empty table, which none of its rows meets
    draws = bootstrap.draws(s, max(1, rows.count()), _R, _SEED, _KEY)
    sample = bootstrap.selection_rate_draws(bootstrap.with_ordinal(rows, "k"), draws)
    return bootstrap.interval(sample.withColumn("key", F.lit(_KEY)), ["key"], 0.9, 30)


def _multinomial(s, d):
    c = audit(s, d).agg(*[F.sum(F.expr(f"CAST({x} AS BIGINT)")) for x in ("y AND d", "NOT y AND d", "y AND NOT d", "NOT y AND NOT d")]).first()
    v = bootstrap.multinomial(s, list(c), 500, 11).select(F.lit("selection_rate").alias("key"), ((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("v"))
    return bootstrap.interval(v, ["key"], 0.95, 400)


def _slope(s, d):
    r = risk.calibration_slope(_risk(s, d))
    return s.createDataFrame([(r["slope"], r["intercept"], r["reason"], r["iterations"])], "slope double, intercept double, reason string, iterations int")


def _p_values(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("test"), ((F.col("n_nationkey") + 1) / F.lit(400.0)).alias("p"))


QUERIES = {
    "risk_bands": (
        lambda s, d: risk.bands(_risk(s, d), EDGES).select("band", "n", F.round("bad_rate", 8).alias("bad_rate"), F.round("mean_score", 8).alias("mean_score")),
        f"WITH {RISK}, b AS (SELECT (s >= 0.25)::INT + (s >= 0.5)::INT + (s >= 0.75)::INT AS band, * FROM risk) SELECT i::INT AS band, count(w) AS n, round(sum(CASE WHEN bad THEN w ELSE 0 END) / sum(w), 8) AS bad_rate, round(sum(w * s) / sum(w), 8) AS mean_score FROM range(4) t(i) LEFT JOIN b ON band = i GROUP BY i",
    ),
    "risk_weights": (
        lambda s, d: risk.normalized_weights(_risk(s, d)).select("entity_id", F.round("w", 8).alias("w")),
        f"WITH {RISK} SELECT entity_id, round(w / max(w) OVER (), 8) AS w FROM risk",
    ),
    "risk_ks": (
        lambda s, d: ranked.ks(_risk(s, d), "s", "bad", "w").select(F.round("ks", 8).alias("ks"), "ks_score"),
        f"WITH {RUNS}, x AS (SELECT s, abs(sum(b) OVER (ORDER BY s DESC) / sum(b) OVER () - sum(g) OVER (ORDER BY s DESC) / sum(g) OVER ()) AS dist FROM runs) SELECT round(max(dist), 8) AS ks, min(s) FILTER (abs(dist - (SELECT max(dist) FROM x)) <= 1e-15) AS ks_score FROM x",
    ),
    "risk_auc_gini": (
        lambda s, d: risk.auc_gini(_risk(s, d)).select(F.round("auc", 8).alias("auc"), F.round("gini", 8).alias("gini")),
        f"WITH {RUNS}, x AS (SELECT b, g, coalesce(sum(g) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM runs), a AS (SELECT sum(b * (below + 0.5 * g)) / (sum(b) * sum(g)) AS auc FROM x) SELECT round(auc, 8) AS auc, round(2 * auc - 1, 8) AS gini FROM a",
    ),
    "risk_lift_capture": (
        lambda s, d: ranked.lift(_risk(s, d), "s", "bad", "w", FRACTIONS).select("fraction", "selected", *[F.round(c, 8).alias(c) for c in ("bad_rate", "capture", "lift")]),
        f"""WITH {RUNS}, x AS (SELECT *, sum(w) OVER (ORDER BY s DESC) AS cum, sum(w) OVER () AS tw, sum(b) OVER () AS tb FROM runs),
        y AS (SELECT f::DOUBLE AS fraction, sum(n)::BIGINT AS selected, sum(w) AS w, sum(b) AS b, max(tw) AS tw, max(tb) AS tb FROM x, (VALUES (0.05), (0.1), (0.2), (0.5)) t(f) WHERE cum - w < f::DOUBLE * tw GROUP BY f)
        SELECT fraction, selected, round(b / w, 8) AS bad_rate, round(b / tb, 8) AS capture, round((b / w) / (tb / tw), 8) AS lift FROM y""",
    ),
    "risk_calibration_large": (lambda s, d: risk.calibration(_risk(s, d)).select(F.round("calibration_in_the_large", 8).alias("calibration_in_the_large")), f"WITH {RISK} SELECT round(sum(w * s) / sum(w) - sum(w * bad::INT) / sum(w), 8) AS calibration_in_the_large FROM risk"),
    "risk_brier": (lambda s, d: risk.calibration(_risk(s, d)).select(F.round("brier_score", 8).alias("brier_score")), f"WITH {RISK} SELECT round(sum(w * (s - bad::INT) * (s - bad::INT)) / sum(w), 8) AS brier_score FROM risk"),
    "risk_eligibility": (
        lambda s, d: risk.eligibility(_risk(s, d).withColumns({"label_mature": F.col("entity_id") % 9 != 0, "censored": F.col("entity_id") % 4 == 0})).groupBy("status").agg(F.count("*").alias("n")),
        f"WITH {RISK} SELECT CASE WHEN entity_id % 9 = 0 THEN 'immature' WHEN entity_id % 4 = 0 THEN 'censored' ELSE 'eligible' END AS status, count(*) AS n FROM risk GROUP BY 1",
    ),
    "calibration_slope": (_slope, None),
    "leakage_gate": (_gate, f"WITH {_GATE_SQL} SELECT record_id, source_id, entity_id, split_part(dc, '|', 1) AS disposition, nullif(split_part(dc, '|', 2), '') AS code FROM gate"),
    "coverage_gate": (
        lambda s, d: signals(s, d).groupBy("entity_id").agg(F.max("observed_at").alias("t")).select("entity_id", altdata.coverage_gate(F.col("t"), _ts(AS_OF), _ts(EXECUTION)).alias("disposition")),
        f"WITH {SIGNALS} SELECT entity_id, CASE WHEN max(observed_at) > '{EXECUTION}'::TIMESTAMP THEN 'error' WHEN max(observed_at) > '{AS_OF}'::TIMESTAMP THEN 'exclude' ELSE 'eligible' END AS disposition FROM signals GROUP BY entity_id",
    ),
    "outcome_gate": (
        lambda s, d: signals(s, d).withColumn("g", altdata.outcome_gate(F.col("event_time"), F.col("event_time"), F.col("observed_at"), F.col("event_time") + F.expr("INTERVAL 3 DAY"), _ts("2024-01-05"), _ts("2024-01-07"), _ts(AS_OF), _ts(EXECUTION))).select("record_id", "g.disposition", "g.code"),
        f"""WITH {SIGNALS}, rule(n, disposition, code) AS (VALUES (1, 'error', 'ad_future_timestamp'), (2, 'unavailable', 'ad_label_immature'), (3, 'error', 'ad_outcome_not_post_decision'), (4, 'exclude', 'ad_outcome_outside_window'), (5, 'eligible', NULL)),
        first AS (SELECT record_id, CASE WHEN greatest(event_time, observed_at) > '{EXECUTION}'::TIMESTAMP THEN 1 WHEN event_time + INTERVAL 3 DAY > '{EXECUTION}'::TIMESTAMP THEN 2 WHEN event_time <= '2024-01-05'::TIMESTAMP THEN 3
          WHEN event_time NOT BETWEEN '2024-01-07'::TIMESTAMP AND '{AS_OF}'::TIMESTAMP THEN 4 ELSE 5 END AS n FROM signals)
        SELECT record_id, disposition, code FROM first JOIN rule USING (n)""",
    ),
    "revision_terminal": (
        lambda s, d: altdata.terminal_records(_gate(s, d).select("record_id", "disposition").join(signals(s, d), "record_id"), F.col("disposition") == "eligible").select("source_id", "record_id"),
        f"WITH {_GATE_SQL} SELECT source_id, record_id FROM gate a WHERE dc = 'eligible|' AND NOT EXISTS (SELECT 1 FROM gate b WHERE b.dc = 'eligible|' AND b.source_id = a.source_id AND b.revision_of = a.record_id)",
    ),
    "period_overlap_gap": (
        lambda s, d: altdata.overlaps_and_gaps(_periods(s, d), ["source_id", "entity_id"]).select("record_id", "overlap", "gap"),
        f"""WITH {SIGNALS}, p AS (SELECT record_id, source_id, entity_id, event_time AS a, event_time + to_days((record_id % 6)::INT) AS b FROM signals),
        x AS (SELECT *, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM p WINDOW w AS (PARTITION BY source_id, entity_id ORDER BY a, record_id)) SELECT record_id, coalesce(a <= pb, false) OR coalesce(na <= b, false) AS overlap, coalesce(a > pb + INTERVAL 1 SECOND, false) AS gap FROM x""",
    ),
    "record_disposition_counts": (
        lambda s, d: _gate(s, d).groupBy("source_id", "disposition", "code").agg(F.count("*").alias("records"), F.countDistinct("entity_id").alias("entities")),
        f"WITH {_GATE_SQL} SELECT source_id, split_part(dc, '|', 1) AS disposition, nullif(split_part(dc, '|', 2), '') AS code, count(*) AS records, count(DISTINCT entity_id) AS entities FROM gate GROUP BY 1, 2, 3",
    ),
    "provider_coverage": (
        lambda s, d: altdata.provider_coverage(signals(s, d)).select("source_id", "entities", "records", F.round("rate", 8).alias("rate")),
        f"WITH {SIGNALS} SELECT source_id, count(DISTINCT entity_id) AS entities, count(*) AS records, round(count(DISTINCT entity_id) / (SELECT count(DISTINCT entity_id) FROM signals), 8) AS rate FROM signals GROUP BY 1",
    ),
    "signal_not_provided": (
        lambda s, d: altdata.signals_not_provided(signals(s, d).select("entity_id").distinct(), _family(s, d), list(_FAMILIES.values())),
        f"WITH {SIGNALS}, f AS (SELECT DISTINCT entity_id, {_FAMILY_SQL} AS family FROM signals) SELECT e.entity_id, v.family FROM (SELECT DISTINCT entity_id FROM signals) e, (VALUES ('cash_flow'), ('rent'), ('utility')) v(family) EXCEPT SELECT entity_id, family FROM f",
    ),
    "obligation_payments": (
        lambda s, d: altdata.obligations(_due(s, d), _payments(s, d)).select("key", F.col("paid").cast("double").alias("paid"), "completed_on", "state"),
        """WITH x AS (SELECT o_orderkey AS k, round(o_totalprice / 2)::DECIMAL(18,2) AS due, o_orderdate + INTERVAL 60 DAY AS dd, l_shipdate AS p, round(l_extendedprice)::DECIMAL(18,2) AS a, l_linenumber AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
        y AS (SELECT *, sum(a) OVER (PARTITION BY k ORDER BY p, n ROWS UNBOUNDED PRECEDING) AS cum FROM x), z AS (SELECT k, dd, coalesce(sum(a), 0) AS paid, min(p) FILTER (cum >= due) AS c FROM y GROUP BY k, dd)
        SELECT k AS key, paid::DOUBLE AS paid, c AS completed_on, CASE WHEN c <= dd THEN 'timely' WHEN c IS NOT NULL THEN 'late' WHEN paid > 0 THEN 'partial' ELSE 'unpaid' END AS state FROM z""",
    ),
    "range_gap_antijoin": (
        lambda s, d: altdata.outside_gaps(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("due_date")), _gaps(s, d), ["k"]).select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' + to_days((c_custkey % 300)::INT) AND TIMESTAMP '1996-01-01' + to_days((c_custkey % 300)::INT))",
    ),
    "disclosure_cells": (lambda s, d: disclosure.cells(_members(s, d)), f"WITH {MEMBERS} SELECT table_id, cell_id, count(DISTINCT entity_id) AS n FROM members GROUP BY 1, 2"),
    "primary_suppression": (
        lambda s, d: disclosure.primary(disclosure.cells(_members(s, d)), _MINIMUM),
        f"WITH {MEMBERS}, c AS (SELECT table_id, cell_id, count(DISTINCT entity_id) AS k FROM members GROUP BY 1, 2) SELECT table_id, cell_id, CASE WHEN k >= {_MINIMUM} THEN k END AS n, k < {_MINIMUM} AS suppressed, CASE WHEN k < {_MINIMUM} THEN '0..{_MINIMUM - 1}' END AS bucket FROM c",
    ),
    "membership_atoms": (
        lambda s, d: disclosure.atoms(_members(s, d)),
        f"WITH {MEMBERS}, p AS (SELECT entity_id, array_to_string(list_sort(list_distinct(list(table_id || ':' || cell_id))), '|') AS signature FROM members GROUP BY 1) SELECT signature, count(*) AS n FROM p GROUP BY 1",
    ),
    "complementary_suppression": (_complementary, None),
    "suppressed_release": (
        # one table and its total: a hidden cell alone is the total less the others, so the smallest other one goes too
        _one_table,
        f"""WITH {AUDIT}, k AS (SELECT CASE WHEN entity_id < 40 THEN 'launch' ELSE grp END AS cell_id, count(*) AS k FROM base GROUP BY 1), p AS (SELECT *, k < {_MINIMUM} AS small, count(*) FILTER (k < {_MINIMUM}) OVER () AS smalls FROM k),
        h AS (SELECT *, NOT small AND smalls = 1 AND row_number() OVER (PARTITION BY small ORDER BY k, cell_id) = 1 AS also FROM p)
        SELECT 'cohort' AS table_id, cell_id, CASE WHEN small OR also THEN 'suppressed' ELSE 'published' END AS state, CASE WHEN NOT (small OR also) THEN k END AS n, CASE WHEN small THEN '0..{_MINIMUM - 1}' WHEN also THEN 'hidden' END AS bucket,
          CASE WHEN small THEN 'ad_sparse_report_cell' WHEN also THEN 'ad_complementary_suppression' END AS reason FROM h
        UNION ALL SELECT 'population', 'all', 'published', count(*), NULL, NULL FROM base""",
    ),
    "proxy_fold": (
        lambda s, d: audit(s, d).select("entity_id", proxy.fold_of(F.col("entity_id"), 3, _FOLD_SEED, _PROTOCOL, _DOMAIN).alias("fold")),
        f"""WITH {AUDIT}, h AS (SELECT entity_id, sha256(encode('{_DOMAIN}') || unhex('{len(_PROTOCOL):08x}') || encode('{_PROTOCOL}') || unhex('{_FOLD_SEED:016x}') || unhex(printf('%08x', length(entity_id::VARCHAR))) || encode(entity_id::VARCHAR)) AS h FROM base), w AS (SELECT entity_id, list_transform(range(8), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS w FROM h)
        SELECT entity_id, list_reduce(list_prepend(0::BIGINT, w), lambda r, x: (r * 4294967296 + x) % 3) AS fold FROM w""",
    ),
    "proxy_eta_squared": (
        lambda s, d: proxy.eta_squared(table(s, d, "customer"), "c_mktsegment", "c_acctbal").select(F.round("eta_squared", 8).alias("eta_squared")),
        "WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS sst FROM customer) SELECT round(sum(n * (g.m - t.m) * (g.m - t.m)) / max(sst), 8) AS eta_squared FROM g, t",
    ),
    **{
        name: (
            (lambda c: lambda s, d: proxy.cramers_v(audit(s, d).withColumn("a", F.expr(c)), "a", "grp").select(F.round("cramers_v", 8).alias("cramers_v")))(spark_a),
            f"""WITH {AUDIT}, c AS (SELECT coalesce(({a})::VARCHAR, '<missing>') AS a, grp AS b, count(*) AS n FROM base GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
            q AS (SELECT sum(n * n / (na * nb)::DOUBLE) AS q, count(DISTINCT a) AS r, count(DISTINCT b) AS k, max(t) AS t FROM m), z AS (SELECT greatest(0, q - 1 - (r - 1) * (k - 1) / (t - 1)) AS phi, r - (r - 1) * (r - 1) / (t - 1) AS rc, k - (k - 1) * (k - 1) / (t - 1) AS kc FROM q)
            SELECT round(coalesce(sqrt(phi / nullif(least(rc, kc) - 1, 0)), 0), 8) AS cramers_v FROM z""",
        )
        for name, a, spark_a in (("proxy_cramers_v", "prio", "prio"), ("proxy_missingness_v", "CASE WHEN entity_id % 5 = 0 OR grp = 'BUILDING' THEN 'missing' ELSE 'present' END", "CASE WHEN entity_id % 5 = 0 OR grp = 'BUILDING' THEN 'missing' ELSE 'present' END"))
    },
    "proxy_macro_auc": (
        lambda s, d: proxy.macro_auc(audit(s, d), "grp", "s", SEGMENTS).select(F.round("macro_auc", 8).alias("macro_auc")),
        f"""WITH {AUDIT}, k(c) AS (VALUES {", ".join(f"('{x}')" for x in SEGMENTS)}), r AS (SELECT c, s, count(*) FILTER (grp = c) AS f, count(*) FILTER (grp <> c) AS u FROM base, k GROUP BY 1, 2),
        b AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r), a AS (SELECT c, sum(f * (below + 0.5 * u)) / (sum(f) * sum(u)) AS auc FROM b GROUP BY c) SELECT round(avg(auc), 8) AS macro_auc FROM a""",
    ),
    "proxy_logistic": (_screened, None),
    "bootstrap_draws": (_draws, _DRAWS_SQL),
    "bootstrap_interval": (_interval, None),
    "multinomial_interval": (_multinomial, None),
    "holm_adjust": (
        lambda s, d: research.holm(_p_values(s, d)).select("test", F.round("p", 8).alias("p"), F.round("adjusted", 8).alias("adjusted")),
        "WITH x AS (SELECT n_name AS test, (n_nationkey + 1) / 400.0::DOUBLE AS p FROM nation), y AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS step FROM x) SELECT test, round(p, 8) AS p, round(max(step) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM y",
    ),
    "paired_mean": (
        lambda s, d: research.paired_mean(table(s, d, "lineitem"), "l_discount", "l_tax").select("n", *[F.round(c, 8).alias(c) for c in ("mean", "standard_error", "t")]),
        "SELECT count(*) AS n, round(avg(l_discount - l_tax), 8) AS mean, round(sqrt(var_samp(l_discount - l_tax) / count(*)), 8) AS standard_error, round(avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)), 8) AS t FROM lineitem",
    ),
}

