"""Queries over the core audit, its profile and drift: name -> (DataFrame, SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paritas.config import AuditConfig
from paritas.operators import metrics, profile, research, validate
from paritas.plans.base import ALLOWED, AUDIT, RAW, REFERENCE, audit, raw, table

CONFIG = AuditConfig(
    outcome="y", score="s", favorable_outcome=1, protected=("grp",), reference={"grp": "BUILDING"}, allowed={"grp": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")},
    decision="d", favorable_decision=1, record_id="id", missing_policy="exclude", unknown_group_policy="exclude", duplicate_policy="exclude", expected_categories={"y": (1,)},
)
FLAGS = ", ".join(validate.REASONS)


def _flag(reason):
    return lambda s, d: validate.flag_rows(raw(s, d), CONFIG).groupBy(reason).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _flag_sql(reason):
    return f"WITH {RAW} SELECT {reason}, count(*) AS n, sum(id)::BIGINT AS ids FROM marked GROUP BY 1"


def _stats(s, d):
    return metrics.scope_stats(audit(s, d), ALLOWED)


def _metric(name):
    auc = name == "roc_auc"

    def run(s, d):
        rows = audit(s, d)
        long = metrics.scope_metrics(metrics.scope_stats(rows, ALLOWED), True, metrics.scope_auc(rows, ALLOWED) if auc else None)
        return long.filter(F.col("metric") == name).select("attribute", "value", F.round("metric_value", 8).alias("metric_value"), "reason", "n")

    return run


_SCOPES = ", ".join(f"('{a}', '{v}')" for a, vs in ALLOWED.items() for v in vs)
SCOPED = f"""WITH {AUDIT}, dim(attribute, value) AS (VALUES ('__scope__', 'overall'), {_SCOPES}),
long AS (SELECT '__scope__' AS attribute, 'overall' AS value, y, d, s, w FROM base UNION ALL SELECT 'grp', grp, y, d, s, w FROM base UNION ALL SELECT 'prio', prio, y, d, s, w FROM base),
st AS (SELECT dim.attribute, dim.value, count(l.w) AS n, coalesce(sum(l.w), 0) AS w, coalesce(sum(l.w * (s - y::INT) * (s - y::INT)), 0) AS sq,
  count(*) FILTER (y AND d) AS tp, count(*) FILTER (NOT y AND d) AS fp, count(*) FILTER (y AND NOT d) AS fn, count(*) FILTER (NOT y AND NOT d) AS tn,
  coalesce(sum(l.w) FILTER (y AND d), 0) AS wtp, coalesce(sum(l.w) FILTER (NOT y AND d), 0) AS wfp, coalesce(sum(l.w) FILTER (y AND NOT d), 0) AS wfn, coalesce(sum(l.w) FILTER (NOT y AND NOT d), 0) AS wtn
  FROM dim LEFT JOIN long l USING (attribute, value) GROUP BY 1, 2)"""
_FORMULA = {
    "selection_rate": ("wtp + wfp", "w", "false", "''"), "denial_rate": ("wfn + wtn", "w", "false", "''"), "accuracy": ("wtp + wtn", "w", "false", "''"),
    "precision": ("wtp", "wtp + wfp", "tp + fp = 0", "'no_favorable_decisions'"), "true_positive_rate": ("wtp", "wtp + wfn", "tp + fn = 0", "'no_favorable_outcomes'"),
    "false_positive_rate": ("wfp", "wfp + wtn", "fp + tn = 0", "'no_unfavorable_outcomes'"), "false_negative_rate": ("wfn", "wtp + wfn", "tp + fn = 0", "'no_favorable_outcomes'"),
    "brier_score": ("sq", "w", "false", "''"),
}


def _metric_sql(name):
    num, den, empty, why = _FORMULA[name]
    return f"{SCOPED} SELECT attribute, value, round(CASE WHEN n > 0 AND NOT ({empty}) THEN ({num}) / ({den}) END, 8) AS metric_value, CASE WHEN n = 0 THEN 'empty_population' WHEN {empty} THEN {why} END AS reason, n FROM st"


_AUC_SQL = """, r AS (SELECT attribute, value, s, sum(CASE WHEN y THEN {w} ELSE 0 END) AS f, sum(CASE WHEN y THEN 0 ELSE {w} END) AS u FROM long GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY attribute, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r),
a AS (SELECT attribute, value, sum(f * (below + 0.5 * u)) / nullif(sum(f) * sum(u), 0) AS auc FROM b GROUP BY 1, 2)"""


def _auc_unweighted(s, d):
    rows = audit(s, d).withColumn("w", F.lit(1.0))
    return metrics.scope_auc(rows, ALLOWED).select("attribute", "value", F.round("auc", 8).alias("auc"))


def _comparison(*columns):
    return lambda s, d: metrics.compare(_stats(s, d), REFERENCE).select("attribute", "value", "reference", *[F.round(c, 8).alias(c) if c != "air_reason" else c for c in columns])


_REFS = " OR ".join(f"(attribute = '{a}' AND value = '{v}')" for a, v in REFERENCE.items())
COMPARED = f"""{SCOPED}, wide AS (SELECT attribute, value, n, ({_REFS}) AS is_ref, (wtp + wfp) / nullif(w, 0) AS sr, wtp / nullif(wtp + wfn, 0) AS tpr, wfp / nullif(wfp + wtn, 0) AS fpr FROM st WHERE attribute <> '__scope__'),
cmp AS (SELECT c.attribute, c.value, r.value AS reference, c.sr AS comparison_rate, r.sr AS reference_rate, c.sr - r.sr AS selection_rate_difference, c.sr / nullif(r.sr, 0) AS adverse_impact_ratio,
  CASE WHEN c.sr IS NULL THEN 'comparison_metric_undefined' WHEN r.sr IS NULL THEN 'reference_metric_undefined' WHEN r.sr = 0 THEN 'zero_reference_selection_rate' END AS air_reason,
  c.tpr - r.tpr AS equal_opportunity_difference, CASE WHEN c.tpr - r.tpr IS NOT NULL AND c.fpr - r.fpr IS NOT NULL THEN greatest(abs(c.tpr - r.tpr), abs(c.fpr - r.fpr)) END AS equalized_odds_gap,
  c.n + r.n AS sample_count, least(c.n, r.n) AS smaller FROM wide c JOIN wide r ON c.attribute = r.attribute AND r.is_ref WHERE NOT c.is_ref)"""


def _comparison_sql(*columns):
    return f"{COMPARED} SELECT attribute, value, reference, {', '.join(f'round({c}, 8) AS {c}' if c != 'air_reason' else c for c in columns)} FROM cmp"


def _gates(s, d):
    rows = audit(s, d)
    return metrics.reliability(metrics.scope_metrics(metrics.scope_stats(rows, ALLOWED), True, metrics.scope_auc(rows, ALLOWED)), 120)


_LIMIT = 120
_GATES_SQL = f"""{SCOPED}, m(metric) AS (VALUES {", ".join(f"('{m}')" for m in metrics.SCOPE_METRICS)}),
x AS (SELECT *, CASE WHEN n = 0 THEN 'empty_population' WHEN metric = 'precision' AND tp + fp = 0 THEN 'no_favorable_decisions'
  WHEN metric IN ('true_positive_rate', 'false_negative_rate', 'roc_auc') AND tp + fn = 0 THEN 'no_favorable_outcomes' WHEN metric IN ('false_positive_rate', 'roc_auc') AND fp + tn = 0 THEN 'no_unfavorable_outcomes' END AS reason FROM st, m),
g AS (SELECT attribute, value, metric, CASE WHEN reason IS NULL THEN list_filter([CASE WHEN n < {_LIMIT} THEN 'small_group' END,
  CASE WHEN metric NOT IN ('selection_rate', 'denial_rate') AND least(tp + fn, fp + tn) < {_LIMIT} THEN 'severe_outcome_imbalance' END,
  CASE WHEN metric = 'precision' AND tp + fp < {_LIMIT} THEN 'sparse_decision_support' END], lambda c: c IS NOT NULL) ELSE [] END AS codes, reason FROM x)"""


def _profile_rows(s, d):
    return raw(s, d)


def _half(s, d, odd):
    return raw(s, d).filter((F.col("id") % 3 == 0) if odd else (F.col("id") % 3 != 0))


_LIMITS = {"group_proportion": 0.01, "missingness_rate": 0.005, "score_quantile": 0.01, "outcome_proportion": 0.01}


def _drift(s, d):
    sides = [profile.facets(_half(s, d, odd), "s", "y", "grp", ["s", "grp"]) for odd in (False, True)]
    return profile.drift(*sides, _LIMITS).select("code", "scope", F.round("current", 8).alias("current"), F.round("baseline", 8).alias("baseline"), "status")


def _facets_sql(name, cond):
    return f"""{name}h AS (SELECT * FROM raw WHERE {cond}),
{name} AS (SELECT 'group_proportion' AS code, grp AS scope, count(*) / sum(count(*)) OVER () AS measure FROM {name}h GROUP BY grp
 UNION ALL SELECT 'missingness_rate', 's|overall', avg((s IS NULL)::INT) FROM {name}h UNION ALL SELECT 'missingness_rate', 'grp|overall', avg((grp IS NULL)::INT) FROM {name}h
 UNION ALL SELECT 'missingness_rate', 's|group:' || grp, avg((s IS NULL)::INT) FROM {name}h WHERE grp IS NOT NULL GROUP BY grp
 UNION ALL SELECT 'missingness_rate', 'grp|group:' || grp, avg((grp IS NULL)::INT) FROM {name}h WHERE grp IS NOT NULL GROUP BY grp
 {" ".join(f"UNION ALL SELECT 'score_quantile', '{p}', quantile_cont(s, {p}) FROM {name}h" for p in profile.QUANTILES)}
 UNION ALL SELECT 'outcome_proportion', y::VARCHAR, count(*) / sum(count(*)) OVER () FROM {name}h GROUP BY y)"""


_LIMIT_CASE = "CASE coalesce(c.code, b.code) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LIMITS.items()) + " END"
_DRIFT_SQL = f"""WITH {RAW}, {_facets_sql('cur', 'id % 3 <> 0')}, {_facets_sql('bas', 'id % 3 = 0')},
both_ AS (SELECT coalesce(c.code, b.code) AS code, coalesce(c.scope, b.scope) AS scope, CASE WHEN coalesce(c.code, b.code) LIKE '%proportion' THEN coalesce(c.measure, 0) ELSE c.measure END AS current,
  CASE WHEN coalesce(c.code, b.code) LIKE '%proportion' THEN coalesce(b.measure, 0) ELSE b.measure END AS baseline, {_LIMIT_CASE} AS lim
  FROM (SELECT * FROM cur WHERE scope IS NOT NULL) c FULL JOIN (SELECT * FROM bas WHERE scope IS NOT NULL) b ON c.code = b.code AND c.scope = b.scope)
SELECT code, scope, round(current, 8) AS current, round(baseline, 8) AS baseline,
  CASE WHEN abs(current - baseline) IS NULL THEN 'not_computable' WHEN abs(current - baseline) >= lim THEN 'changed' ELSE 'stable' END AS status FROM both_"""

_TEXT = "regexp_replace(o_orderpriority, '[^0-9]', '', 'g')"


def _numeric_text(s, d):
    t = table(s, d, "orders").select(F.concat(F.regexp_replace("o_orderpriority", "[^0-9]", ""), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise("")).alias("v"))
    return research.numeric_text(t.select(F.when(F.col("v") != "3", F.col("v")).alias("v")), "v")


QUERIES = {
    "scan_filter_project": (
        lambda s, d: table(s, d, "orders").filter(F.col("o_totalprice") > 100000).select("o_orderkey", "o_custkey", "o_totalprice"),
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    ),
    "typed_label_filter": (
        lambda s, d: _typed(s, d),
        "SELECT 'string' AS label, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'integer', 0 FROM (SELECT 1)",
    ),
    "derived_decision_ge": (lambda s, d: audit(s, d).select("entity_id", (F.col("s") >= 0.5).alias("decision")), f"WITH {AUDIT} SELECT entity_id, s >= 0.5 AS decision FROM base"),
    "derived_decision_le": (lambda s, d: audit(s, d).select("entity_id", (F.col("s") <= 0.5).alias("decision")), f"WITH {AUDIT} SELECT entity_id, s <= 0.5 AS decision FROM base"),
    "score_orientation": (lambda s, d: audit(s, d).select("entity_id", (1 - F.col("s")).alias("oriented")), f"WITH {AUDIT} SELECT entity_id, 1 - s AS oriented FROM base"),
    "missing_flags": (_flag("missing_required_value"), _flag_sql("missing_required_value")),
    "duplicate_flags": (_flag("duplicate_record"), _flag_sql("duplicate_record")),
    "nonfinite_flags": (_flag("non_finite_numeric"), _flag_sql("non_finite_numeric")),
    "unknown_group_flags": (_flag("unknown_protected_group"), _flag_sql("unknown_protected_group")),
    "unexpected_category_flags": (_flag("unexpected_category"), _flag_sql("unexpected_category")),
    "reason_counts": (
        lambda s, d: validate.reason_counts(validate.flag_rows(raw(s, d), CONFIG)),
        f"WITH {RAW} SELECT count(*) AS input_rows, {', '.join(f'count(*) FILTER ({r}) AS {r}' for r in validate.REASONS)}, count(*) FILTER (excluded) AS excluded_rows FROM marked",
    ),
    "exclusion_evidence": (
        lambda s, d: validate.exclusion_evidence(validate.flag_rows(raw(s, d), CONFIG), CONFIG),
        f"""WITH {RAW} SELECT 'unknown_protected_group' AS reason, 'grp' AS attribute, grp AS value, count(*) AS rows FROM marked WHERE unknown_protected_group GROUP BY grp
        UNION ALL SELECT 'missing_required_value', 'grp', NULL, count(*) FROM marked WHERE grp IS NULL HAVING count(*) > 0 UNION ALL SELECT 'missing_required_value', 's', NULL, count(*) FROM marked WHERE s IS NULL HAVING count(*) > 0""",
    ),
    "exclusion_projection": (
        lambda s, d: validate.exclusion_projection(validate.reason_counts(validate.flag_rows(raw(s, d), CONFIG))),
        f"""WITH {RAW}, hits AS (SELECT unnest(['duplicate_record', 'missing_required_value', 'non_finite_numeric', 'unexpected_category', 'unknown_protected_group']) AS reason,
          unnest([count(*) FILTER (duplicate_record), count(*) FILTER (missing_required_value), count(*) FILTER (non_finite_numeric), count(*) FILTER (unexpected_category), count(*) FILTER (unknown_protected_group)]) AS n FROM marked),
        turns AS (SELECT reason, row_number() OVER (ORDER BY reason, k) AS turn FROM (SELECT reason, unnest(range(n)) AS k FROM hits))
        SELECT reason, count(*) AS rows FROM turns WHERE turn <= (SELECT count(*) FROM marked WHERE excluded) GROUP BY 1""",
    ),
    "small_groups": (
        lambda s, d: validate.small_groups(validate.eligible(validate.flag_rows(raw(s, d), CONFIG)), CONFIG.protected, 1_000_000),
        f"WITH {RAW} SELECT 'grp' AS attribute, grp AS value, count(*) AS rows FROM marked WHERE NOT excluded GROUP BY grp HAVING count(*) < 1000000",
    ),
    "eligible_rows": (lambda s, d: validate.eligible(validate.flag_rows(raw(s, d), CONFIG)), f"WITH {RAW} SELECT id, grp, y, s, d FROM marked WHERE NOT excluded"),
    **{f"scope_{k}": (_metric(m), _metric_sql(m)) for k, m in (("selection_rate", "selection_rate"), ("denial_rate", "denial_rate"), ("accuracy", "accuracy"), ("precision", "precision"), ("tpr", "true_positive_rate"), ("fpr", "false_positive_rate"), ("fnr", "false_negative_rate"), ("brier", "brier_score"))},
    "scope_auc": (_auc_unweighted, SCOPED + _AUC_SQL.replace("{w}", "1") + " SELECT attribute, value, round(auc, 8) AS auc FROM a"),
    "scope_auc_weighted": (lambda s, d: metrics.scope_auc(audit(s, d), ALLOWED).select("attribute", "value", F.round("auc", 8).alias("auc")), SCOPED + _AUC_SQL.replace("{w}", "w") + " SELECT attribute, value, round(auc, 8) AS auc FROM a"),
    "scope_weighted_rates": (
        lambda s, d: _stats(s, d).select("attribute", "value", "n", "w", "wtp", "wfp", "wfn", "wtn"),
        f"{SCOPED} SELECT attribute, value, n, w::DOUBLE AS w, wtp::DOUBLE AS wtp, wfp::DOUBLE AS wfp, wfn::DOUBLE AS wfn, wtn::DOUBLE AS wtn FROM st",
    ),
    "scope_empty_groups": (lambda s, d: _stats(s, d).filter("n = 0").select("attribute", "value", "n"), f"{SCOPED} SELECT attribute, value, n FROM st WHERE n = 0"),
    "scope_grouping_sets": (
        lambda s, d: _grouping_sets(s, d),
        f"WITH {AUDIT} SELECT grp, prio, count(*) AS n, count(*) FILTER (d) AS selected FROM base GROUP BY GROUPING SETS ((), (grp), (prio))",
    ),
    "cmp_selection_diff": (_comparison("comparison_rate", "reference_rate", "selection_rate_difference"), _comparison_sql("comparison_rate", "reference_rate", "selection_rate_difference")),
    "cmp_air": (_comparison("comparison_rate", "reference_rate", "adverse_impact_ratio", "air_reason"), _comparison_sql("comparison_rate", "reference_rate", "adverse_impact_ratio", "air_reason")),
    "cmp_eod": (_comparison("equal_opportunity_difference"), _comparison_sql("equal_opportunity_difference")),
    "cmp_eodds_gap": (_comparison("equalized_odds_gap"), _comparison_sql("equalized_odds_gap")),
    "air_flags": (
        lambda s, d: metrics.air_flags(metrics.compare(_stats(s, d), REFERENCE), 1.0, 30).select("attribute", "value", "reference", F.round("adverse_impact_ratio", 8).alias("adverse_impact_ratio"), "sample_count"),
        f"{COMPARED} SELECT attribute, value, reference, round(adverse_impact_ratio, 8) AS adverse_impact_ratio, sample_count FROM cmp WHERE air_reason IS NULL AND smaller >= 30 AND adverse_impact_ratio < 1.0",
    ),
    "reliability_gates": (
        lambda s, d: _gates(s, d).select("attribute", "value", "metric", F.array_join("limitations", ",").alias("limitations"), "reliability"),
        f"{_GATES_SQL} SELECT attribute, value, metric, array_to_string(codes, ',') AS limitations, CASE WHEN reason IS NOT NULL THEN 'undefined' WHEN len(codes) = 0 THEN 'reliable' ELSE 'unreliable' END AS reliability FROM g",
    ),
    "limitation_rollup": (
        lambda s, d: _gates(s, d).select(F.explode("limitations").alias("code"), "metric").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("metric").alias("metrics")),
        f"{_GATES_SQL} SELECT code, count(*) AS n, count(DISTINCT metric) AS metrics FROM (SELECT unnest(codes) AS code, metric FROM g) GROUP BY code",
    ),
    "profile_missingness": (
        lambda s, d: profile.missingness(raw(s, d), ["s", "grp"], "grp").select("field", "scope", "missing", "total", F.round("rate", 8).alias("rate")),
        f"""WITH {RAW}, f AS (SELECT 's' AS field, s IS NULL AS m, grp FROM raw UNION ALL SELECT 'grp', grp IS NULL, grp FROM raw)
        SELECT field, 'overall' AS scope, count(*) FILTER (m) AS missing, count(*) AS total, round(avg(m::INT), 8) AS rate FROM f GROUP BY field
        UNION ALL SELECT field, 'group:' || grp, count(*) FILTER (m), count(*), round(avg(m::INT), 8) FROM f WHERE grp IS NOT NULL GROUP BY field, grp""",
    ),
    "profile_group_sizes": (
        lambda s, d: _stats(s, d).select("attribute", "value", "n", F.round(F.try_divide("n", F.max("n").over(Window.partitionBy())), 8).alias("share")),
        f"{SCOPED} SELECT attribute, value, n, round(n / max(n) OVER (), 8) AS share FROM st",
    ),
    "profile_distribution": (
        lambda s, d: profile.distribution(audit(s, d), "s").select("minimum", "maximum", F.round("mean", 8).alias("mean"), F.round("deviation", 8).alias("deviation")),
        f"WITH {AUDIT} SELECT min(s) AS minimum, max(s) AS maximum, round(avg(s), 8) AS mean, round(stddev_pop(s), 8) AS deviation FROM base",
    ),
    "profile_quantiles": (
        lambda s, d: profile.distribution(table(s, d, "orders"), "o_totalprice").select(F.posexplode("quantiles").alias("i", "q")).select("i", F.round("q", 6).alias("q")),
        " UNION ALL ".join(f"SELECT {i} AS i, round(quantile_cont(o_totalprice, {p}), 6) AS q FROM orders" for i, p in enumerate(profile.QUANTILES)),
    ),
    "profile_outliers": (
        lambda s, d: profile.outliers(table(s, d, "orders"), "o_totalprice").select(F.round("lower_fence", 4).alias("lower_fence"), F.round("upper_fence", 4).alias("upper_fence"), "below", "above", "total"),
        """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
        SELECT round(max(a - 1.5 * (b - a)), 4) AS lower_fence, round(max(b + 1.5 * (b - a)), 4) AS upper_fence, count(*) FILTER (o_totalprice < a - 1.5 * (b - a)) AS below, count(*) FILTER (o_totalprice > b + 1.5 * (b - a)) AS above, count(*) AS total FROM orders, q""",
    ),
    "profile_outcomes": (
        lambda s, d: profile.counts(table(s, d, "orders"), "o_orderstatus").select("value", "n", F.round("share", 8).alias("share")),
        "SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1",
    ),
    "profile_anomalies": (
        lambda s, d: validate.reason_counts(validate.flag_rows(raw(s, d), CONFIG)).select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("rows"), F.round(F.try_divide(F.col(r), F.col("input_rows")), 8).alias("rate")) for r in validate.REASONS])).alias("x")).select("x.*"),
        f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{r}' AS reason, count(*) FILTER ({r}) AS rows, round(count(*) FILTER ({r}) / count(*), 8) AS rate FROM marked" for r in validate.REASONS),
    ),
    "drift_checks": (lambda s, d: _drift(s, d).filter("scope IS NOT NULL"), _DRIFT_SQL),
    "numeric_text_summary": (
        _numeric_text,
        f"""WITH t AS (SELECT {_TEXT} || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END AS v FROM orders), u AS (SELECT CASE WHEN v <> '3' THEN v END AS v FROM t), x AS (SELECT v, try_cast(v AS DOUBLE) AS n FROM u)
        SELECT count(*) FILTER (coalesce(v, '') = '') AS missing, count(*) FILTER (v <> '' AND n IS NULL) AS non_finite, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n < 0) AS negative, min(n) AS minimum, max(n) AS maximum FROM x""",
    ),
    "blank_missingness": (lambda s, d: research.blanks(raw(s, d).select("id", "grp", "s")), f"WITH {RAW} SELECT 'id' AS \"column\", count(*) FILTER (id IS NULL) AS missing FROM raw UNION ALL SELECT 'grp', count(*) FILTER (grp IS NULL) FROM raw UNION ALL SELECT 's', count(*) FILTER (s IS NULL) FROM raw"),
    "identifier_year_histogram": (lambda s, d: table(s, d, "orders").groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("n")), "SELECT substr(o_orderdate::VARCHAR, 1, 4) AS year, count(*) AS n FROM orders GROUP BY 1"),
    "special_response_counts": (
        lambda s, d: research.special_responses(table(s, d, "orders"), {"refused": {"o_orderstatus": ["P"], "o_orderpriority": ["5-LOW"]}, "unknown": {"o_orderstatus": ["O"]}}),
        "SELECT 'refused' AS category, 'o_orderstatus' AS \"column\", count(*) FILTER (o_orderstatus = 'P') AS n FROM orders UNION ALL SELECT 'refused', 'o_orderpriority', count(*) FILTER (o_orderpriority = '5-LOW') FROM orders UNION ALL SELECT 'unknown', 'o_orderstatus', count(*) FILTER (o_orderstatus = 'O') FROM orders",
    ),
    "table_digest": (lambda s, d: research.table_digest(table(s, d, "orders")), None),
}


def _typed(s, d):
    from paritas.functions.typed import is_label

    o = table(s, d, "orders")
    one = o.agg(F.sum(is_label(o, "o_orderstatus", "F").cast("long")).alias("string"), F.sum(is_label(o, "o_orderstatus", 1).cast("long")).alias("integer"))
    return one.select(F.explode(F.array(F.struct(F.lit("string").alias("label"), F.col("string").alias("n")), F.struct(F.lit("integer").alias("label"), F.col("integer").alias("n")))).alias("x")).select("x.*")


def _grouping_sets(s, d):
    audit(s, d).createOrReplaceTempView("audit_base")
    return s.sql("SELECT grp, prio, count(*) AS n, sum(CAST(d AS BIGINT)) AS selected FROM audit_base GROUP BY GROUPING SETS ((), (grp), (prio))")
