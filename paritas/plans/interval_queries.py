"""Queries over bootstrap intervals of an audit's metrics: name -> (DataFrame, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.operators import bootstrap, resample, risk_bootstrap
from paritas.plans.base import AUDIT, REFERENCE, SEGMENTS, audit, table

RESAMPLES, SEED, CONFIDENCE = 6, 7, 0.8
_COMPARED = ("selection_rate_difference", "adverse_impact_ratio", "equal_opportunity_difference", "equalized_odds_gap")
_SCOPE = ("selection_rate", "precision", "false_positive_rate", "brier_score", "roc_auc")
_GROUPS = [g for g in SEGMENTS if g != REFERENCE["grp"]]


def _rows(s, d):
    return audit(s, d).select("y", "d", "s", "w", "entity_id", F.lit("grp").alias("attribute"), F.col("grp").alias("value"))


def _found(s, d, wanted):
    requests = s.createDataFrame(wanted, "key string, metric string, role string, attribute string, value string")
    out = resample.intervals(_rows(s, d), requests, RESAMPLES, SEED, bootstrap.DOMAIN, "entity_id", CONFIDENCE, 3)
    return out.select("key", "valid", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def _comparisons(s, d):
    return _found(s, d, [(f"{m}.{g}", m, role, "grp", v) for m in _COMPARED for g in _GROUPS for role, v in (("comparison", g), ("reference", REFERENCE["grp"]))])


def _scopes(s, d):
    return _found(s, d, [(f"{m}.{g}", m, "scope", "grp", g) for m in _SCOPE for g in SEGMENTS])


_NUL = "'\\x00'::BLOB"


def _draws(roles: str) -> str:
    """Streams by definition: the SHA-256 of prefix, seed, key, role and counter, four positions a block."""
    return f"""{AUDIT}, rows AS (SELECT grp, y, d, s, w, row_number() OVER (PARTITION BY grp ORDER BY entity_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM base),
size AS (SELECT grp, max(n) AS n FROM rows GROUP BY grp), req AS ({roles}), st AS (SELECT req.*, n FROM req JOIN size ON grp = value),
blk AS (SELECT key, metric, role, value, n, id, sha256(encode('{bootstrap.DOMAIN[:-1]}') || {_NUL} || encode('{SEED}') || {_NUL} || encode(key) || {_NUL} || encode(role) || unhex(printf('%016x', id))) AS h
  FROM (SELECT *, unnest(range(0, (n * {RESAMPLES} + 3) // 4)) AS id FROM st)),
pos AS (SELECT key, metric, role, value, n, id * 4 + k AS at, ('0x' || substr(h, (16 * k + 1)::INT, 16))::UBIGINT % n AS i FROM blk, range(4) u(k)),
met AS (SELECT pos.key, pos.metric, pos.role, pos.at // pos.n AS draw, rows.y, rows.d, rows.s, rows.w FROM pos JOIN rows ON rows.grp = pos.value AND rows.i = pos.i WHERE pos.at < pos.n * {RESAMPLES}),
c AS (SELECT key, metric, role, draw, sum(w) AS w, sum(CASE WHEN d THEN w ELSE 0 END) AS dw, sum(CASE WHEN y THEN w ELSE 0 END) AS yw, sum(CASE WHEN y AND d THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT y AND d THEN w ELSE 0 END) AS fp, sum(w * (s - y::INT) * (s - y::INT)) AS sq FROM met GROUP BY 1, 2, 3, 4)"""


_END = f"SELECT key, count(v) AS valid, round(quantile_cont(v, {(1 - CONFIDENCE) / 2!r}), 9) AS lower, round(quantile_cont(v, {1 - (1 - CONFIDENCE) / 2!r}), 9) AS upper FROM v GROUP BY key"
_COMPARISONS_SQL = f"""WITH {_draws(" UNION ALL ".join(f"SELECT '{m}.{g}' AS key, '{m}' AS metric, '{role}' AS role, '{v}' AS value" for m in _COMPARED for g in _GROUPS for role, v in (("comparison", g), ("reference", REFERENCE["grp"]))))},
r AS (SELECT *, dw / w AS sr, tp / nullif(yw, 0) AS tpr, fp / nullif(w - yw, 0) AS fpr FROM c),
v AS (SELECT a.key, CASE a.metric WHEN 'selection_rate_difference' THEN a.sr - b.sr WHEN 'adverse_impact_ratio' THEN a.sr / nullif(b.sr, 0) WHEN 'equal_opportunity_difference' THEN a.tpr - b.tpr
  ELSE greatest(abs(a.tpr - b.tpr), abs(a.fpr - b.fpr)) END AS v FROM r a JOIN r b ON a.key = b.key AND a.draw = b.draw WHERE a.role = 'comparison' AND b.role = 'reference') {_END}"""
_SCOPES_SQL = f"""WITH {_draws(" UNION ALL ".join(f"SELECT '{m}.{g}' AS key, '{m}' AS metric, 'scope' AS role, '{g}' AS value" for m in _SCOPE for g in SEGMENTS))},
t AS (SELECT key, draw, s, sum(CASE WHEN y THEN w ELSE 0 END) AS f, sum(CASE WHEN y THEN 0 ELSE w END) AS u FROM met WHERE metric = 'roc_auc' GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(u) OVER (PARTITION BY key, draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
v AS (SELECT key, CASE metric WHEN 'selection_rate' THEN dw / w WHEN 'precision' THEN tp / nullif(dw, 0) WHEN 'false_positive_rate' THEN fp / nullif(w - yw, 0) ELSE sq / w END AS v FROM c WHERE metric <> 'roc_auc'
  UNION ALL SELECT key, sum(f * (below + 0.5 * u)) / nullif(sum(f) * sum(u), 0) FROM b GROUP BY key, draw) {_END}"""

EDGES, FRACTIONS, RISK_RESAMPLES = [0.25, 0.5, 0.75], [0.1, 0.3], 5


def _entities(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("entity_id"), (((k * 37) % 101) / F.lit(101.0)).alias("s"), ((k * 37) % 101 + k % 60 > 110).alias("bad"), (k % 3).cast("double").alias("w"))


def _risk(s, d):
    # slopes have no SQL form: they are tested against plain Python
    out = risk_bootstrap.evidence(_entities(s, d), EDGES, FRACTIONS, RISK_RESAMPLES, 3, SEED).filter("metric_key <> 'calibration_slope'")
    return out.select("metric_key", "valid_resamples", "reliable", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


_VALUES = {f"band.{i}.observed_bad_rate": f"sum(b) FILTER (band = {i}) / sum(w) FILTER (band = {i})" for i in range(len(EDGES) + 1)}
for _f in FRACTIONS:
    _taken = f"FILTER (cw < {_f!r} * tw)"
    _VALUES |= {f"top.{_f:g}.bad_capture": f"sum(b) {_taken} / max(tb)", f"top.{_f:g}.selected_bad_rate": f"sum(b) {_taken} / sum(w) {_taken}", f"top.{_f:g}.lift": f"(sum(b) {_taken} / sum(w) {_taken}) / (max(tb) / max(tw))"}
_VALUES |= {
    "ks": "max(abs((cb + b) / tb - (cw + w - cb - b) / (tw - tb)))", "risk_auc": "sum(b * (below + 0.5 * (w - b))) / (max(tb) * (max(tw) - max(tb)))", "gini": "2 * sum(b * (below + 0.5 * (w - b))) / (max(tb) * (max(tw) - max(tb))) - 1",
    "brier_score": "sum(b * (s - 1) * (s - 1) + (w - b) * s * s) / max(tw)", "calibration_in_the_large": "sum(w * s) / max(tw) - max(tb) / max(tw)",
}
_RISK_SQL = f"""WITH e AS (SELECT o_orderkey AS id, ((o_orderkey * 37) % 101) / 101.0::DOUBLE AS s, (o_orderkey * 37) % 101 + o_orderkey % 60 > 110 AS bad, (o_orderkey % 3)::DOUBLE / 2 AS w FROM orders WHERE o_orderkey % 3 > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY bad) AS n FROM e),
st AS (SELECT bad, max(n) AS n FROM p GROUP BY bad),
blk AS (SELECT bad, n, id, sha256(encode('{bootstrap.DOMAIN[:-1]}') || {_NUL} || encode('{SEED}') || {_NUL} || encode('{risk_bootstrap.KEY}') || {_NUL} || encode(CASE WHEN bad THEN 'comparison' ELSE 'reference' END) || unhex(printf('%016x', id))) AS h
  FROM (SELECT *, unnest(range(0, (n * {RISK_RESAMPLES} + 3) // 4)) AS id FROM st)),
pos AS (SELECT bad, n, id * 4 + k AS spot, ('0x' || substr(h, (16 * k + 1)::INT, 16))::UBIGINT % n AS i FROM blk, range(4) u(k)),
r AS (SELECT spot // pos.n AS draw, s, sum(w) AS w, sum(CASE WHEN p.bad THEN w ELSE 0 END) AS b FROM pos JOIN p ON p.bad = pos.bad AND p.i = pos.i WHERE spot < pos.n * {RISK_RESAMPLES} GROUP BY 1, 2),
t AS (SELECT *, (s >= 0.25)::INT + (s >= 0.5)::INT + (s >= 0.75)::INT AS band, sum(w) OVER (PARTITION BY draw) AS tw, sum(b) OVER (PARTITION BY draw) AS tb, coalesce(sum(w) OVER z, 0) AS cw, coalesce(sum(b) OVER z, 0) AS cb,
  coalesce(sum(w - b) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r WINDOW z AS (PARTITION BY draw ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric_key, draw, {e} AS v FROM t GROUP BY draw" for k, e in _VALUES.items())})
SELECT metric_key, count(v) AS valid_resamples, count(v) >= 3 AS reliable, round(quantile_cont(v, 0.025), 8) AS lower, round(quantile_cont(v, 0.975), 8) AS upper FROM v GROUP BY metric_key"""

QUERIES = {"comparison_interval": (_comparisons, _COMPARISONS_SQL), "scope_interval": (_scopes, _SCOPES_SQL), "risk_bootstrap": (_risk, _RISK_SQL)}
