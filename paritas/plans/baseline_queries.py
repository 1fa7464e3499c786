"""Queries over a run's checks against a baseline: name -> (DataFrame, SQL)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from paritas.config import AuditConfig
from paritas.operators import baseline, validate
from paritas.plans.base import RAW, raw

GROUPS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
CONFIG = AuditConfig(
    outcome="y", score="s", favorable_outcome=1, protected=("grp",), reference={"grp": "BUILDING"}, allowed={"grp": GROUPS}, decision="d", favorable_decision=1, record_id="id", dataset_version="1",
    missing_policy="exclude", unknown_group_policy="exclude", duplicate_policy="exclude",
)
POLICY = baseline.Policy(group=0.003, missing=0.01, score=0.01, outcome=0.002)


def _profiles(s, d):
    rows = raw(s, d)
    return [baseline.profile(validate.flag_rows(rows.filter(F.col("id") % 3 == 0 if mine else F.col("id") % 3 != 0), CONFIG), CONFIG) for mine in (True, False)]


def _checks(s, d):
    current, base = _profiles(s, d)
    found = baseline.compare(current, base, "before", base.digest, POLICY)
    flags = {f["source_check_id"]: f["code"] for f in found["flags"]}
    rows = [(c["check_id"], c["code"], c["status"], *(None if c[k] is None else round(float(c[k]) if c["threshold"] != "equal" else float(str(c[k]) in ("True", "1")), 9) for k in ("current_value", "baseline_value")), c["reason_code"], flags.get(c["check_id"])) for c in found["checks"]]
    return s.createDataFrame(rows, "check_id string, code string, status string, current_value double, baseline_value double, reason_code string, flag string")  # labels and fields


def _id(code: str, scope: str) -> str:
    return f"{code}:{hashlib.sha256(scope.encode()).hexdigest()}"


def _sql() -> str:
    """Each check by its own aggregate; scopes are spelled out as text."""
    group = lambda g: f'{{"grp":{{"type":"string","value":"{g}"}}}}'
    parts = []
    for g in GROUPS:
        parts.append((_id("group_proportion_absolute_delta", f'{{"field":"grp","group":{group(g)}}}'), "group_proportion_absolute_delta", f"count(*) FILTER (ok AND grp = '{g}') / count(*) FILTER (ok)::DOUBLE", POLICY.group, "group_composition_changed"))
    for f in ("d", "grp", "id", "s", "y"):
        parts.append((_id("missingness_rate_absolute_delta", f'{{"field":"{f}"}}'), "missingness_rate_absolute_delta", f"count(*) FILTER ({f} IS NULL) / count(*)::DOUBLE", POLICY.missing, "missingness_changed"))
        parts += [(_id("missingness_rate_absolute_delta", f'{{"field":"{f}","group":{group(g)}}}'), "missingness_rate_absolute_delta", f"count(*) FILTER ({f} IS NULL AND grp = '{g}') / count(*) FILTER (grp = '{g}')::DOUBLE", POLICY.missing, "missingness_changed") for g in GROUPS]
    for p in ("0.0", "0.25", "0.5", "0.75", "1.0"):
        parts.append((_id("score_quantile_absolute_delta", f'{{"field":"s","quantile_probability":{p}}}'), "score_quantile_absolute_delta", f"quantile_cont(CASE WHEN ok THEN s END, {p})", POLICY.score, "score_distribution_changed"))
    for y in (0, 1):
        scope = f'{{"category":{{"type":"integer","value":{y}}},"field":"y"}}'
        parts.append((_id("outcome_category_presence_equal", scope), "outcome_category_presence_equal", f"(count(*) FILTER (ok AND y = {y}) > 0)::INT::DOUBLE", 0.5, "outcome_category"))
        parts.append((_id("outcome_proportion_absolute_delta", scope), "outcome_proportion_absolute_delta", f"count(*) FILTER (ok AND y = {y}) / count(*) FILTER (ok)::DOUBLE", POLICY.outcome, "outcome_distribution_changed"))
    parts.append((_id("dataset_version_equal", "{}"), "dataset_version_equal", "1::DOUBLE", 0.5, "dataset_version_changed"))
    rows = " UNION ALL ".join(f"SELECT '{i}' AS check_id, '{code}' AS code, max(v) FILTER (mine) AS a, max(v) FILTER (NOT mine) AS b, {limit!r}::DOUBLE AS t, '{flag}' AS f FROM (SELECT mine, {v} AS v FROM x GROUP BY mine)" for i, code, v, limit, flag in parts)
    return f"""WITH {RAW}, x AS (SELECT *, id % 3 = 0 AS mine, NOT (missing_required_value OR unknown_protected_group OR duplicate_record OR non_finite_numeric) AS ok FROM flags), c AS ({rows})
SELECT check_id, code, 'evaluated' AS status, round(a, 9) AS current_value, round(b, 9) AS baseline_value, NULL::VARCHAR AS reason_code, CASE WHEN abs(a - b) >= t THEN f END AS flag FROM c
UNION ALL SELECT '{_id("model_version_equal", "{}")}', 'model_version_equal', 'not_computable', NULL, NULL, 'version_unavailable', NULL"""


QUERIES = {"baseline_checks": (_checks, _sql())}
