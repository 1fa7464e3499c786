"""Baseline comparison: two profiles by named checks, all or nothing where they are not comparable.

A profile is a table of facets, one value for each (code, scope), where a scope is canonical JSON. Facets are
aggregates: as many as there are labels and fields. Checks are named by the digest of their scope, so a check has
one name in every run, whatever its rows. A profile's digest is that of its facets in order.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.config import AuditConfig, Label
from paritas.functions import running, typed
from paritas.operators import validate

PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Checks in canonical order, their statistic and the flag that a change raises.
CHECKS = {
    "group_proportion_absolute_delta": ("group", "absolute_proportion_delta", "group_composition_changed"),
    "missingness_rate_absolute_delta": ("missing", "absolute_rate_delta", "missingness_changed"),
    "score_quantile_absolute_delta": ("score", "absolute_quantile_delta", "score_distribution_changed"),
    "outcome_category_presence_equal": ("equal", "exact_equality", None),
    "outcome_proportion_absolute_delta": ("outcome", "absolute_proportion_delta", "outcome_distribution_changed"),
    "dataset_version_equal": ("equal", "exact_equality", "dataset_version_changed"),
    "model_version_equal": ("equal", "exact_equality", "model_version_changed"),
}
_SEMANTICS = ("outcome", "score", "favorable_outcome", "favorable_decision", "score_type", "score_direction", "required")
_GROUPS = ("protected", "allowed", "reference")
_METHODS = ("population_definition", "sampling_definition")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def named(value: Label) -> dict:
    return {"type": "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "string", "value": value}


def check_id(code: str, scope: dict) -> str:
    return f"{code}:{hashlib.sha256(canonical(scope).encode()).hexdigest()}"


@dataclass(frozen=True)
class Profile:
    """Facets of one run by (code, canonical scope); an absent facet has no denominator."""

    config: AuditConfig
    facets: dict[tuple[str, str], float]
    outcomes: tuple[Label, ...]
    schema_version: str = "1.0"

    @property
    def digest(self) -> str:
        lines = [canonical([code, scope, value]) for (code, scope), value in sorted(self.facets.items())]
        return hashlib.sha256("\n".join([self.schema_version, *lines]).encode()).hexdigest()


@dataclass(frozen=True)
class Policy:
    group: float
    missing: float
    score: float
    outcome: float
    equal: str = "equal"

    def __post_init__(self) -> None:
        for x in (self.group, self.missing, self.score, self.outcome):
            if isinstance(x, bool) or not 0 <= x < float("inf"):
                raise ValueError("thresholds are finite numbers, not negative")


def _key(v: Label) -> tuple:
    return type(v).__name__, str(v) if not isinstance(v, (int, bool)) else "", v if isinstance(v, (int, bool)) else 0


def profile(flagged: DataFrame, config: AuditConfig) -> Profile:
    """The profile of flagged rows: missing values over all of them, everything else over the eligible ones."""
    at = {(a, v): F.coalesce(typed.is_label(flagged, a, v), F.lit(False)) for a in config.protected for v in config.allowed[a]}
    fields = sorted(config.required)
    missing = {f: typed.missing(flagged, f) for f in fields}
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    ok = ~F.col("__excluded")
    # one pass over the rows for all labels and fields
    sums = [F.count("*").alias("n"), count(ok, "ok")]
    for i, c in enumerate(at.values()):
        sums += [count(c, f"g{i}"), count(c & ok, f"e{i}")] + [count(c & m, f"g{i}m{j}") for j, m in enumerate(missing.values())]
    got = flagged.agg(*sums, *[count(m, f"m{j}") for j, m in enumerate(missing.values())]).first()
    rows = validate.eligible(flagged)
    facets: dict[tuple[str, str], float] = {}
    for i, (a, v) in enumerate(at):
        if got.ok:
            facets["group_proportion_absolute_delta", canonical({"field": a, "group": {a: named(v)}})] = got[f"e{i}"] / got.ok
        for j, f in enumerate(fields):
            if got[f"g{i}"]:
                facets["missingness_rate_absolute_delta", canonical({"field": f, "group": {a: named(v)}})] = got[f"g{i}m{j}"] / got[f"g{i}"]
    for j, f in enumerate(fields):
        if got.n:
            facets["missingness_rate_absolute_delta", canonical({"field": f})] = got[f"m{j}"] / got.n
    quantiles = running.quantiles(rows, [], config.score, list(PROBABILITIES)).first()
    for p, q in zip(PROBABILITIES, quantiles.quantiles if quantiles else ()):
        facets["score_quantile_absolute_delta", canonical({"field": config.score, "quantile_probability": p})] = q
    outcomes = rows.groupBy(F.col(config.outcome).alias("v")).agg(F.count("*").alias("n")).collect()  # labels
    for r in outcomes:
        facets["outcome_proportion_absolute_delta", canonical({"field": config.outcome, "category": named(r.v)})] = r.n / got.ok
    return Profile(config, facets, tuple(sorted((r.v for r in outcomes), key=_key)))


def manifest(config: AuditConfig, outcomes: tuple[Label, ...]) -> list[tuple[str, dict]]:
    """(code, scope) of every check, in canonical order."""
    groups = [(a, v) for a in sorted(config.protected) for v in sorted(config.allowed[a], key=_key)]
    out = [("group_proportion_absolute_delta", {"field": a, "group": {a: named(v)}}) for a, v in groups]
    for f in sorted(config.required):
        out += [("missingness_rate_absolute_delta", {"field": f}), *[("missingness_rate_absolute_delta", {"field": f, "group": {a: named(v)}}) for a, v in groups]]
    out += [("score_quantile_absolute_delta", {"field": config.score, "quantile_probability": p}) for p in PROBABILITIES]
    labels = sorted({_key(v): v for v in outcomes}.values(), key=_key)
    for code in ("outcome_category_presence_equal", "outcome_proportion_absolute_delta"):
        out += [(code, {"field": config.outcome, "category": named(v)}) for v in labels]
    return [*out, ("dataset_version_equal", {}), ("model_version_equal", {})]


def incompatible(current: Profile, base: Profile, digest: str | None) -> str | None:
    """The first reason why two profiles cannot be compared."""
    if {current.schema_version, base.schema_version} != {"1.0"}:
        return "profile_schema_mismatch"
    if digest != base.digest:
        return "baseline_digest_mismatch"
    for names, reason in ((_SEMANTICS, "analysis_semantics_mismatch"), (_GROUPS, "group_definition_mismatch"), (_METHODS, "profile_method_mismatch")):
        if any(getattr(current.config, n) != getattr(base.config, n) for n in names):
            return reason
    return None


def _evaluated(code: str, scope: dict, current: Profile, base: Profile) -> tuple[object, object, str | None]:
    """(current, baseline, reason where there is no such value)."""
    if code in ("dataset_version_equal", "model_version_equal"):
        a, b = (getattr(p.config, code.removesuffix("_equal")) for p in (current, base))
        return (a, b, None) if None not in (a, b) else (None, None, "version_unavailable")
    key = canonical(scope)
    if code == "outcome_category_presence_equal":
        return *(("outcome_proportion_absolute_delta", key) in p.facets for p in (current, base)), None
    a, b = (p.facets.get((code, key)) for p in (current, base))
    if code == "missingness_rate_absolute_delta":
        return (a, b, None) if None not in (a, b) else (None, None, "zero_group_sample")
    return a or 0.0, b or 0.0, None


def compare(current: Profile, base: Profile | None, baseline_id: str, digest: str | None, policy: Policy) -> dict:
    """The comparison: status, checks in canonical order, change flags and issues. ``digest`` is the selected baseline's."""
    reason = "baseline_unavailable" if base is None else incompatible(current, base, digest)
    state = "unavailable" if base is None else "incompatible" if reason else "completed"
    outcomes = current.outcomes + (base.outcomes if base and not reason else ())
    checks, flags, issues = [], [], []
    for code, scope in manifest(current.config, outcomes):
        threshold, statistic, flag = CHECKS[code]
        a, b, why = (None, None, reason) if reason else _evaluated(code, scope, current, base)
        status = state if reason else "not_computable" if why else "evaluated"
        check = {"check_id": check_id(code, scope), "code": code, "scope": canonical(scope), "status": status, "statistic": statistic if status == "evaluated" else None, "threshold": getattr(policy, threshold), "current_value": a, "baseline_value": b, "baseline_id": baseline_id, "reason_code": why}
        checks.append(check)
        if status != "evaluated":
            continue
        if threshold == "equal":
            changed = a != b
            flag = flag or ("outcome_category_added" if a else "outcome_category_removed")
        else:
            changed = abs(a - b) >= getattr(policy, threshold)
        if changed:
            flags.append({"flag_id": f"{flag}:{check['check_id'].rpartition(':')[2]}", "code": flag, "source_check_id": check["check_id"], "statistic": statistic, "threshold": check["threshold"], "current_value": a, "baseline_value": b, "baseline_id": baseline_id})
    if reason:
        issues.append({"code": f"comparison_baseline_{state}", "sources": [c["check_id"] for c in checks]})
    else:
        if missing := [c["check_id"] for c in checks if c["status"] == "not_computable"]:
            issues.append({"code": "comparison_check_not_computable", "sources": missing})
            state = "partially_completed"
        for code in sorted({f["code"] for f in flags}):
            issues.append({"code": code, "sources": [f["flag_id"] for f in flags if f["code"] == code]})
    return {"schema_version": "1.0", "baseline_id": baseline_id, "current_digest": current.digest, "baseline_digest": digest, "status": state, "checks": checks, "flags": flags, "issues": issues}


def attach(result: dict, current: Profile, comparison: dict) -> dict:
    """An audit's record with its comparison, once, and only with the comparison of its own profile."""
    if current.digest != comparison["current_digest"]:
        raise ValueError("the comparison is of another profile")
    if "comparison" in result:
        raise ValueError("a comparison is attached already")
    return result | {"comparison": comparison}
