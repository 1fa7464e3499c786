"""The whole audit: validate, normalize, measure, gate, bootstrap, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.config import AuditConfig
from paritas.functions import typed
from paritas.operators import metrics, resample, validate


#: The column that says why a comparison is undefined; differences of selection rates have their own.
_REASONS = {"adverse_impact_ratio": "air_reason", "equal_opportunity_difference": "opportunity_reason", "equalized_odds_gap": "odds_reason"}


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


#: The order of limitation codes, and the scope metrics whose limitations a comparison inherits.
GATES = ("small_group", "severe_outcome_imbalance", "sparse_decision_support")
_SELECTION, _RATES = ("selection_rate",), ("true_positive_rate", "false_positive_rate")
INHERITED = {"selection_rate_difference": _SELECTION, "adverse_impact_ratio": _SELECTION, "demographic_parity_difference": _SELECTION, "equal_opportunity_difference": _RATES[:1], "equalized_odds_gap": _RATES}
#: A difference of selection rates has one interval, under its first name.
NO_INTERVAL = ("demographic_parity_difference",)


def all_intervals(base: DataFrame, measured: list[dict], config: AuditConfig) -> dict[str, dict]:
    """Intervals of reliable metrics, by key: all of them from one pass over their draws."""
    wanted = []
    for m in measured:
        if m["reliability"] != "reliable" or m["metric"] in NO_INTERVAL:
            continue
        if "comparison_group" in m:
            ((a, v),), ((_, ref),) = m["comparison_group"].items(), m["reference_group"].items()
            wanted += [(m["metric_key"], m["metric"], "comparison", a, _text(v)), (m["metric_key"], m["metric"], "reference", a, _text(ref))]
        else:
            a, v = next(iter(m["group"].items())) if m["group"] else ("__scope__", "overall")
            wanted.append((m["metric_key"], m["metric"], "scope", a, _text(v)))
    if not wanted:
        return {}
    requests = base.sparkSession.createDataFrame(wanted, "key string, metric string, role string, attribute string, value string")
    # without a record id rows go by their values: rows of equal values are alike to a draw
    order = F.col("record_id").cast("string") if config.record_id else F.to_json(F.struct("y", "d", "s", "w"))
    rows = base.select("y", "d", "s", "w", order.alias("__order"), F.explode(metrics.scope_array(config.protected)).alias("scope")).select("y", "d", "s", "w", "__order", "scope.attribute", "scope.value")
    found = resample.intervals(rows, requests, config.resamples, config.seed, config.stream_domain, "__order", config.confidence_level, config.minimum_valid_resamples)
    return {r.key: r.asDict() for r in found.collect()}  # metrics times groups


def _scope_of(m: dict) -> str:
    if "comparison_group" in m:
        return f"{m['comparison_group']}.vs.{m['reference_group']}"
    return str(m["group"] or "overall")


def rollup(measured: list[dict], attempted: dict[str, dict | None]) -> list[dict]:
    """Limitations by scope, in the order of scopes and codes, and then the intervals that had too few draws."""
    by: dict[tuple, list[str]] = {}
    for code in GATES:
        for m in measured:
            if code in m["limitations"]:
                by.setdefault((_scope_of(m), code), []).append(m["metric_key"])
    scopes = list(dict.fromkeys(map(_scope_of, measured)))
    out = [{"code": c, "scope": s, "affected_metric_keys": by[s, c]} for s, c in sorted(by, key=lambda k: (scopes.index(k[0]), GATES.index(k[1])))]
    failed: dict[str, list[str]] = {}
    for m in measured:
        if m["metric_key"] in attempted and attempted[m["metric_key"]] is None:
            failed.setdefault(_scope_of(m), []).append(m["metric_key"])
    return out + [{"code": "insufficient_valid_resamples", "scope": s, "affected_metric_keys": keys} for s, keys in failed.items()]


def run_audit(df: DataFrame, config: AuditConfig, intervals: bool = False) -> dict:
    """One record: validation counts, metrics in canonical order, comparisons, flags.

    Comparisons inherit the limitations of the rates that they compare. ``intervals`` adds bootstrap intervals of
    all reliable metrics, from one pass; their exact draws number rows times resamples for each of them.
    """
    rows, counts = validate.validate(df, config)
    base = validate.normalize(rows, config)
    allowed = {a: [_text(v) for v in config.allowed[a]] for a in config.protected}
    reference = {a: _text(config.reference[a]) for a in config.protected}
    stats = metrics.scope_stats(base, allowed)
    long = metrics.scope_metrics(stats, config.score_type == "probability", metrics.scope_auc(base, list(allowed)))
    gated = metrics.reliability(long, config.minimum_group_size).collect()  # groups times metrics, not rows
    typed_value = {(a, _text(v)): v for a in config.protected for v in config.allowed[a]}
    order = {m: i for i, m in enumerate(metrics.SCOPE_METRICS)}
    out = []
    for r in sorted(gated, key=lambda r: (r.attribute != "__scope__", r.attribute, r.value, order[r.metric])):
        overall = r.attribute == "__scope__"
        key = typed.metric_key(r.metric) if overall else typed.metric_key(r.metric, r.attribute, typed_value[r.attribute, r.value])
        out.append({"metric_key": key, "metric": r.metric, "value": r.metric_value, "undefined_reason": r.reason, "reliability": r.reliability, "limitations": list(r.limitations), "sample_count": r.n, "group": None if overall else {r.attribute: typed_value[r.attribute, r.value]}})
    known = {m["metric_key"]: m for m in out}
    compared = metrics.compare(stats, reference)
    for r in compared.orderBy("attribute", "value").collect():
        for m in metrics.COMPARISONS:
            value, reason = r["selection_rate_difference"] if m == "demographic_parity_difference" else r[m], r[_REASONS.get(m, "difference_reason")]
            mine, other = typed_value[r.attribute, r.value], config.reference[r.attribute]
            of = [known[typed.metric_key(source, r.attribute, v)]["limitations"] for source in INHERITED[m] for v in (mine, other)]
            codes = [] if reason else [c for c in GATES if any(c in x for x in of)]
            key = typed.metric_key(m, r.attribute, mine, other)
            out.append({"metric_key": key, "metric": m, "value": value, "undefined_reason": reason, "reliability": "undefined" if reason else "unreliable" if codes else "reliable", "limitations": codes, "sample_count": r.sample_count, "comparison_group": {r.attribute: mine}, "reference_group": {r.attribute: other}})
    attempted: dict[str, dict | None] = {}
    if intervals:
        found = all_intervals(base, out, config)
        for m in out:
            if m["reliability"] == "reliable" and m["metric"] not in NO_INTERVAL:
                i = found.get(m["metric_key"])
                attempted[m["metric_key"]] = i if i and i["lower"] is not None else None
                if attempted[m["metric_key"]]:
                    m |= {"interval_lower": i["lower"], "interval_upper": i["upper"], "confidence_level": config.confidence_level, "valid_resamples": i["valid"]}
    flags = [r.asDict() for r in metrics.air_flags(compared, config.air_threshold, config.minimum_group_size).orderBy("attribute", "value").collect()]
    return {"schema_version": "2.0", "validation": counts, "metrics": out, "flags": flags, "limitations": rollup(out, attempted)}
