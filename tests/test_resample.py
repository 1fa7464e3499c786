"""Intervals of a whole audit against plain streams, and limitations by scope."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from paritas.audit import run_audit
from paritas.config import AuditConfig
from paritas.functions import typed
from paritas.operators import bootstrap, metrics, resample


def stream(n, draws, seed, key, role):
    out, c, limit = [], 0, 2**64 - 2**64 % n
    while len(out) < n * draws:
        h = hashlib.sha256(f"{bootstrap.DOMAIN}{seed}\0{key}\0{role}".encode() + c.to_bytes(8, "big")).digest()
        out += [v % n for v in (int.from_bytes(h[i : i + 8], "big") for i in range(0, 32, 8)) if v < limit]
        c += 1
    return [out[k * n : (k + 1) * n] for k in range(draws)]


def ratio(a, b):
    return a / b if b else None


def value(metric, rows):
    w = lambda test: sum(r["w"] for r in rows if test(r))
    both = lambda a, b: ratio(w(lambda r: a(r) and b(r)), w(b))
    y, d, true = (lambda r: r["y"]), (lambda r: r["d"]), (lambda r: True)
    no = lambda f: lambda r: not f(r)
    if metric == "brier_score":
        return sum(r["w"] * (r["s"] - r["y"]) ** 2 for r in rows) / w(true)
    if metric == "roc_auc":
        pos, neg = ([r for r in rows if r["y"] is c] for c in (True, False))
        return ratio(sum(p["w"] * q["w"] * ((p["s"] > q["s"]) + 0.5 * (p["s"] == q["s"])) for p in pos for q in neg), w(y) * w(no(y)))
    return {
        "selection_rate": lambda: both(d, true), "denial_rate": lambda: both(no(d), true), "accuracy": lambda: both(lambda r: r["y"] == r["d"], true), "precision": lambda: both(y, d),
        "true_positive_rate": lambda: both(d, y), "false_positive_rate": lambda: both(d, no(y)), "false_negative_rate": lambda: both(no(d), y),
    }[metric]()


def compared(metric, left, right):
    a, b = ({m: value(m, x) for m in ("selection_rate", "true_positive_rate", "false_positive_rate")} for x in (left, right))
    gap = lambda m: None if a[m] is None or b[m] is None else a[m] - b[m]
    if metric == "adverse_impact_ratio":
        return ratio(a["selection_rate"], b["selection_rate"])
    if metric == "selection_rate_difference":
        return gap("selection_rate")
    if metric == "equal_opportunity_difference":
        return gap("true_positive_rate")
    gaps = [gap("true_positive_rate"), gap("false_positive_rate")]
    return None if None in gaps else max(map(abs, gaps))


def quantile(v, p):
    v, h = sorted(v), (len(v) - 1) * p
    return v[math.floor(h)] + (h - math.floor(h)) * (v[math.ceil(h)] - v[math.floor(h)])


@pytest.mark.parametrize("weighted", [False, True])
def test_every_reliable_metric_has_its_interval(spark, weighted):
    rng = random.Random(5)
    rows = [{"id": f"r{i:03}", "y": rng.random() < 0.5, "d": rng.random() < 0.5, "s": round(rng.random(), 1), "g": rng.choice("AAB"), "w": float(rng.randint(1, 3)) if weighted else 1.0} for i in range(40)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id string, y boolean, d boolean, s double, g string, w double").repartition(3)
    config = AuditConfig(
        outcome="y", score="s", favorable_outcome=True, protected=("g",), reference={"g": "A"}, allowed={"g": ("A", "B", "C")}, decision="d", favorable_decision=True, record_id="id", weight="w" if weighted else None,
        minimum_group_size=1, resamples=7, minimum_valid_resamples=4, confidence_level=0.8, seed=11,
    )
    result = run_audit(df if weighted else df.drop("w"), config, intervals=True)
    checked = set()
    for m in result["metrics"]:
        if m["reliability"] != "reliable" or m["metric"] == "demographic_parity_difference":
            assert "interval_lower" not in m
            continue
        of = lambda g: [r for r in rows if g is None or r["g"] == g]  # noqa: E731, B023
        if "comparison_group" in m:
            left, right = of(m["comparison_group"]["g"]), of(m["reference_group"]["g"])
            pairs = zip(stream(len(left), 7, 11, m["metric_key"], "comparison"), stream(len(right), 7, 11, m["metric_key"], "reference"))
            v = [compared(m["metric"], [left[i] for i in a], [right[i] for i in b]) for a, b in pairs]
        else:
            own = of(m["group"] and m["group"]["g"])
            v = [value(m["metric"], [own[i] for i in a]) for a in stream(len(own), 7, 11, m["metric_key"], "scope")]
        v = [x for x in v if x is not None]
        assert m["valid_resamples"] == len(v)
        assert (m["interval_lower"], m["interval_upper"]) == (pytest.approx(quantile(v, 0.1)), pytest.approx(quantile(v, 0.9)))
        checked.add(m["metric"])
    assert len(checked) == 13
    again = run_audit((df if weighted else df.drop("w")).repartition(5), config, intervals=True)
    assert again == result


def test_comparisons_inherit_limitations(spark):
    rows = [(i, i % 2, (i // 2) % 2, i / 10, "A") for i in range(8)] + [(8, 1, 1, 0.9, "B"), (9, 1, 0, 0.8, "B"), (10, 0, 1, 0.1, "B")]
    df = spark.createDataFrame(rows, "id long, y int, d int, s double, g string")
    config = AuditConfig(outcome="y", score="s", favorable_outcome=1, protected=("g",), reference={"g": "A"}, allowed={"g": ("A", "B", "C")}, decision="d", favorable_decision=1, minimum_group_size=3, resamples=5, minimum_valid_resamples=5, score_type="score")
    result = run_audit(df, config, intervals=True)
    got = {m["metric"]: m for m in result["metrics"] if m.get("comparison_group") == {"g": "B"}}
    assert got["adverse_impact_ratio"]["limitations"] == [] and got["adverse_impact_ratio"]["reliability"] == "reliable"
    assert got["equal_opportunity_difference"]["limitations"] == ["severe_outcome_imbalance"] == got["equalized_odds_gap"]["limitations"]
    undefined = [m for m in result["metrics"] if m.get("comparison_group") == {"g": "C"}]
    assert {m["reliability"] for m in undefined} == {"undefined"} and all(m["limitations"] == [] for m in undefined)
    assert {m["reliability"] for m in result["metrics"] if m["metric"] == "brier_score" and m["sample_count"]} == {"not_applicable"}
    codes = [(x["scope"], x["code"]) for x in result["limitations"]]
    assert ("{'g': 'B'}", "severe_outcome_imbalance") in codes and ("{'g': 'B'}.vs.{'g': 'A'}", "severe_outcome_imbalance") in codes
    keys = next(x["affected_metric_keys"] for x in result["limitations"] if x["scope"] == "{'g': 'B'}.vs.{'g': 'A'}")
    assert keys == [typed.metric_key(m, "g", "B", "A") for m in ("equal_opportunity_difference", "equalized_odds_gap")]


def test_too_few_draws_are_a_limitation(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5, "A"), (2, 0, 0, 0.5, "A"), (3, 1, 0, 0.5, "B"), (4, 0, 1, 0.5, "B")], "id long, y int, d int, s double, g string")
    config = AuditConfig(outcome="y", score="s", favorable_outcome=1, protected=("g",), reference={"g": "A"}, allowed={"g": ("A", "B")}, decision="d", favorable_decision=1, minimum_group_size=1, resamples=20, minimum_valid_resamples=20)
    result = run_audit(df, config, intervals=True)
    failed = [k for x in result["limitations"] if x["code"] == "insufficient_valid_resamples" for k in x["affected_metric_keys"]]
    assert typed.metric_key("precision", "g", "A") in failed and typed.metric_key("selection_rate") not in failed
    assert all(m["reliability"] == "reliable" for m in result["metrics"] if m["metric_key"] in failed)


def test_counts_are_made_once_for_all_metrics(spark):
    assert set(resample.RATES) | set(resample.COMPARED) | {"roc_auc"} == {*metrics.SCOPE_METRICS, *metrics.COMPARISONS}


def test_streams_are_not_broadcast(spark):
    # a stream is unfolded from one row, so its size is taken for that of one row
    rows = spark.range(1000).select("id", F.lit("g").alias("attribute"), F.lit("a").alias("value"))
    placed = bootstrap.with_ordinal(rows, "id", ["attribute", "value"])
    scopes = resample.numbered_scopes(placed)
    streams = resample.numbered_streams(scopes, spark.createDataFrame([("m.a", "scope", "g", "a"), ("m.b", "scope", "g", "b")], "key string, role string, attribute string, value string"))
    met = resample.drawn(placed, scopes, streams, 3, 7, bootstrap.DOMAIN)
    assert met._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") == 1
    assert resample.positions(streams, 3, 7, bootstrap.DOMAIN).rdd.getNumPartitions() >= 4
    got = {}
    for r in met.select("draw", "id").collect():
        got.setdefault(r.draw, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in enumerate(stream(1000, 3, 7, "m.a", "scope"))}
