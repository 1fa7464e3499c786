"""Class-stratified draws of risk diagnostics against plain Python, with calibration slopes."""

import hashlib
import math
import random

import pytest

from paritas.operators import bootstrap, risk_bootstrap

EDGES, FRACTIONS = [0.3, 0.6], [0.25, 0.5]


def stream(n, draws, role):
    out, c = [], 0
    while len(out) < n * draws:
        h = hashlib.sha256(f"{bootstrap.DOMAIN}3\0{risk_bootstrap.KEY}\0{role}".encode() + c.to_bytes(8, "big")).digest()
        out += [int.from_bytes(h[i : i + 8], "big") % n for i in range(0, 32, 8)]
        c += 1
    return [out[k * n : (k + 1) * n] for k in range(draws)]


def slope(rows):
    x = [math.log(min(max(s, 1e-6), 1 - 1e-6) / (1 - min(max(s, 1e-6), 1 - 1e-6))) for s, _, _ in rows]
    good, bad = ([v for v, r in zip(x, rows) if r[1] is c] for c in (False, True))
    if max(x) == min(x) or max(good) < min(bad) or max(bad) < min(good):
        return None
    a = b = 0.0
    for _ in range(100):
        p = [1 / (1 + math.exp(-max(min(a + b * v, 700), -700))) for v in x]
        h = [sum(r[2] * q * (1 - q) * v**k for v, q, r in zip(x, p, rows)) for k in range(3)]
        g = [sum(r[2] * (r[1] - q) * v**k for v, q, r in zip(x, p, rows)) for k in range(2)]
        det = h[0] * h[2] - h[1] ** 2
        if det <= 1e-18:
            return None
        da, db = (g[0] * h[2] - g[1] * h[1]) / det, (g[1] * h[0] - g[0] * h[1]) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) <= 1e-10:
            return b
        if max(abs(a), abs(b)) > 1e6:
            return None
    return None


def diagnostics(rows):
    tb, tg = (sum(w for _, bad, w in rows if bad is c) for c in (True, False))
    scores = sorted({r[0] for r in rows}, reverse=True)
    out = {"ks": max(abs(sum(w for s, b, w in rows if b and s >= t) / tb - sum(w for s, b, w in rows if not b and s >= t) / tg) for t in scores)}
    out["risk_auc"] = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, b, w in rows if b for t, c, v in rows if not c) / (tb * tg)
    out["gini"] = 2 * out["risk_auc"] - 1
    out["brier_score"] = sum(w * (s - b) ** 2 for s, b, w in rows) / (tb + tg)
    out["calibration_in_the_large"] = sum(w * s for s, _, w in rows) / (tb + tg) - tb / (tb + tg)
    out["calibration_slope"] = slope(rows)
    for i in range(len(EDGES) + 1):
        own = [r for r in rows if sum(r[0] >= e for e in EDGES) == i]
        out[f"band.{i}.observed_bad_rate"] = sum(w for _, b, w in own if b) / sum(w for *_, w in own) if own else None
    for f in FRACTIONS:
        taken, cum = [], 0.0
        for t in scores:
            taken += [r for r in rows if r[0] == t]
            cum = sum(r[2] for r in taken)
            if cum >= f * (tb + tg):
                break
        b = sum(w for _, x, w in taken if x)
        out |= {f"top.{f:g}.bad_capture": b / tb, f"top.{f:g}.selected_bad_rate": b / cum, f"top.{f:g}.lift": b / cum / (tb / (tb + tg))}
    return out


def quantile(v, p):
    v, h = sorted(v), (len(v) - 1) * p
    return v[math.floor(h)] + (h - math.floor(h)) * (v[math.ceil(h)] - v[math.floor(h)])


@pytest.mark.parametrize("few", [10**6, 0])
def test_all_diagnostics_of_all_draws(spark, few):
    rng = random.Random(1)
    rows = [(f"e{i:02}", s, rng.random() < 0.2 + 0.6 * s, float(rng.choice([0, 1, 2, 4]))) for i in range(30) for s in [round(rng.random(), 1)]]
    df = spark.createDataFrame(rows, "entity_id string, s double, bad boolean, w double").repartition(3)
    most = max(r[3] for r in rows)
    bad, good = ([(s, b, w / most) for _, s, b, w in sorted(rows) if w > 0 and b is c] for c in (True, False))
    values = {}
    for a, b in zip(stream(len(bad), 9, "comparison"), stream(len(good), 9, "reference")):
        for k, v in diagnostics([bad[i] for i in a] + [good[i] for i in b]).items():
            values.setdefault(k, []).append(v)
    found = risk_bootstrap.evidence(df, EDGES, FRACTIONS, 9, 8, 3, few=few)
    got = {r.metric_key: r for r in found.collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        v = [x for x in v if x is not None]
        assert (got[k].valid_resamples, got[k].reliable) == (len(v), len(v) >= 8), k
        if len(v) >= 8:
            assert (got[k].lower, got[k].upper) == (pytest.approx(quantile(v, 0.025), abs=1e-9), pytest.approx(quantile(v, 0.975), abs=1e-9)), k
    r = risk_bootstrap.reliable(df, found, 10, 3, 3, 9).first()
    assert (r.entities, r.bad, r.good, r.valid_resamples, r.reliable) == (len(bad) + len(good), len(bad), len(good), 9, True)
    assert not risk_bootstrap.reliable(df, found, 10, 3, len(good) + 1, 9).first().reliable


def test_one_class_has_no_evidence(spark):
    df = spark.createDataFrame([("a", 0.1, True, 1.0), ("b", 0.2, True, 0.0)], "entity_id string, s double, bad boolean, w double")
    found = risk_bootstrap.evidence(df, EDGES, FRACTIONS, 5, 3, 3)
    assert found.count() == 0
    r = risk_bootstrap.reliable(df, found, 1, 1, 0, 0).first()
    assert (r.entities, r.bad, r.good, r.valid_resamples) == (1, 1, 0, 0)
