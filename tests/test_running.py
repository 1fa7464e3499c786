"""Running sums, exact sums and quantiles against plain Python, by one window and by ranges."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from paritas.functions import exact, ranked, running
from paritas.operators import bootstrap, profile


@pytest.mark.parametrize("few", [10**6, 0])
def test_running_sums(spark, few):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(-5, 5)) for i in range(500)] + [("hot", i, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(7)
    got = running.running(df, ["k"], [F.desc("i")], {"before": F.col("x"), "place": F.lit(1)}, {"all": F.col("x")}, few)
    want = {}
    for k in {r[0] for r in rows}:
        mine, at = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]), 0
        for n, r in enumerate(mine):
            want[k, r[1]] = (at, n, sum(x[2] for x in mine))
            at += r[2]
    assert {(r.k, r.i): (r.before, r.place, r["all"]) for r in got.collect()} == want


def test_no_window_takes_all_rows_of_a_key(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id"))
    plan = running.running(df, ["k"], [F.asc("id")], {"before": F.lit(1)}, few=0)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "__part" not in x.rpartition("[k")[2]]
    assert not windows


@pytest.mark.parametrize("few", [10**6, 0])
def test_quantiles_are_type_7(spark, few):
    rng = random.Random(2)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400)) for v in (round(rng.gauss(0, 5), rng.choice([0, 6])) for _ in range(n))] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.975, 1.0]
    got = {r.k: r.quantiles for r in running.quantiles(df, ["k"], "v", ps, few).collect()}
    for k in "abcd":
        v = sorted(x for i, x in rows if i == k and x is not None)
        for p, q in zip(ps, got[k]):
            h = (len(v) - 1) * p
            assert q == v[math.floor(h)] + (h - math.floor(h)) * (v[math.ceil(h)] - v[math.floor(h)])
    assert set(got) == set("abcd")


@pytest.mark.parametrize("parts", [1, 4])
def test_sums_are_exact(spark, parts):
    rng = random.Random(3)
    frames = {
        "cancel": [1e16, 1.0, -1e16, -0.0, 3.0],
        "tiny": [5e-324, 5e-324, 1e-310, -1e-320, 2.0**-1022],
        "huge": [1.7e308, 1.7e308, -1.7e308, 1e300, 2.0**1000],
        "wide": [rng.choice([1, -1]) * math.ldexp(rng.random(), rng.randint(-1060, 1000)) for _ in range(400)],
        "powers": [2.0**k * (1 + e) for k in range(-60, 60) for e in (0, 2.0**-52, -(2.0**-53))],
        "tenths": [0.1] * 1000 + [-0.3] * 333,
        "zero": [0.0, -0.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in frames.items() for v in vs] + [("cancel", None), ("inf", float("inf")), ("inf", 1.0)], "k string, v double").repartition(parts)
    got = {r.k: (r.n, r["sum"]) for r in exact.sums(df, ["k"], "v").collect()}
    for k, vs in frames.items():
        assert got[k] == (len(vs), float(sum(map(Fraction, vs)))), k
    assert got["inf"] == (2, float("inf"))
    m = {r.k: r for r in exact.moments(df, ["k"], "v").collect()}["cancel"]
    assert m.mean == 0.8 and m.deviation == math.sqrt(math.fsum((x - 0.8) ** 2 for x in frames["cancel"]) / 5)


def test_distribution_of_a_cancelling_column(spark):
    d = profile.distribution(spark.createDataFrame([(x,) for x in [1e16, 1.0, -1e16, -0.0, 3.0]], "v double"), "v").first()
    assert (d.minimum, d.maximum, d.mean, list(d.quantiles)) == (-1e16, 1e16, 0.8, [-1e16, 0.0, 1.0, 3.0, 1e16])
    none = profile.distribution(spark.createDataFrame([], "v double"), "v").collect()
    assert all(r.mean is None for r in none)


@pytest.mark.parametrize("few", [10**6, 0])
def test_rank_statistics(spark, few):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), round(rng.random(), 2), rng.random() < 0.3, float(rng.randint(1, 4))) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, s double, bad boolean, w double").repartition(5)
    got = {r.k: r.auc for r in ranked.auc(df, ["k"], "s", "bad", "w", few).collect()}
    for k in "ab":
        pos, neg = ([(s, w) for i, s, b, w in rows if i == k and b is c] for c in (True, False))
        want = sum(w * v * (1.0 if s > t else 0.5 * (s == t)) for s, w in pos for t, v in neg) / (sum(w for _, w in pos) * sum(w for _, w in neg))
        assert got[k] == pytest.approx(want, rel=1e-12)
    tb, tg = (sum(r[3] for r in rows if r[2] is c) for c in (True, False))
    gaps = {t: abs(sum(w for _, s, b, w in rows if b and s >= t) / tb - sum(w for _, s, b, w in rows if not b and s >= t) / tg) for t in {r[1] for r in rows}}
    k = ranked.ks(df, "s", "bad", "w", few).first()
    assert k.ks == pytest.approx(max(gaps.values())) and k.ks_score in k.ks_scores and gaps[k.ks_score] == pytest.approx(k.ks)
    for r in ranked.lift(df, "s", "bad", "w", [0.1, 0.5, 1.0], few).collect():
        taken, total = 0.0, sum(x[3] for x in rows)
        bad = n = 0
        for t in sorted(gaps, reverse=True):
            if taken >= r.fraction * total:
                break
            run = [x for x in rows if x[1] == t]
            taken, n, bad = taken + sum(x[3] for x in run), n + len(run), bad + sum(x[3] for x in run if x[2])
        assert (r.selected, r.capture) == (n, pytest.approx(bad / tb))


@pytest.mark.parametrize("few", [10**6, 0])
def test_positions_by_scope(spark, few):
    df = spark.createDataFrame([("a", f"r{i:03}") for i in range(50)] + [("b", f"r{i:03}") for i in range(30)], "k string, id string").repartition(4)
    got = bootstrap.with_ordinal(df, "id", ["k"], few).collect()
    assert {(r.k, r.id, r["index"]) for r in got} == {(k, f"r{i:03}", i) for k, n in (("a", 50), ("b", 30)) for i in range(n)}
