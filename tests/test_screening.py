"""Screening models against one fit of all rows in numpy."""

import numpy as np
import pandas as pd
import pytest

from paritas.operators import screening

RNG = np.random.default_rng(5)
N, FOLDS = 240, 3


def table():
    y = RNG.integers(0, 3, N)
    c = y + RNG.normal(0, 1.2, N)
    c[RNG.random(N) < 0.1] = np.nan
    b1 = np.where(RNG.random(N) < 0.7, np.array(["x", "y", "z"])[y], "x").astype(object)
    b1[::40], b1[1:4], b1[7] = None, "rare", "once"
    fold = np.where(np.arange(N) % 5 == 0, -1, np.arange(N) % FOLDS)
    return pd.DataFrame({"entity_id": [f"e{i:03}" for i in range(N)], "window": np.where(fold < 0, "holdout", "development"), "fold": fold, "label": np.array(["k0", "k1", "k2"])[y], "c": c, "b0": RNG.normal(0, 1, N), "b1": b1})


def plain(train, score, columns):
    """Encode by the training rows, fit by gradient steps with an exact Hessian until nothing moves, score."""
    def encode(rows):
        out = [np.ones(len(rows))]
        for c in columns:
            if c == "b1":
                own = train[c].map(lambda v: "!missing" if v is None else f"={v}").value_counts()
                kept, rare = {k for k, n in own.items() if n >= 5}, {k for k, n in own.items() if n < 5}
                names = sorted(kept | {"!missing", "!unseen"} | ({"!rare"} if rare else set()))
                t = rows[c].map(lambda v: "!missing" if v is None else f"={v}").map(lambda v: "!rare" if v in rare else v if v in names else "!unseen")
                out += [(t == n).to_numpy(float) for n in names]
            else:
                middle = float(np.nanmedian(train[c]))
                filled = train[c].fillna(middle)
                mean, std = filled.mean(), filled.std(ddof=0)
                out += [((rows[c].fillna(middle) - mean) / std).to_numpy(), rows[c].isna().to_numpy(float)]
        return np.stack(out, 1)

    x, y = encode(train), train["label"].str[1].astype(int).to_numpy()
    beta = np.zeros((2, x.shape[1]))
    ridge = np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(60):
        p = screening.probabilities(x, beta)[:, 1:]
        g = (p - np.eye(3)[y][:, 1:]).T @ x / len(x) + ridge * beta
        h = np.block([[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x / len(x) for j in range(2)] for i in range(2)]) + np.diag(np.tile(ridge, 2))
        beta = beta - np.linalg.solve(h, g.ravel()).reshape(beta.shape)
    assert np.abs(g).max() < 1e-9
    return screening.probabilities(encode(score), beta)


def auc(y, p):
    each = []
    for k in range(3):
        pos, neg = p[y == k, k], p[y != k, k]
        each.append(((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean())
    return float(np.mean(each))


@pytest.mark.parametrize("few", [10**6, 0])
def test_all_models_of_all_sets(spark, few):
    t = table()
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in t.assign(fold=t["fold"].astype(object).where(t["fold"] >= 0, None)).itertuples(index=False)]
    df = spark.createDataFrame(rows, "entity_id string, window string, fold int, label string, c double, b0 double, b1 string").repartition(4)
    sets = {"null": [], "candidate": ["c"], "baseline": ["b0", "b1"], "augmented": ["b0", "b1", "c"]}
    got = screening.scores(df, "label", sets, {"b1"}, FOLDS, few=few).toPandas()
    dev = t[t["fold"] >= 0]
    want = {}
    for name, columns in sets.items():
        parts = [(dev[dev["fold"] != f], dev[dev["fold"] == f]) for f in range(FOLDS)] + [(dev, t[t["fold"] < 0])]
        for train, score in parts:
            for e, p in zip(score["entity_id"], plain(train, score, columns)):
                want[name, e] = p
    assert len(got) == len(want) == 4 * N
    for r in got.itertuples():
        assert np.allclose(r.probabilities, want[r.set, r.entity_id], atol=1e-7), (r.set, r.entity_id)
    found = {(r["set"], r.window): r for r in screening.screen(df, "label", ["c"], ["b0", "b1"], {"b1"}, FOLDS).collect()}
    for name in sets:
        for window in ("development", "holdout"):
            own = t[t["window"] == window]
            p = np.array([want[name, e] for e in own["entity_id"]])
            r = found[name, window]
            assert r.entities == len(own)
            if name != "null":
                assert r.macro_auc == pytest.approx(auc(own["label"].str[1].astype(int).to_numpy(), p), abs=0.02 if name == "null" else 1e-6)
    assert found["augmented", "holdout"].increment == pytest.approx(found["augmented", "holdout"].macro_auc - found["baseline", "holdout"].macro_auc)
    assert found["null", "holdout"].macro_auc == 0.5 and found["candidate", "holdout"].increment is None


def test_screenings_that_are_not_available(spark):
    rows = [(f"e{i}", "development", i % 2, "ab"[i // 2 % 2], float(i), f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, window string, fold int, label string, c double, g string")
    with pytest.raises(screening.ScreeningError, match="ad_insufficient_fold_support"):
        screening.scores(df.filter("label = 'a'"), "label", {"x": ["c"]}, set(), 2)
    with pytest.raises(screening.ScreeningError, match="ad_insufficient_fold_support"):
        screening.scores(df, "label", {"x": ["c"]}, set(), 2, per_fold=11)
    with pytest.raises(screening.ScreeningError, match="ad_high_cardinality_unsupported"):
        screening.scores(df, "label", {"x": ["g"]}, {"g"}, 2, minimum_level=1, maximum_levels=10)
    with pytest.raises(screening.ScreeningError, match="ad_proxy_statistic_undefined"):
        screening.scores(df.selectExpr("entity_id", "window", "fold", "label", "CAST(NULL AS DOUBLE) AS c"), "label", {"x": ["c"]}, set(), 2)


def test_equal_rows_are_one_cell_with_a_count(spark):
    rows = [(f"e{i}", "development", i % 2, i % 3, [1.0, None][i % 2], "uv"[i % 4 // 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "entity_id string, window string, fold int, y int, c double, g string")
    found = {}
    for r in screening.cells(df, {"null": [], "c": ["c"], "both": ["c", "g"]}).collect():
        found.setdefault(r["set"], []).append(r.n)
    assert {k: (len(v), sum(v)) for k, v in found.items()} == {"null": (6, 120), "c": (6, 120), "both": (12, 120)}
