"""Proxy screening: how well features predict a protected label, out of fold and on a holdout.

Multinomial logistic models of several feature sets and folds are fitted together by damped Newton steps. A step is one
pass over the cells, equal rows with their number: each task sums every model's loss, gradient and Hessian over its own
cells, and the sums of tasks are added by (model, place). Only these sums (classes times features squared, for each model) reach the driver, never rows.
Encoders are learned from a model's training rows alone: medians of runs of values, moments of imputed values,
levels by count. The first label is the base class; all coefficients but intercepts carry an L2 penalty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions import ranked, running

MISSING, RARE, UNSEEN = "!missing", "!rare", "!unseen"
ITERATIONS, HALVINGS, TOLERANCE = 100, 61, 1e-10
RARE_LEVELS = 100_000  # levels of all models and columns that are told apart


class ScreeningError(ValueError):
    """The code of a screening that is not available."""


def training_runs(df: DataFrame, columns: list[str], folds: int) -> DataFrame:
    """(model, column, value, n) of development rows: model m is trained without fold m, model ``folds`` with all."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    by_fold = df.filter(F.col("fold").isNotNull()).select("fold", F.explode(cells).alias("x")).groupBy("fold", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    models = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))
    return running.checkpointed(by_fold.withColumn("model", F.explode(models)).groupBy("model", "column", "value").agg(F.sum("n").alias("n")))


def encoders(df: DataFrame, columns: list[str], categorical: set[str], folds: int, minimum: int, maximum: int, few: int | None = None) -> dict[int, dict[str, tuple]]:
    """By model and column: (median, mean, deviation) of a number, or (levels, rare levels) of a category."""
    runs = training_runs(df, columns, folds)
    key = ["model", "column"]
    out: dict[int, dict[str, tuple]] = {m: {} for m in range(folds + 1)}
    numbers = runs.filter(~F.col("column").isin(list(categorical))) if categorical else runs
    x = F.expr("try_cast(value AS DOUBLE)")
    numbers = numbers.select(*key, F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x).alias("__v"), F.col("n").alias("__n")).groupBy(*key, "__v").agg(F.sum("__n").alias("__n"))
    middle = running.quantiles_of_runs(numbers.filter("__v IS NOT NULL"), key, [0.5], few).select(*key, F.col("quantiles")[0].alias("median"))
    full = numbers.join(F.broadcast(middle), key, "left").withColumn("v", F.coalesce("__v", "median"))  # a row a model and column
    mean = full.groupBy(*key, "median").agg(F.sum("__n").alias("n"), (F.sum(F.col("v") * F.col("__n")) / F.sum("__n")).alias("mean"))
    spread = full.join(F.broadcast(mean.select(*key, "mean")), key).groupBy(*key).agg(F.sum((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")) * F.col("__n")).alias("ss"))
    for r in mean.join(spread, key).collect():
        if r.median is None:
            raise ScreeningError("ad_proxy_statistic_undefined")
        out[r.model][r.column] = (r.median, r.mean, float(np.sqrt(max(0.0, r.ss / r.n))))
    if categorical:
        level = F.when(F.col("value").isNull(), F.lit(MISSING)).otherwise(F.concat(F.lit("="), "value"))
        levels = runs.filter(F.col("column").isin(list(categorical))).select(*key, level.alias("level"), F.col("n") >= minimum, "n").toDF(*key, "level", "kept", "n")
        many = levels.groupBy(*key).agg(F.sum(F.col("kept").cast("long")).alias("k")).filter(F.col("k") > maximum)
        if not many.isEmpty():
            raise ScreeningError("ad_high_cardinality_unsupported")
        # rare levels are told from those that training has not: their number is bounded, as that of retained ones is
        if levels.limit(RARE_LEVELS + 1).count() > RARE_LEVELS:
            raise ScreeningError("ad_high_cardinality_unsupported")
        kept: dict[tuple, set] = {}
        rare: dict[tuple, set] = {}
        for r in levels.collect():
            (kept if r.kept else rare).setdefault((r.model, r.column), set()).add(r.level)
        for m in out:
            for c in categorical & set(columns):
                few_ = rare.get((m, c), set())
                vocabulary = sorted(kept.get((m, c), set()) | {MISSING, UNSEEN} | ({RARE} if few_ else set()))
                if len(vocabulary) > maximum:
                    raise ScreeningError("ad_high_cardinality_unsupported")
                out[m][c] = (vocabulary, few_)
    return out


def vectors(batch: pd.DataFrame, columns: list[str], encoder: dict[str, tuple]) -> np.ndarray:
    """Rows as numbers: 1, then value and missingness of each number, and a place for each level of a category."""
    out = [np.ones((len(batch), 1))]
    for c in columns:
        if len(encoder[c]) == 3:
            median, mean, std = encoder[c]
            x = pd.to_numeric(batch[c], errors="coerce").to_numpy(float, copy=True)
            gone = ~np.isfinite(x)
            x[gone] = median
            out.append(np.stack([np.zeros(len(x)) if std == 0 else (x - mean) / std, gone.astype(float)], 1))
        else:
            vocabulary, rare = encoder[c]
            place = {v: i for i, v in enumerate(vocabulary)}
            codes, values = pd.factorize(batch[c])
            own = [place[RARE if t in rare else t if t in place else UNSEEN] for t in (f"={v}" for v in values)]
            hot = np.zeros((len(batch), len(vocabulary)))
            hot[np.arange(len(batch)), np.array([*own, place[MISSING]])[codes]] = 1  # a missing value's code is -1
            out.append(hot)
    return np.concatenate(out, 1)


def probabilities(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    z = np.concatenate([np.zeros((len(x), 1)), x @ beta.T], 1)
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cells(rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(set, fold, window, y, features, n): rows that are equal in a set's features are one with a count; other features are null."""
    columns, kinds = sorted({c for s in sets.values() for c in s}), dict(rows.dtypes)
    every = running.checkpointed(rows.groupBy("fold", "window", "y", *columns).agg(F.count(F.lit(1)).alias("n")))
    out = None
    for name, own in sets.items():
        part = every if set(own) == set(columns) else every.groupBy("fold", "window", "y", *own).agg(F.sum("n").alias("n"))
        part = part.select(F.lit(name).alias("set"), "fold", "window", "y", *[F.col(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in columns], "n")
        out = part if out is None else out.unionByName(part)
    return running.checkpointed(out)


def _sums(rows: DataFrame, models: dict[tuple, list[np.ndarray]], sets: dict[str, list[str]], learned: dict, classes: int, slopes: bool) -> dict[tuple, np.ndarray]:
    """Of each model (set, fold left out): rows and its loss at each of its points, and with ``slopes`` gradient and Hessian at its one point; over all cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for name, b in whole.groupby("set", sort=False):
                fold, y, n = b["fold"].to_numpy(int), b["y"].to_numpy(int), b["n"].to_numpy(float)
                for key, points in models.items():
                    mine = fold != key[1]
                    if key[0] != name or not mine.any():
                        continue
                    x, own, w = vectors(b[mine], sets[name], learned[key[1]]), y[mine], n[mine]
                    every = [probabilities(x, q) for q in points]
                    new = [[w.sum()], [-(w * np.log(np.maximum(p[np.arange(len(x)), own], 1e-300))).sum() for p in every]]
                    if slopes:
                        p, d = every[0][:, 1:], x.shape[1]
                        u = (p[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                        h = -(u * w[:, None]).T @ u
                        for i in range(classes - 1):
                            h[i * d : (i + 1) * d, i * d : (i + 1) * d] += (x * (w * p[:, i])[:, None]).T @ x
                        new += [((p - np.eye(classes)[own][:, 1:]) * w[:, None]).T.dot(x).ravel(), h.ravel()]
                    new = np.concatenate(new)
                    total[key] = total[key] + new if key in total else new
        for (name, m), v in total.items():
            yield pd.DataFrame({"set": name, "model": m, "i": np.arange(len(v)), "v": v})

    found: dict[tuple, np.ndarray] = {}
    for r in rows.mapInPandas(run, "set string, model int, i int, v double").groupBy("set", "model", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault((r["set"], r["model"]), {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in found.items()}


def fit(rows: DataFrame, sets: dict[str, list[str]], learned: dict, folds: int, classes: int) -> dict[tuple, np.ndarray]:
    """Coefficients (classes less one, features) of every feature set and fold left out (``folds``: none)."""
    one = {m: {c: (len(e[0]) if len(e) == 2 else 2) for c, e in learned[m].items()} for m in learned}
    beta = {(name, m): np.zeros((classes - 1, 1 + sum(one[m][c] for c in columns))) for name, columns in sets.items() for m in range(folds + 1)}
    open_, change = set(beta), dict.fromkeys(beta, np.inf)
    penalty = lambda b: 0.5 * float((b[:, 1:] ** 2).sum())
    sums = _sums(rows, {k: [b] for k, b in beta.items()}, sets, learned, classes, True)
    for _ in range(ITERATIONS):
        left = {}
        for k in sorted(open_):
            n, size = sums[k][0], beta[k].size
            ridge = np.tile(np.r_[0.0, np.ones(beta[k].shape[1] - 1)], classes - 1)
            g = sums[k][2 : 2 + size] / n + ridge * beta[k].ravel()
            if np.abs(g).max() <= TOLERANCE and change[k] <= TOLERANCE:
                open_.discard(k)
                continue
            try:
                lower = np.linalg.cholesky(sums[k][2 + size :].reshape(size, size) / n + np.diag(ridge))
            except np.linalg.LinAlgError:
                raise ScreeningError("ad_proxy_model_nonconvergence") from None
            left[k] = (np.linalg.solve(lower.T, np.linalg.solve(lower, g)).reshape(beta[k].shape), np.abs(g).max())
        now, tried, moved = {k: sums[k][1] / sums[k][0] + penalty(beta[k]) for k in left}, 0, set()
        while left:  # whole steps with what the next step needs; then four shorter ones of all models in a pass
            if tried >= HALVINGS:
                raise ScreeningError("ad_proxy_model_nonconvergence")
            points = {k: [beta[k] - 0.5 ** (tried + j) * s for j in range(4 if tried else 1)] for k, (s, _) in left.items()}
            found = _sums(rows, points, sets, learned, classes, not tried)
            for k, q in points.items():
                good = next((b for b, v in zip(q, found[k][1:] / found[k][0]) if v + penalty(b) <= now[k] + 1e-15), None)
                if good is not None:
                    change[k] = float(np.abs(good - beta[k]).max())
                    beta[k] = good
                    if left.pop(k)[1] <= TOLERANCE and change[k] <= TOLERANCE:
                        open_.discard(k)
                    elif tried:
                        moved.add(k)
                    else:
                        sums[k] = found[k]
            tried += 4 if tried else 1
        if not open_:
            return beta
        if moved:
            sums |= _sums(rows, {k: [beta[k]] for k in moved}, sets, learned, classes, True)
    raise ScreeningError("ad_proxy_model_nonconvergence")


def _fitted(df: DataFrame, label: str, sets: dict[str, list[str]], categorical: set[str], folds: int, minimum_level: int = 5, maximum_levels: int = 50, per_fold: int = 2, few: int | None = None) -> tuple[DataFrame, DataFrame, dict, dict]:
    """Stored rows with a label, their cells, the encoders and the coefficients."""
    columns = sorted({c for s in sets.values() for c in s})
    kept = [F.col(c).cast("string" if c in categorical else "double").alias(c) for c in columns]
    rows = running.checkpointed(df.filter(F.col(label).isNotNull()).select("entity_id", "window", F.col("fold").cast("int").alias("fold"), F.col(label).cast("string").alias("__label"), *kept))
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", "__label").count().collect()}  # folds times classes
    labels = sorted({c for _, c in counts})
    if len(labels) < 2 or any(counts.get((f, c), 0) < per_fold for f in range(folds) for c in labels):
        raise ScreeningError("ad_insufficient_fold_support")
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(labels) for x in (c, i)]), F.col("__label")).alias("y")
    rows = rows.select("entity_id", "window", "fold", place, *columns)
    learned = encoders(rows, columns, categorical, folds, minimum_level, maximum_levels, few) if columns else {m: {} for m in range(folds + 1)}
    met = cells(rows, sets)
    return rows, met, learned, fit(met.filter("fold IS NOT NULL").drop("window"), sets, learned, folds, len(labels))


def scores(df: DataFrame, label: str, sets: dict[str, list[str]], categorical: set[str], folds: int, **kw) -> DataFrame:
    """(entity_id, window, set, y, probabilities): development rows by the model without their fold, the holdout by that of all.

    ``df`` has entity_id, window, fold (null: holdout), the label and the features. Rows without a label take no part.
    """
    rows, _, learned, beta = _fitted(df, label, sets, categorical, folds, **kw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            model = b["fold"].fillna(folds).astype(int)
            for m in sorted(model.unique()):
                part = b[model == m]
                for name, own in sets.items():
                    p = probabilities(vectors(part, own, learned[m]), beta[name, m])
                    yield pd.DataFrame({"entity_id": part["entity_id"].to_numpy(), "window": part["window"].to_numpy(), "set": name, "y": part["y"].to_numpy(), "probabilities": list(p)})

    kind = dict(df.dtypes)["entity_id"]
    return rows.mapInPandas(run, f"entity_id {kind}, window string, set string, y int, probabilities array<double>")


def scored_cells(df: DataFrame, label: str, sets: dict[str, list[str]], categorical: set[str], folds: int, **kw) -> DataFrame:
    """(set, window, y, probabilities, n): the same of equal rows at once, with their number."""
    _, met, learned, beta = _fitted(df, label, sets, categorical, folds, **kw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            model = b["fold"].fillna(folds).astype(int)
            for (name, m), part in b.groupby([b["set"], model], sort=False):
                p = probabilities(vectors(part, sets[name], learned[m]), beta[name, m])
                yield pd.DataFrame({"set": name, "window": part["window"].to_numpy(), "y": part["y"].to_numpy(), "probabilities": list(p), "n": part["n"].to_numpy()})

    return met.mapInPandas(run, "set string, window string, y int, probabilities array<double>, n long")


def macro_auc(scored: DataFrame, few: int | None = None) -> DataFrame:
    """(set, window, entities, macro_auc): the mean of the classes' areas, null where a class has none; ``n``: rows that are equal, if there."""
    n = F.col("n").cast("double") if "n" in scored.columns else F.lit(1.0)
    scored = scored.withColumn("__n", n)
    long = scored.select("set", "window", "y", "__n", F.posexplode("probabilities").alias("class", "s")).withColumn("hit", F.col("y") == F.col("class"))
    areas = ranked.auc(long, ["set", "window", "class"], "s", "hit", "__n", few)
    one = areas.groupBy("set", "window").agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("macro_auc"))
    return one.join(scored.groupBy("set", "window").agg(F.sum("__n").cast("long").alias("entities")), ["set", "window"])


def screen(df: DataFrame, label: str, candidate: list[str], others: list[str], categorical: set[str], folds: int, **kw) -> DataFrame:
    """(set, window, entities, macro_auc, increment): no feature, the candidate, the others, and both; the increment is that of the candidate over the others.

    All sets score the same entities, so the increment is paired.
    """
    sets = {"null": [], "candidate": candidate, "baseline": others, "augmented": [*others, *candidate]}
    found = running.checkpointed(macro_auc(running.checkpointed(scored_cells(df, label, sets, categorical, folds, **kw))))
    base = found.filter("set = 'baseline'").select("window", F.col("macro_auc").alias("__base"))
    return found.join(F.broadcast(base), "window", "left").withColumn("increment", F.when(F.col("set") == "augmented", F.col("macro_auc") - F.col("__base"))).select("set", "window", "entities", "macro_auc", "increment")


# executors need no copy of the package: its functions are sent with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
