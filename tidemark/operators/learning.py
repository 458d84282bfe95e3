"""Classifiers of rate directions with time-series validation, and local projections.

The tables here have a row a meeting (some hundreds): folds, settings and subsets are what is distributed. Each (setting,
fold) is a group for a small numpy fit; measures are aggregates over the predictions.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import auc
from .windows import folds

#: Strengths of regularisation that are tried, and sizes of forests.
STRENGTHS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
DEPTHS, LEAVES, TREES = (3, 4, 5), (3, 5, 7), 400


def standardise(df: DataFrame, columns: list[str], train) -> DataFrame:
    """Columns less their mean over their population deviation, both of the training rows only."""
    stats = df.where(train).agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))])
    both = df.crossJoin(F.broadcast(stats))  # one row
    names = {c: i for i, c in enumerate(columns)}
    scaled = lambda c: ((F.col(c) - F.col(f"_m{names[c]}")) / F.coalesce(F.nullif(F.col(f"_s{names[c]}"), F.lit(0.0)), F.lit(1.0))).alias(c)
    return both.select(*[scaled(c) if c in names else F.col(c) for c in df.columns])


def _scaled_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return standardise(df, columns, F.lit(True))


def fit_logit(x: np.ndarray, y: np.ndarray, strength: float, classes: np.ndarray) -> np.ndarray:
    """Weights (classes, features + 1) of a multinomial logit: strength * sum(w_i * loss_i) + |W|^2 / 2, the intercept
    free, w_i balancing the classes. Newton's method on the full Hessian, with halved steps."""
    n, d = x.shape
    k = len(classes)
    a = np.concatenate([x, np.ones((n, 1))], axis=1)
    target = (y[:, None] == classes[None, :]).astype(float)
    counts = target.sum(axis=0)
    weight = (n / (np.count_nonzero(counts) * np.maximum(counts, 1)))[target.argmax(axis=1)] * strength
    w = np.zeros((k, d + 1))
    penalty = np.concatenate([np.ones(d), [1e-8]])

    def loss(w):
        z = a @ w.T
        z = z - z.max(axis=1, keepdims=True)
        return float((weight * (np.log(np.exp(z).sum(axis=1)) - (z * target).sum(axis=1))).sum() + 0.5 * (penalty * w * w).sum())

    for _ in range(60):
        z = a @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - target) * weight[:, None]).T @ a + penalty * w
        h = np.zeros((k, d + 1, k, d + 1))
        for i, j in itertools.product(range(k), repeat=2):
            c = weight * p[:, i] * ((i == j) - p[:, j])
            h[i, :, j, :] = (a * c[:, None]).T @ a + (np.diag(penalty) if i == j else 0)
        size = k * (d + 1)
        move = np.linalg.solve(h.reshape(size, size) + 1e-9 * np.eye(size), grad.ravel()).reshape(k, d + 1)
        now = loss(w)
        while loss(w - move) > now and np.abs(move).max() > 1e-10:
            move = move / 2
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def predict_logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ w.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, s = train.mean(axis=0), train.std(axis=0)
    s[s == 0] = 1
    return (train - m) / s, (test - m) / s


def folded(df: DataFrame, features: list[str], y: str, k: int = 5, order: str = "date") -> DataFrame:
    """Complete rows with fold and role; folds are expanding and in order."""
    full = df.select(order, *features, F.col(y).cast("int").alias("y")).dropna()
    n = full.count()  # of meetings
    return full.join(folds(full, n, k, order), order)


def cross_predict(rows: DataFrame, features: list[str], strengths: tuple[float, ...] = STRENGTHS, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """strength, fold, rn, y, predicted, p_<class>: out-of-fold predictions for each strength; a fold whose training
    rows lack a class is left out."""
    names = [f"p_{i}" for i in range(len(classes))]

    def run(pdf):
        import pandas as pd

        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        empty = pd.DataFrame(columns=["strength", "fold", "rn", "y", "predicted", *names])
        if not len(test) or train.y.nunique() < len(classes):
            return empty
        a, b = _scaled(train[features].to_numpy(float), test[features].to_numpy(float))
        p = predict_logit(fit_logit(a, train.y.to_numpy(), float(pdf.strength.iloc[0]), np.array(classes)), b)
        out = test[["strength", "fold", "rn", "y"]].copy()
        out["predicted"] = np.array(classes)[p.argmax(axis=1)]
        for i, c in enumerate(names):
            out[c] = p[:, i]
        return out

    tried = rows.select("*", F.explode(F.array(*map(F.lit, strengths))).alias("strength"))
    schema = "strength double, fold int, rn int, y int, predicted int, " + ", ".join(f"{c} double" for c in names)
    return tried.groupBy("strength", "fold").applyInPandas(run, schema)


def measures(predictions: DataFrame, by: tuple[str, ...] = ("strength",), classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """[by], accuracy mean and deviation (population) over folds, mean one-vs-rest AUC of folds with all classes."""
    keys = [*by, "fold"]
    acc = predictions.groupBy(*keys).agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("acc"), F.countDistinct("y").alias("kinds"))
    # one row a class: a single pass ranks all one-vs-rest problems
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{i}").alias("p")) for i, c in enumerate(classes)])).alias("c")
    rest = predictions.select(*keys, "y", one).select(*keys, F.col("c.class").alias("class"), F.col("c.p").alias("p"), (F.col("y") == F.col("c.class")).alias("_pos"))
    macro = auc(rest, "p", "_pos", (*keys, "class")).groupBy(*keys).agg(F.avg("auc").alias("auc"))
    j = acc.join(macro, keys)
    return j.groupBy(*by).agg(F.avg("acc").alias("accuracy"), F.stddev_pop("acc").alias("accuracy_sd"), F.avg(F.when(F.col("kinds") == len(classes), F.col("auc"))).alias("auc"), F.count(F.lit(1)).alias("folds"))


def _auc(y: np.ndarray, p: np.ndarray, classes) -> float:
    out = []
    for i, c in enumerate(classes):
        pos, neg = p[y == c, i], p[y != c, i]
        if len(pos) and len(neg):
            out.append(((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()))
    return float(np.mean(out)) if out else float("nan")


def inner_auc(x: np.ndarray, y: np.ndarray, strength: float, k: int = 3, classes: tuple[int, ...] = (-1, 0, 1)) -> float:
    """Mean AUC over k expanding folds; folds without all classes in training, or with one class in test, don't count."""
    n = len(y)
    size = n // (k + 1)
    got = []
    for f in range(k):
        start = n - (k - f) * size
        a, b = slice(0, start), slice(start, start + size)
        if size == 0 or len(set(y[a])) < len(classes) or len(set(y[b])) < 2:
            continue
        s, t = _scaled(x[a], x[b])
        got.append(_auc(y[b], predict_logit(fit_logit(s, y[a], strength, np.array(classes)), t), classes))
    return float(np.mean(got)) if got else float("nan")


def search_subsets(df: DataFrame, candidates: list[str], y: str, most: int = 4, strength: float = 0.1, order: str = "date") -> DataFrame:
    """subset, size, auc for every subset of 1 to ``most`` candidates: subsets are spread over tasks, each with the
    meeting-level table."""
    rows = df.select(order, *candidates, F.col(y).cast("int").alias("y")).dropna()
    combos = [",".join(c) for k in range(1, most + 1) for c in itertools.combinations(candidates, k)]
    listed = df.sparkSession.createDataFrame([(c,) for c in combos], "subset string")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        names = pdf.subset.iloc[0].split(",")
        value = inner_auc(pdf[names].to_numpy(float), pdf.y.to_numpy(), strength)
        return pd.DataFrame({"subset": [",".join(names)], "size": [len(names)], "auc": [value]})

    got = listed.crossJoin(F.broadcast(rows)).groupBy("subset").applyInPandas(run, "subset string, size int, auc double")  # rows: one a meeting
    return got.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))


def _grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, depth: int, leaf: int, tries: int, r: np.random.Generator, gains: np.ndarray) -> tuple:
    """A tree by Gini impurity: (feature, cut, left, right) or the leaf's class shares. gains: impurity less, by feature."""
    total = np.bincount(y, weight, k)
    if depth == 0 or len(y) < 2 * leaf or (total > 0).sum() < 2:
        return (total / max(total.sum(), 1e-300),)
    best = (1e-12, -1, 0.0)
    parent = total.sum() - (total @ total) / total.sum()
    for f in r.permutation(x.shape[1])[:tries]:
        by = np.argsort(x[:, f], kind="stable")
        v = x[by, f]
        ahead = np.cumsum(np.eye(k)[y[by]] * weight[by, None], axis=0)[:-1]
        rest = total - ahead
        a, b = ahead.sum(axis=1), rest.sum(axis=1)
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf) & (a > 0) & (b > 0)
        if ok.any():
            less = np.where(ok, parent - (a - (ahead * ahead).sum(axis=1) / np.where(ok, a, 1)) - (b - (rest * rest).sum(axis=1) / np.where(ok, b, 1)), -1.0)
            i = int(less.argmax())
            if less[i] > best[0]:
                best = (float(less[i]), int(f), float((v[i] + v[i + 1]) / 2))
    gain, f, cut = best
    if f < 0:
        return (total / total.sum(),)
    gains[f] += gain
    go = x[:, f] <= cut
    return f, cut, _grow(x[go], y[go], weight[go], k, depth - 1, leaf, tries, r, gains), _grow(x[~go], y[~go], weight[~go], k, depth - 1, leaf, tries, r, gains)


def _shares(tree: tuple, x: np.ndarray, k: int) -> np.ndarray:
    if len(tree) == 1:
        return np.broadcast_to(tree[0], (len(x), k))
    f, cut, low, high = tree
    go = x[:, f] <= cut
    out = np.empty((len(x), k))
    out[go], out[~go] = _shares(low, x[go], k), _shares(high, x[~go], k)
    return out


def fit_forest(x: np.ndarray, y: np.ndarray, classes: np.ndarray, depth: int, leaf: int, trees: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """Trees on bootstrap samples, the square root of the features tried at each split, classes balanced by weight; and
    the features' importances, which sum to 1 (0 without a split)."""
    r = np.random.default_rng(seed)
    at, k = np.searchsorted(classes, y), len(classes)
    counts = np.bincount(at, minlength=k)
    weight = (len(y) / (np.count_nonzero(counts) * np.maximum(counts, 1)))[at]
    tries, grown, importance = max(1, int(x.shape[1] ** 0.5)), [], np.zeros(x.shape[1])
    for _ in range(trees):
        pick, gains = r.integers(0, len(y), len(y)), np.zeros(x.shape[1])
        grown.append(_grow(x[pick], at[pick], weight[pick], k, depth, leaf, tries, r, gains))
        importance += gains / max(gains.sum(), 1e-300)
    return grown, importance / max(importance.sum(), 1e-300)


def _forests(rows: DataFrame, features: list[str], settings, trees: int, seed: int, classes: tuple[int, ...], schema: str, shape) -> DataFrame:
    """``shape`` of each (setting, fold): test rows, class shares, importances. Settings and folds are what is dealt out;
    a group has a row a meeting."""
    listed = rows.sparkSession.createDataFrame([tuple(s) for s in settings], "depth int, leaf int")
    names = np.array(sorted(classes))

    def run(pdf):
        import pandas as pd

        train, test = pdf[pdf.role == "train"].sort_values("rn"), pdf[pdf.role == "test"].sort_values("rn")
        if not len(train) or not len(test):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        depth, leaf = int(pdf.depth.iloc[0]), int(pdf.leaf.iloc[0])
        grown, importance = fit_forest(train[features].to_numpy(float), train.y.to_numpy(), names, depth, leaf, trees, seed)
        x = test[features].to_numpy(float)
        return shape(test, names[sum(_shares(t, x, len(names)) for t in grown).argmax(axis=1)], importance)

    return rows.crossJoin(F.broadcast(listed)).groupBy("depth", "leaf", "fold").applyInPandas(run, schema)  # settings: a handful


def forest_predict(rows: DataFrame, features: list[str], settings=((4, 3),), trees: int = TREES, seed: int = 42, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """depth, leaf, fold, rn, y, predicted by a random forest for each setting and fold. rows: see ``folded``."""

    def shape(test, predicted, importance):
        out = test[["depth", "leaf", "fold", "rn", "y"]].copy()
        out["predicted"] = predicted
        return out

    return _forests(rows, features, settings, trees, seed, classes, "depth int, leaf int, fold int, rn int, y int, predicted int", shape)


def forest_importances(rows: DataFrame, features: list[str], depth: int = 4, leaf: int = 3, trees: int = TREES, seed: int = 42, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """fold, feature, importance: each feature's share of the impurity that splits take away."""

    def shape(test, predicted, importance):
        import pandas as pd

        return pd.DataFrame({"fold": test.fold.iloc[0], "feature": features, "importance": importance})

    return _forests(rows, features, ((depth, leaf),), trees, seed, classes, "fold int, feature string, importance double", shape)


def local_projections(df: DataFrame, shock: str, target: str, horizons: range = range(11), control_lags: tuple[int, ...] = (1, 2), max_lags: int = 4, order: str = "date") -> DataFrame:
    """horizon, coef, se, low, high, n: the h-step change of the target (times 100) on the standardised shock and lags
    of both, with errors robust to autocorrelation (Bartlett weights)."""
    rows = df.select(order, F.col(shock).cast("double").alias("s"), F.col(target).cast("double").alias("t"))

    def run(pdf):
        import pandas as pd

        h = int(pdf.horizon.iloc[0])
        pdf = pdf.sort_values(order)
        s, t = pdf.s.reset_index(drop=True), pdf.t.reset_index(drop=True)
        cols = [c for k in control_lags for c in (t.shift(k), s.shift(k))]
        full = pd.concat([100 * (t.shift(-h) - t), s, *cols], axis=1).dropna().to_numpy(float)
        n = len(full)
        if n <= full.shape[1] + 1:
            return pd.DataFrame([(h, None, None, None, None, n)], columns=["horizon", "coef", "se", "low", "high", "n"])
        y, x = full[:, 0], full[:, 1:].copy()
        x[:, 0] = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std(ddof=1)
        x = np.concatenate([np.ones((n, 1)), x], axis=1)
        inv = np.linalg.pinv(x.T @ x)
        b = inv @ x.T @ y
        u = x * (y - x @ b)[:, None]
        meat = u.T @ u
        for k in range(1, max_lags + 1):
            g = u[k:].T @ u[:-k]
            meat += (1 - k / (max_lags + 1)) * (g + g.T)
        se = float(np.sqrt((inv @ meat @ inv)[1, 1]))
        return pd.DataFrame([(h, b[1], se, b[1] - 1.96 * se, b[1] + 1.96 * se, n)], columns=["horizon", "coef", "se", "low", "high", "n"])

    tried = rows.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    return tried.groupBy("horizon").applyInPandas(run, "horizon int, coef double, se double, low double, high double, n int")


def best_strength(measured: DataFrame, fallback: float = 0.1) -> DataFrame:
    """strength, auc: the one of the best AUC (the smaller of equals), or the fallback where none has an AUC."""
    best = measured.agg(F.max_by("strength", F.struct(F.coalesce("auc", F.lit(-1.0)), -F.col("strength"))).alias("strength"), F.max("auc").alias("auc"))
    return best.select(F.when(F.col("auc").isNull(), fallback).otherwise(F.col("strength")).alias("strength"), "auc")


def nested_validation(rows: DataFrame, candidates: list[str], most: int = 3, strengths: tuple[float, ...] = STRENGTHS, leak: bool = False, classes: tuple[int, ...] = (-1, 0, 1), order: str = "date") -> DataFrame:
    """fold, subset, strength, auc over outer folds. Subset and strength are chosen by inner validation on the fold's
    training rows; with ``leak`` on all rows of the table, as selection before validation does. rows: see ``folded``."""
    combos = [list(c) for k in range(1, most + 1) for c in itertools.combinations(candidates, k)]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        seen = pdf if leak else train
        y = seen.y.to_numpy()

        def value(names, c):
            got = inner_auc(seen[names].to_numpy(float), y, c, classes=classes)
            return -1.0 if np.isnan(got) else got

        strength = max(strengths, key=lambda c: (value(candidates, c), -c))
        subset = max(combos, key=lambda names: (value(names, strength), -len(names), names))
        auc_ = float("nan")
        if train.y.nunique() == len(classes) and test.y.nunique() > 1:
            a, b = _scaled(train[subset].to_numpy(float), test[subset].to_numpy(float))
            auc_ = _auc(test.y.to_numpy(), predict_logit(fit_logit(a, train.y.to_numpy(), strength, np.array(classes)), b), classes)
        return pd.DataFrame([(int(pdf.fold.iloc[0]), ",".join(subset), strength, None if np.isnan(auc_) else auc_)], columns=["fold", "subset", "strength", "auc"])

    return rows.groupBy("fold").applyInPandas(run, "fold int, subset string, strength double, auc double")


def forest_grid(rows: DataFrame, features: list[str], depths: tuple[int, ...] = DEPTHS, leaves: tuple[int, ...] = LEAVES, trees: int = TREES) -> DataFrame:
    """depth, leaf, accuracy of forests over the folds, for each setting."""
    p = forest_predict(rows, features, tuple(itertools.product(depths, leaves)), trees)
    return p.groupBy("depth", "leaf").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"))


def compare(old: DataFrame, new: DataFrame, by: str = "model", value: str = "auc", band: float = 0.005) -> DataFrame:
    """by, old, new, change, verdict: better or worse beyond the band, else same."""
    j = old.select(by, F.col(value).alias("old")).join(new.select(by, F.col(value).alias("new")), by)
    d = F.col("new") - F.col("old")
    return j.select(by, "old", "new", d.alias("change"), F.when(d > band, "better").when(d < -band, "worse").otherwise("same").alias("verdict"))
