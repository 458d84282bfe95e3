"""Fits over tables of any size: rows stay where they are, and what the fit needs of them is summed over the partitions.

* :func:`fit_logit` is ``learning.fit_logit`` by Newton steps whose gradients and Hessians are sums over partitions.
* :func:`local_projections` is ``learning.local_projections`` from sums of products by horizon; the errors' autocorrelation
  comes from equi-joins of neighbouring places, so no task sees a horizon's whole series.
* :class:`Forest` grows all trees level by level from histograms of binned features, summed by Spark for each tree and
  node; the best split of a node is found in a task of its own, and only the splits come back.

Defined cases: rows with a null in any column that is used don't count; a constant feature has weight 0 and no split; a
class without rows gets the share 0; no rows are an error in the logit and give a forest of empty leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import numbered
from . import ordered
from .learning import TREES, _scaled_columns


def _arrays(batch: pa.RecordBatch, features: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(batch.column(c), dtype=float) for c in features], axis=1) if features else np.zeros((batch.num_rows, 0))
    return x, np.searchsorted(classes, np.asarray(batch.column("y")))


def _summed(parts: DataFrame) -> np.ndarray:
    """Elementwise sum of arrays of equal length."""
    rows = parts.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # as many as an array is long
    out = np.zeros(len(rows))
    for r in rows:
        out[r.pos] = r.s
    return out


def logit_sums(rows: DataFrame, features: list[str], w: np.ndarray, weight: np.ndarray, classes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the unpenalised multinomial logit at w. rows: features and y; weight: a class's."""
    k, d = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, h = 0.0, np.zeros((k, d)), np.zeros((k, d, k, d))
        for batch in batches:
            x, y = _arrays(batch, features, classes)
            a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            z = a @ w.T
            top = z.max(axis=1, keepdims=True)
            p = np.exp(z - top)
            s = p.sum(axis=1, keepdims=True)
            p /= s
            c = weight[y]
            loss += float((c * (np.log(s[:, 0]) + top[:, 0] - z[np.arange(len(y)), y])).sum())
            grad += ((p - np.eye(k)[y]) * c[:, None]).T @ a
            for i in range(k):
                for j in range(k):
                    h[i, :, j, :] += (a * (c * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
        flat = np.concatenate([[loss], grad.ravel(), h.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["x"])

    flat = _summed(rows.select(*features, "y").mapInArrow(run, "x array<double>"))
    n = k * d
    return float(flat[0]), flat[1 : n + 1].reshape(k, d), flat[n + 1 :].reshape(n, n)


def fit_logit(rows: DataFrame, features: list[str], strength: float, classes: tuple[int, ...] = (-1, 0, 1), steps: int = 60) -> np.ndarray:
    """Weights (classes, features + 1): strength * sum(w_i * loss_i) + |W|^2 / 2, the intercept free, w_i balancing the
    classes. rows: features and y without nulls."""
    names = np.array(sorted(classes))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    n = sum(counts.values())
    if not n:
        raise ValueError("no rows to fit on")
    weight = np.array([strength * n / (len(counts) * counts[c]) if c in counts else 0.0 for c in names.tolist()])
    k, d = len(names), len(features) + 1
    penalty = np.tile(np.append(np.ones(d - 1), 1e-8), (k, 1))
    w, move = np.zeros((k, d)), np.zeros((k, d))
    best = np.inf
    for _ in range(steps):
        loss, grad, h = logit_sums(rows, features, w - move, weight, names)
        loss += 0.5 * float((penalty * (w - move) ** 2).sum())
        if loss > best and np.abs(move).max() > 1e-10:
            move = move / 2
            continue
        w, best = w - move, loss
        if np.isfinite(best) and 0 < np.abs(move).max() < 1e-9:
            break
        grad = grad + penalty * w
        move = np.linalg.solve(h + np.diag(penalty.ravel()) + 1e-9 * np.eye(k * d), grad.ravel()).reshape(k, d)
    return w


def coefficients(df: DataFrame, features: list[str], y: str, strength: float, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """class, feature, weight of the fit on all complete rows, features standardised."""
    rows = _scaled_columns(df.select(*features, F.col(y).cast("int").alias("y")).dropna(), features)
    rows = rows.persist()  # every step reads them
    try:
        w = fit_logit(rows, features, strength, classes)
    finally:
        rows.unpersist()
    out = [(c, f, float(w[i, j])) for i, c in enumerate(sorted(classes)) for j, f in enumerate([*features, "intercept"])]
    return df.sparkSession.createDataFrame(out, "class int, feature string, weight double")


def local_projections(df: DataFrame, shock: str, target: str, horizons: range = range(11), control_lags: tuple[int, ...] = (1, 2), max_lags: int = 4, order: str = "date", size: int = ordered.SIZE) -> DataFrame:
    """horizon, coef, se, low, high, n: the h-step change of the target (times 100) on the standardised shock and lags of
    both, with errors robust to autocorrelation (Bartlett weights). The order is a total one."""
    base = df.select(order, F.col(shock).cast("double").alias("s"), F.col(target).cast("double").alias("t"))
    made = {f"c{i}": (lambda w, c=c, k=k: F.lag(c, k).over(w)) for i, (k, c) in enumerate((k, c) for k in control_lags for c in ("t", "s"))}
    names = [*made]
    made |= {f"y{h}": (lambda w, h=h: 100 * (F.lead("t", h).over(w) - F.col("t"))) for h in horizons}
    wide = ordered.windowed(ordered.blocks(base, order, size=size).drop("_block").withColumnRenamed("_rn", "rn"), "rn", made, max(control_lags), max(horizons), size=size)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in horizons])).alias("h")
    rows = wide.select("rn", "s", *names, each).select("rn", "s", *names, "h.horizon", "h.y").dropna().persist()  # two passes
    try:
        cols = ["s", *names, "y"]
        sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
        found = rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols], *sums).collect()  # a row a horizon
        fits, out = [], {h: (h, None, None, None, None, 0) for h in horizons}
        for r in found:
            out[r.horizon] = (r.horizon, None, None, None, None, r.n)
            if r.n <= len(cols) + 1:
                continue
            mean = np.array([r[c] for c in cols]) / r.n
            cov = np.array([[r[f"{a}_{b}"] if i <= j else r[f"{b}_{a}"] for j, b in enumerate(cols)] for i, a in enumerate(cols)]) - r.n * np.outer(mean, mean)
            sd = np.sqrt(cov[0, 0] / (r.n - 1))
            inv = np.linalg.pinv(cov[:-1, :-1])
            b = inv @ cov[:-1, -1]
            # of the shock's coefficient: what each row adds to it is its error times the weights a
            fits.append((r.horizon, (mean).tolist(), b.tolist(), inv[0].tolist()))
            out[r.horizon] = (r.horizon, float(b[0] * sd), float(sd), None, None, r.n)
        if fits:
            few = F.broadcast(df.sparkSession.createDataFrame(fits, "horizon int, m array<double>, b array<double>, a array<double>"))
            off = [F.col(c) - F.col("m")[i] for i, c in enumerate(cols)]
            total = lambda w: sum((F.col(w)[i] * off[i] for i in range(len(cols) - 1)), F.lit(0.0))
            v = total("a") * (off[-1] - total("b"))
            told = rows.join(few, "horizon").select("horizon", v.alias("v"), (F.col("horizon") * F.lit(float(1 << 44)) + F.col("rn")).alias("_o"))
            placed = numbered(told, "_o", "place")
            ahead = placed.select("horizon", F.col("v").alias("u"), "place", F.explode(F.sequence(F.lit(0), F.lit(max_lags))).alias("k")).select("horizon", "u", "k", (F.col("place") + F.col("k")).alias("place"))
            products = placed.join(ahead, ["horizon", "place"]).groupBy("horizon", "k").agg(F.sum(F.col("v") * F.col("u")).alias("g")).collect()  # some numbers a horizon
            meat = dict.fromkeys((f[0] for f in fits), 0.0)
            for r in products:
                meat[r.horizon] += r.g * (1.0 if r.k == 0 else 2 * (1 - r.k / (max_lags + 1)))
            for h, m in meat.items():
                _, coef, sd, _, _, n = out[h]
                se = float(np.sqrt(m)) * sd
                out[h] = (h, coef, se, coef - 1.96 * se, coef + 1.96 * se, n)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([out[h] for h in horizons], "horizon int, coef double, se double, low double, high double, n int")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of whole numbers to [0, 1)."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


_POISSON = np.cumsum([np.exp(-1) / np.prod(range(1, i + 1), initial=1.0) for i in range(16)])


class Forest:
    """Trees as heaps: node i has the children 2 i + 1 (values at most the cut) and 2 i + 2. feature -1: a leaf."""

    def __init__(self, features: list[str], classes: np.ndarray, cuts: list[np.ndarray], depth: int, trees: int):
        self.features, self.classes, self.cuts, self.depth = features, classes, cuts, depth
        size = (2 << depth) - 1
        self.feature, self.cut = np.full((trees, size), -1), np.zeros((trees, size), int)
        self.shares, self.gains = np.zeros((trees, size, len(classes))), np.zeros((trees, len(features)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], axis=1)

    def nodes(self, tree: int, b: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node after so many levels, or the leaf it has come to."""
        at = np.zeros(len(b), int)
        for _ in range(levels):
            f = self.feature[tree, at]
            right = b[np.arange(len(b)), np.maximum(f, 0)] > self.cut[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], key: str, depth: int = 4, leaf: int = 3, trees: int = TREES, classes: tuple[int, ...] = (-1, 0, 1), bins: int = 32, tries: int | None = None, bootstrap: bool = True, seed: int = 42, cuts: list[np.ndarray] | None = None) -> Forest:
        """rows: features, y and a whole-number key that seeds each row's draws. ``cuts``: the bins' inner edges by feature;
        else they are quantiles, as near as a bin's tenth."""
        names = np.array(sorted(classes))
        full = rows.select(*features, F.col("y").cast("int").alias("y"), F.col(key).cast("long").alias("_key")).dropna()
        cuts = cuts or [np.unique(c) for c in full.approxQuantile(features, [i / bins for i in range(1, bins)], 0.1 / bins)]
        counts = {r.y: r.n for r in full.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
        n = sum(counts.values())
        weight = np.array([n / (len(counts) * counts[c]) if c in counts else 0.0 for c in names.tolist()])
        forest = cls(features, names, cuts, depth, trees)
        tries = tries or max(1, int(len(features) ** 0.5))
        for level in range(depth + 1):
            got = forest._level(full, level, weight, leaf, tries, bootstrap, seed).collect()  # a row a node of a tree
            for r in got:
                forest.feature[r.tree, r.node], forest.cut[r.tree, r.node] = r.feature, r.cut
                forest.shares[r.tree, r.node] = r.shares
                if r.feature >= 0:
                    forest.gains[r.tree, r.feature] += r.gain
            if not any(r.feature >= 0 for r in got):
                break
        return forest

    def _level(self, rows: DataFrame, level: int, weight: np.ndarray, leaf: int, tries: int, bootstrap: bool, seed: int) -> DataFrame:
        """tree, node, feature, cut, gain, shares of the nodes of a level: histograms, their sums, the best splits."""
        me, k, d = self, len(self.classes), len(self.features)
        width = max(len(c) for c in self.cuts) + 1
        low, n_nodes, last = (1 << level) - 1, 1 << level, level == self.depth

        def histograms(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                x, y = _arrays(batch, me.features, me.classes)
                b, keys = me.bins(x), np.asarray(batch.column("_key"))
                for t in range(len(me.feature)):
                    at = me.nodes(t, b, level) - low
                    times = np.searchsorted(_POISSON, _mixed(keys, seed * 100_003 + t), "right") if bootstrap else np.ones(len(y), int)
                    on = np.flatnonzero((at >= 0) & (times > 0))
                    if not len(on):
                        continue
                    place = ((at[on, None] * d + np.arange(d)) * width + b[on]) * k + y[on, None]
                    own = np.bincount(place.ravel(), np.repeat(times[on], d), n_nodes * d * width * k)
                    sums[t] = sums[t] + own if t in sums else own
            for t, h in sums.items():
                used = np.flatnonzero(h)
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(used), t, np.int32), "place": used.astype(np.int64), "n": h[used]})

        def best(pdf):
            import pandas as pd

            tree, node = int(pdf.tree.iloc[0]), int(pdf.node.iloc[0])
            h = np.zeros(d * width * k)
            h[pdf.place.to_numpy() % (d * width * k)] = pdf.n.to_numpy()
            h = h.reshape(d, width, k)
            total = h[0].sum(axis=0) * weight
            many = h[0].sum()
            found = (1e-12, -1, 0)
            if not last and many >= 2 * leaf and (total > 0).sum() > 1:
                parent = total.sum() - (total @ total) / total.sum()
                order = np.random.default_rng((seed, tree, node)).permutation(d)[:tries]
                for f in order.tolist():
                    ahead, count = np.cumsum(h[f] * weight, axis=0)[:-1], np.cumsum(h[f].sum(axis=1))[:-1]
                    rest = total - ahead
                    a, c = ahead.sum(axis=1), rest.sum(axis=1)
                    ok = (count >= leaf) & (many - count >= leaf) & (a > 0) & (c > 1e-12)
                    if ok.any():
                        less = np.where(ok, parent - (a - (ahead * ahead).sum(axis=1) / np.where(ok, a, 1)) - (c - (rest * rest).sum(axis=1) / np.where(ok, c, 1)), -1.0)
                        i = int(less.argmax())
                        if less[i] > found[0]:
                            found = (float(less[i]), f, i)
            gain, f, cut = found
            return pd.DataFrame([(tree, node, f, cut, gain if f >= 0 else 0.0, (total / max(total.sum(), 1e-300)).tolist())], columns=["tree", "node", "feature", "cut", "gain", "shares"])

        parts = rows.mapInArrow(histograms, "tree int, place long, n double")
        sums = parts.groupBy("tree", "place").agg(F.sum("n").alias("n"))
        node = (F.floor(F.col("place") / (d * width * k)) + low).cast("int").alias("node")
        # a group has a bin of a feature and a class in each row
        return sums.select("tree", node, "place", "n").groupBy("tree", "node").applyInPandas(best, "tree int, node int, feature int, cut int, gain double, shares array<double>")

    def importances(self) -> np.ndarray:
        """Each feature's share of what splits take away, the mean over trees."""
        own = self.gains / np.maximum(self.gains.sum(axis=1, keepdims=True), 1e-300)
        total = own.mean(axis=0)
        return total / max(total.sum(), 1e-300)

    def class_shares(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return np.mean([self.shares[t, self.nodes(t, b, self.depth)] for t in range(len(self.feature))], axis=0)

    def predict(self, df: DataFrame, to: str = "predicted") -> DataFrame:
        """df with the class of the largest mean share."""
        me, names = self, df.columns

        def run(batches):
            for batch in batches:
                x = np.stack([np.asarray(batch.column(c), dtype=float) for c in me.features], axis=1)
                got = me.classes[me.class_shares(x).argmax(axis=1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*names, to])

        kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.mapInArrow(run, f"{kinds}, `{to}` int")
