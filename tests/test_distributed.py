"""Fits over partitions are the local ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distributed, learning


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=300) > 0.5, 1, np.where(x[:, 1] > 0.6, -1, 0))
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int").repartition(7)
    return df, x, y


def test_logit_is_the_local_one(data):
    df, x, y = data
    for strength in (0.1, 5.0):
        want = learning.fit_logit(x, y, strength, np.array([-1, 0, 1]))
        assert np.allclose(distributed.fit_logit(df, ["a", "b", "c"], strength), want, atol=1e-6)


def test_logit_gradient_at_the_fit_is_zero(data):
    df, _, y = data
    w = distributed.fit_logit(df, ["a", "b", "c"], 0.5)
    weight = np.array([0.5 * len(y) / (3 * (y == c).sum()) for c in (-1, 0, 1)])
    _, grad, _ = distributed.logit_sums(df, ["a", "b", "c"], w, weight, np.array([-1, 0, 1]))
    assert np.abs(grad + np.array([1, 1, 1, 1e-8]) * w).max() < 1e-6


def test_logit_of_two_classes_and_none(spark, data):
    df, x, y = data
    keep = y != -1
    want = learning.fit_logit(x[keep], y[keep], 1.0, np.array([-1, 0, 1]))
    assert np.allclose(distributed.fit_logit(df.where("y <> -1"), ["a", "b", "c"], 1.0), want, atol=1e-6)
    with pytest.raises(ValueError):
        distributed.fit_logit(df.limit(0), ["a"], 1.0)


def test_a_tree_is_the_local_one(data):
    df, x, y = data
    at = np.searchsorted([-1, 0, 1], y)
    weight = (len(y) / (3 * np.bincount(at, minlength=3)))[at]
    for depth, leaf in ((1, 3), (4, 3), (5, 20)):
        forest = distributed.Forest.fit(df, ["a", "b", "c"], "id", depth, leaf, 1, bins=16, tries=3, bootstrap=False)
        b = forest.bins(x)
        tree = learning._grow(b.astype(float), at, weight, 3, depth, leaf, 3, np.random.default_rng(0), np.zeros(3))
        assert np.allclose(forest.class_shares(x), learning._shares(tree, b.astype(float), 3))


def test_a_forest_finds_what_decides(spark, data):
    df, x, y = data
    forest = distributed.Forest.fit(df, ["a", "b", "c"], "id", trees=30)
    again = distributed.Forest.fit(df.repartition(2), ["a", "b", "c"], "id", trees=30, cuts=forest.cuts)
    assert np.array_equal(forest.feature, again.feature) and np.allclose(forest.shares, again.shares)
    got = forest.predict(df)
    assert got.where(F.col("y") == F.col("predicted")).count() > 250
    share = forest.importances()
    assert share.sum() == pytest.approx(1) and share[2] < min(share[:2])


def test_a_forest_of_nothing_and_of_constants(spark, data):
    df = data[0]
    flat = distributed.Forest.fit(df.withColumn("a", F.lit(1.0)).withColumn("y", F.lit(0)), ["a"], "id", trees=2)
    assert (flat.feature < 0).all() and np.allclose(flat.shares[:, 0], [0, 1, 0])


def test_projections_are_the_local_ones(spark):
    r = np.random.default_rng(5)
    s, e = r.normal(size=150), r.normal(size=150)
    t = np.cumsum(0.3 * s + 0.5 * np.roll(e, 1) + e)
    rows = [(i, float(a), None if i in (40, 41, 77) else float(b)) for i, (a, b) in enumerate(zip(s, t))]
    df = spark.createDataFrame(rows, "date int, s double, t double").repartition(3)
    for size in (16, 1 << 16):
        got = {x.horizon: x for x in distributed.local_projections(df, "s", "t", range(3), size=size).collect()}
        want = {x.horizon: x for x in learning.local_projections(df, "s", "t", range(3)).collect()}
        assert got.keys() == want.keys()
        for h, x in want.items():
            assert got[h].n == x.n and np.allclose([got[h].coef, got[h].se, got[h].low, got[h].high], [x.coef, x.se, x.low, x.high])
    few = distributed.local_projections(df.limit(3), "s", "t", range(2)).collect()
    assert [(x.horizon, x.coef) for x in few] == [(0, None), (1, None)]
