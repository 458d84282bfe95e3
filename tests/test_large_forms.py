"""Interval joins, pairwise correlations and quantiles in the forms for large tables, against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram, intervals, quantiles


@pytest.mark.parametrize("unit", [1.0, 0.5, 100.0])
def test_interval_join(spark, unit):
    r = random.Random(int(unit * 10))
    pts = [(i, r.choice([None, r.randrange(-500, 500), r.random() * 50])) for i in range(200)]
    ivs = []
    for j in range(150):
        a = r.randrange(-500, 500)
        ivs.append((j, r.choice([None, a, a + 0.25]), r.choice([None, a, a + r.randrange(9), a + r.randrange(900), a - 3])))
    ivs += [(900, -1e6, 1e6), (901, 0, 0), (902, 0, 0)]
    points = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in pts], "i int, x double")
    table = spark.createDataFrame([(j, None if a is None else float(a), None if b is None else float(b)) for j, a, b in ivs], "j int, a double, b double")
    df = intervals.interval_join(points, table, F.col("x"), F.col("a"), F.col("b"), unit)
    want = sorted((i, j) for i, x in pts for j, a, b in ivs if None not in (x, a, b) and a <= x <= b)
    assert sorted((x.i, x.j) for x in df.collect()) == want and df.columns == ["i", "x", "j", "a", "b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(points, table.limit(0), F.col("x"), F.col("a"), F.col("b")).count() == 0


@pytest.mark.parametrize("block,lot", [(3, 7), (64, 512)])
def test_pair_correlations(spark, block, lot):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8)) + 1e6
    x[:, 7] = 5.0  # constant
    have = r.random((60, 8)) < 0.7
    rows = [(d, f"f{j}", float(x[d, j]) if have[d, j] else None) for d in range(60) for j in range(8)]
    got = {(g.a, g.b): (g.r, g.n) for g in gram.pair_correlations(spark.createDataFrame(rows, "date int, feature string, value double"), 20, block, lot).collect()}
    want = {}
    for i in range(7):
        for j in range(i + 1, 7):
            both = have[:, i] & have[:, j]
            if both.sum() >= 20:
                want[f"f{i}", f"f{j}"] = (np.corrcoef(x[both, i], x[both, j])[0, 1], int(both.sum()))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-7) for k in want)


@pytest.mark.parametrize("accuracy", [5, 50, 10_000])
def test_quantiles(spark, accuracy):
    r = random.Random(accuracy)
    groups = {"one": [3.0], "two": [1.0, 9.0], "ties": [7.0] * 500 + [8.0], "many": [r.gauss(0, 1) for _ in range(1500)], "mixed": [float(r.randrange(9)) for _ in range(77)], None: [1.0, 2.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    ps = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: (x.n, x.q) for x in quantiles.quantiles(df, "v", ps, ("g",), accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, (n, q) in got.items():
        assert n == len(groups[g]) and q == pytest.approx(np.quantile(groups[g], ps).tolist(), abs=1e-12)
    every = [v for vs in groups.values() for v in vs]
    assert quantiles.quantiles(df, "v", ps, (), accuracy).first().q == pytest.approx(np.quantile(every, ps).tolist(), abs=1e-12)
    assert quantiles.quantiles(df.limit(0), "v", ps, (), accuracy).count() == 0
