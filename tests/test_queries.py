"""Every query with SQL is held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{round(float(v), 4) + 0.0:.4f}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = duck.execute(SQL[name])
    want = rows([d[0] for d in c.description], c.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_significance_reaches_all_lags(spark):
    import numpy as np

    from tidemark.plans import correlations
    from tidemark.schema import MAX_LAG

    got = {(r.base, r.lag): (r.r, r.n) for r in QUERIES["era_corr_significance"](spark, SF).where("era = 'Full'").collect()}
    y = {r.date: r.y for r in correlations.targets(spark, SF).where("target = 'mro_diff'").collect()}
    series = {}
    for r in correlations.long_features(spark, SF).orderBy("date").collect():
        series.setdefault(r.feature, []).append((r.date, r.value))
    want = {}
    for feature, x in series.items():
        for k in range(MAX_LAG + 1):
            both = [(b[1], y[a[0]]) for a, b in zip(x[k:], x, strict=False) if b[1] is not None and y.get(a[0]) and "1995" <= str(a[0]) < "2002"]
            if len(both) >= correlations.LEAST:
                want[feature, k] = (np.corrcoef(np.array(both).T)[0, 1], len(both))
    assert {k for _, k in got} == set(range(16))
    assert {k: v[1] for k, v in got.items() if not k[0].startswith("d_")} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(v[0], abs=1e-4) for k, v in want.items())
