"""Properties that hold for any input."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.distributions import incomplete_beta, p_of_r
from tidemark.operators import windows
from tidemark.sources import html

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(st.floats(0, 1), min_size=1, max_size=9))
def test_holm_is_monotone_and_above(spark, ps):
    df = spark.createDataFrame([(f"t{i:02d}", float(p)) for i, p in enumerate(ps)], "name string, p double")
    got = sorted(windows.holm(df).collect(), key=lambda r: (r.p, r.name))
    assert all(r.p <= r.p_adj <= 1 for r in got)
    assert all(a.p_adj <= b.p_adj for a, b in zip(got, got[1:]))


@few
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=60), min_size=1, max_size=8), st.integers(1, 12), st.integers(0, 6))
def test_chunks_are_within_bounds(spark, texts, most, tail):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.squeeze("t").alias("t"))
    for r in df.select("t", tx.sentences("t").alias("s"), tx.pack_sentences("t", most, tail).alias("c")).collect():
        assert " ".join(r.c) == r.t.strip()
        for i, c in enumerate(r.c):
            n = len(c.split())
            assert n <= most or c in r.s or i == len(r.c) - 1  # a long sentence, or a glued tail


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_page_parses(text):
    html.page_elements(text), html.page_elements(f"<main><div>{text}</div></main>"), html.index_links(text)


@given(st.floats(0.1, 60), st.floats(0.1, 60), st.floats(0.001, 0.999))
@settings(max_examples=200, deadline=None)
def test_incomplete_beta_is_symmetric(a, b, x):
    assert math.isclose(incomplete_beta(a, b, x)[()] + incomplete_beta(b, a, 1 - x)[()], 1, abs_tol=1e-9)


@given(st.floats(-1, 1), st.floats(-1, 1), st.integers(4, 500))
@settings(max_examples=100, deadline=None)
def test_p_falls_with_r(r, s, n):
    p, q = p_of_r([abs(r), abs(s)], [n, n])
    assert 0 <= p <= 1 and (abs(r) <= abs(s) or p <= q + 1e-12)


@few
@given(st.lists(st.sampled_from([None, 0.0, 1.5, -2.0]), min_size=1, max_size=12))
def test_fill_keeps_what_is_there(spark, values):
    from tidemark.operators.features import forward_fill

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "date int, v double")
    last, want = None, []
    for v in values:
        last = v if v is not None else last
        want.append(last)
    assert [r.v for r in forward_fill(df, ["v"]).orderBy("date").collect()] == want
    assert forward_fill(df, ["v"]).where(F.col("v").isNull()).count() == want.count(None)


def test_beta_at_known_points():
    assert np.allclose(incomplete_beta([2, 1, 0.5], [3, 1, 0.5], [0.4, 0.3, 0.5]), [0.5248, 0.3, 0.5])
