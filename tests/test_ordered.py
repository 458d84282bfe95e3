"""Windows by ranges are the windows over the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features, ordered, windows


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    out = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=r.randrange(900)), r.choice([None, None, None, r.random()]), r.choice([None, r.random(), r.random()])) for i in r.sample(range(10_000), 700)]
    out += [(20_000 + i, dt.date(2010, 1, 1), None, 1.0 * i) for i in range(300)]  # a long stretch without a value, and one day
    return spark.createDataFrame(out, "id long, day date, x double, y double").repartition(5)


def same(a, b):
    key = lambda r: tuple((v is None, v if not isinstance(v, float) else round(v, 9)) for v in r)
    return a.columns == b.columns and sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_against_whole_windows(rows, size):
    w = Window.orderBy("id")
    assert same(ordered.forward_fill(rows, "id", ["x"], size=size), features.forward_fill(rows, ["x"], "id"))
    assert same(ordered.lags(rows, "id", ["x", "y"], (1, 9), size=size), windows.lags(rows, ["x", "y"], (1, 9), order="id"))
    assert same(ordered.lags(rows, "id", ["y"], (-3, 2), size=size), rows.select("*", F.lead("y", 3).over(w).alias("y:lag-3"), F.lag("y", 2).over(w).alias("y:lag2")))
    assert same(ordered.differences(rows, "id", ["y"], size=size), windows.differences(rows, ["y"], order="id"))
    got = ordered.rolling_correlation(rows.withColumn("z", F.col("id") % 17 * 1.0), "id", "z", "y", size=size).select("id", "r", "n")
    assert same(got, windows.rolling_correlation(rows.withColumn("z", F.col("id") % 17 * 1.0), "z", "y", order="id"))


def test_ties_of_a_date(rows):
    w = Window.orderBy("day", "id")
    assert same(ordered.lags(rows, "day", ["y"], (1,), ties=("id",), size=50), rows.select("*", F.lag("y", 1).over(w).alias("y:lag1")))


@pytest.mark.parametrize("span", [10, 400, None])
def test_means_over_days(rows, span):
    assert same(ordered.days_mean(rows, "day", "y", "m", span=span), windows.centred_mean(rows.withColumnRenamed("day", "date"), "y", "m").withColumnRenamed("date", "day"))


def test_nothing(rows):
    none = rows.limit(0)
    assert ordered.forward_fill(none, "id", ["x"]).count() == 0 and ordered.lags(none, "id", ["x"], (1,)).count() == 0 and ordered.days_mean(none, "day", "y", "m").count() == 0


def test_no_task_sees_all_rows(rows):
    """The only window without a key is over one row a block or range."""
    plan = ordered.lags(rows, "id", ["x"], (1,), size=64)._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert len(single) <= 1 and "_at" in plan
