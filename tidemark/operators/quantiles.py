"""Exact quantiles of large groups with bounded buffers.

A first pass keeps a sketch of each group (as large as ``accuracy`` says) and with it, for each probability, two values
between which the quantile lies. A second pass counts what is below, and of the values between only the distinct ones with
their counts: of n values some 4 n / accuracy. The quantile's two neighbours come from running sums over these.

Defined cases: nulls don't count; a group without values has none; of one value all quantiles are it; ties count each; a null key
is a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def quantiles(df: DataFrame, value: str, probabilities: tuple[float, ...], by: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """by, n, q (an array, in the order of the probabilities), interpolated between neighbours."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    edge = 2.0 / accuracy
    low, high = ([min(1.0, max(0.0, p + s * edge)) for p in probabilities] for s in (-1, 1))
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", low, accuracy).alias("_lo"), F.percentile_approx("_v", high, accuracy).alias("_hi"))
    brackets = F.transform(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)), lambda i: F.struct(i.alias("i"), F.get("_lo", i).alias("lo"), F.get("_hi", i).alias("hi")))
    sketched = sketch.where("n > 0").select(*by, "n", brackets.alias("_b"))
    if by:
        renamed = sketched.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "n", "_b")
        same = [rows[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(by)]
        joined = rows.join(renamed, same)
    else:
        joined = rows.crossJoin(F.broadcast(sketched))  # one row
    each = joined.select(*by, "n", "_v", F.inline("_b"))
    keys = [*by, "i"]
    # of the values out of the bracket one at each side matters
    side = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    inner = F.when(side == 0, F.col("_v"))
    some = each.groupBy(*keys, side.alias("side"), inner.alias("_in")).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"), F.max("_v").alias("most"), F.min("_v").alias("least"))
    place = F.when(F.col("side") == -1, F.col("most")).when(F.col("side") == 1, F.col("least")).otherwise(F.col("_in"))
    w = Window.partitionBy(*keys).orderBy("x")
    run = some.select(*keys, "n", "c", place.alias("x")).select("*", F.sum("c").over(w).alias("upto"))
    p = F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1)
    at = p * (F.col("n") - 1)
    k = F.floor(at)
    near = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))  # noqa: E731  the value of the r-th place from 0
    found = run.groupBy(*keys).agg(F.first("n").alias("n"), near(k).alias("a"), near(F.least(k + 1, F.col("n") - 1)).alias("b"))
    q = F.col("a") + (at - k) * (F.col("b") - F.col("a"))
    one = found.select(*by, "n", F.struct("i", q.alias("q")).alias("s"))
    return one.groupBy(*by).agg(F.first("n").alias("n"), F.array_sort(F.collect_list("s")).alias("s")).where("n > 0").select(*by, "n", F.transform("s", lambda x: x["q"]).alias("q"))  # as many as there are probabilities
