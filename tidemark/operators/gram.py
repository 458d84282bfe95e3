"""Correlations of all pairs of features by blocked Gram matrices.

Features are numbered and cut into blocks, dates into lots. A task holds two blocks of features over one lot of dates as
matrices and gives the sums over its dates for every pair; sums of all lots are added up by pair. No row is a pair of a
date's values, as in a self-join; each value is sent to as many tasks as there are blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import pearson

#: Features of a block, dates of a lot.
BLOCK, LOT = 64, 512


def pair_sums(long: DataFrame, block: int = BLOCK, lot: int = LOT, order: str = "date") -> DataFrame:
    """a, b (features, a < b), n, and the sums x, y, xx, yy, xy over the dates that both have; values less their feature's
    mean, which leaves correlations as they are. long: (order, feature, value), a value a date and feature."""
    rows = long.where("value IS NOT NULL").select(F.col(order).alias("_d"), "feature", F.col("value").cast("double").alias("value"))
    # a constant is its own mean, of which sums would make rounding's leftovers
    mean = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.avg("value"))
    stats = rows.groupBy("feature").agg(mean.alias("_m"))
    named = stats.select("feature", "_m", (F.row_number().over(Window.orderBy("feature")) - 1).alias("i"))  # a row a feature
    n_features, n_dates = stats.count(), max(1, rows.agg(F.approx_count_distinct("_d")).first()[0])
    blocks, lots = max(1, -(-n_features // block)), max(1, -(-n_dates // lot))
    own = F.floor(F.col("i") / block).cast("int")
    placed = rows.join(named, "feature").select("_d", "i", (F.col("value") - F.col("_m")).alias("v"), own.alias("own"), F.pmod(F.xxhash64("_d"), F.lit(lots)).cast("int").alias("lot"))
    sent = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("_d", "i", "v", "lot", F.least("own", "_o").alias("p"), F.greatest("own", "_o").alias("q"))

    def run(pdf):
        import pandas as pd

        p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        _, day = np.unique(pdf["_d"].to_numpy(), return_inverse=True)
        i, v = pdf["i"].to_numpy(), pdf["v"].to_numpy()

        def matrices(k):
            here = i // block == k
            x, m = np.zeros((int(day.max()) + 1, block)), np.zeros((int(day.max()) + 1, block))
            x[day[here], i[here] % block], m[day[here], i[here] % block] = v[here], 1.0
            return x, m

        x, mx = matrices(p)
        y, my = (x, mx) if p == q else matrices(q)
        n = mx.T @ my
        a, b = np.nonzero(n)
        keep = p * block + a < q * block + b
        a, b = a[keep], b[keep]
        sums = [n, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
        return pd.DataFrame({"i": p * block + a, "j": q * block + b, **{c: s[a, b] for c, s in zip(("n", "x", "y", "xx", "yy", "xy"), sums)}})

    # a group has two blocks of features over a lot of dates
    parts = sent.groupBy("lot", "p", "q").applyInPandas(run, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    name = lambda i, to: named.select(F.col("i").cast("long").alias(i), F.col("feature").alias(to))
    return sums.join(name("i", "a"), "i").join(name("j", "b"), "j").select("a", "b", F.col("n").cast("long").alias("n"), "x", "y", "xx", "yy", "xy")


def pair_correlations(long: DataFrame, least: int = 20, block: int = BLOCK, lot: int = LOT, order: str = "date", flat: bool = False) -> DataFrame:
    """a, b, r, n of the pairs that share at least so many dates and vary on them; with ``flat`` the others as well, without r.

    Where the sums can't tell a small variance from none, the pair's values are joined by date and looked at themselves."""
    s = pair_sums(long, block, lot, order).where(F.col("n") >= least)
    n = F.col("n")
    cov, vx, vy = (F.col(c) - F.col(a) * F.col(b) / n for c, a, b in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    # what rounding leaves of a constant is no variance
    if not flat:
        still = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
        return s.where(~still).select("a", "b", (cov / F.sqrt(vx * vy)).alias("r"), "n")
    none = (F.col("xx") == 0) | (F.col("yy") == 0)  # all at the mean
    unsure = ~none & ((vx <= 1e-9 * F.col("xx")) | (vy <= 1e-9 * F.col("yy")))
    rows = long.where("value IS NOT NULL").select(F.col(order).alias("_d"), "feature", F.col("value").cast("double").alias("value"))
    side = lambda c: rows.select("_d", F.col("feature").alias(c), F.col("value").alias(f"_{c}"))
    asked = s.select("a", "b", "n", unsure.alias("_u"), F.when(~none & ~unsure, cov / F.sqrt(vx * vy)).alias("r"))
    again = asked.where("_u").select("a", "b").join(side("a"), "a").join(side("b"), ["_d", "b"]).groupBy("a", "b").agg(pearson("_a", "_b").alias("_r"))
    return asked.join(again, ["a", "b"], "left").select("a", "b", F.when(F.col("_u"), F.col("_r")).otherwise(F.col("r")).alias("r"), "n")
