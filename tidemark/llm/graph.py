"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, settle


def _smallest(e: DataFrame) -> DataFrame:
    return settle(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), "minima")


def _large(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the smallest of its neighbourhood."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _smallest(both).select("u", F.least("u", "m").alias("m"), "c")
    return join_counted(both, m, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them."""
    m = _smallest(e)
    near = join_counted(e, m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionAll(m.select("u", F.col("m").alias("v"))).distinct()


#: An edge table of up to so many rows (4 MB) is one task's work: shuffles of it would be merged into one anyway.
SMALL = 1 << 18


def _in_one_task(batches):
    held = [b for b in batches if b.num_rows]
    u, v = (np.concatenate([np.asarray(b.column(k)) for b in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    rest = label != np.arange(len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names[rest]), pa.array(names[label[rest]])], names=["node", "label"])


def components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, label) for every vertex of an edge but the smallest of its component: label is that smallest.

    edges: (u, v), whole numbers; loops and nulls don't count. Up to ``small`` edges are solved in one task of bounded
    size. Beyond, each round is written to the shared folder, and the last leaves stars only; rounds grow with the
    logarithm of a component's length. No vertex's neighbours are ever gathered: minima are combined before the
    shuffle, and edges of a vertex with many are joined with its one row where they are."""
    e = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u != v").distinct()
    e = settle(e, "edges")
    if small and e.count() <= small:
        return settle(e.coalesce(1).mapInArrow(_in_one_task, "node long, label long"), "labels")
    seen = None
    for _ in range(most_rounds):
        n = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        # stars: each vertex has one smaller neighbour, which has none
        stars = n[0] == n[2] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        if stars or tuple(n) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = tuple(n)
        e = settle(_small(settle(_large(e), "edges")), "edges")
    raise RuntimeError("components did not settle")
