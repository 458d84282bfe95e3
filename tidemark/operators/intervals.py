"""Joins of points with the intervals that hold them, for interval tables too large to be sent to all tasks.

An interval belongs to a level by its length: the cells of level L are 2 ** L wide, the narrowest that the interval isn't
longer than, so it touches two cells at most. A point lies in one cell of each level that occurs (64 at most). Both meet by
an equi-join on level and cell; the exact test comes after it. Nothing is compared with all intervals.

Defined cases: null points, starts or ends match nothing; an interval that ends before it starts matches nothing; both ends
belong to it; intervals that overlap or repeat match each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, x, start, end, unit: float = 1.0) -> DataFrame:
    """Columns of both (their names must differ) for each point x within start..end, whole or other numbers. ``unit``: the
    width of the narrowest cells."""
    mine, theirs = points.columns, intervals.columns
    rows = intervals.withColumns({"_s": start.cast("double"), "_e": end.cast("double")}).where("_s <= _e")
    # an interval of length 0 to unit has level 0; the level's width isn't less than the length
    level = F.greatest(F.ceil(F.log2(F.greatest((F.col("_e") - F.col("_s")) / unit, F.lit(1.0)))), F.lit(0)).cast("int")
    levelled = rows.withColumn("_level", level)
    cell = lambda v: F.floor(v / (F.lit(unit) * F.pow(F.lit(2.0), F.col("_level").cast("double")))).cast("long")
    cut = levelled.withColumn("_cell", F.explode(F.sequence(cell(F.col("_s")), cell(F.col("_e")))))
    levels = sorted(r._level for r in levelled.select("_level").distinct().collect())  # 64 at most for longs, 2,100 for doubles
    if not levels:
        levels = [0]
    placed = points.withColumn("_x", x.cast("double")).where("_x IS NOT NULL").withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cell", cell(F.col("_x")))
    met = placed.join(cut, ["_level", "_cell"]).where("_x BETWEEN _s AND _e")
    return met.select(*mine, *theirs)
