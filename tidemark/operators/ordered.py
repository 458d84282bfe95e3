"""Windows over a whole table in order, without a key and without one task that sees all rows.

Rows are numbered by ranges (sources.store.numbered), and every SIZE neighbours are a block. A block's window functions need
its own rows and a halo of neighbours: rows near an edge are sent to the next block as well. What reaches back without
bound, as a forward fill does, is carried: each block's last values, one row a block, are scanned, and each block starts
from its carry. Both give what the window over the whole table gives, if the order (with its ties) is a total one.

Defined cases: empty tables give none; a table smaller than a block is one block; rows with a null order come first, as in a
window; a halo may be larger than a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expressions import pearson_over
from ..sources.store import numbered

#: Rows of a block.
SIZE = 1 << 16


def _number(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    return F.unix_date(order).cast("double") if kind == "date" else F.col(order).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(order).cast("double")


def blocks(df: DataFrame, order: str, ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """df with _rn, the row's number from 0, and _block."""
    rows = numbered(df.withColumn("_x", _number(df, order)), "_x", "_rn", (order, *ties)).drop("_x")
    return rows.withColumn("_block", F.floor(F.col("_rn") / size).cast("long"))


def windowed(df: DataFrame, order: str, columns: dict[str, Callable[[WindowSpec], Column]], before: int, after: int = 0, ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """df with columns by functions of a window, which may look at ``before`` rows back and ``after`` rows ahead."""
    rows = blocks(df, order, ties, size)
    first = F.greatest(F.floor((F.col("_rn") - after) / size), F.lit(0)).cast("long")
    last = F.floor((F.col("_rn") + before) / size).cast("long")
    sent = rows.withColumn("_at", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("_at").orderBy("_rn")
    out = sent.select("*", *[f(w).alias(name) for name, f in columns.items()])
    return out.where("_at = _block").select(*df.columns, *columns)


def lags(df: DataFrame, order: str, columns: list[str], steps: tuple[int, ...], ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """All lag columns name:lagN; negative steps look ahead."""
    made = {f"{c}:lag{k}": (lambda w, c=c, k=k: F.lag(c, k).over(w)) for c in columns for k in steps}
    return windowed(df, order, made, max(0, *steps), max(0, *(-k for k in steps)), ties, size)


def differences(df: DataFrame, order: str, columns: list[str], ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    return windowed(df, order, {f"d_{c}": (lambda w, c=c: F.col(c) - F.lag(c).over(w)) for c in columns}, 1, 0, ties, size)


def rolling_correlation(df: DataFrame, order: str, x: str, y: str, rows: int = 20, least: int = 10, ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """df's rows that have both values, with r and n over the last ``rows`` of them; r is null under ``least``."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    frame = lambda w: w.rowsBetween(-(rows - 1), 0)
    made = {"n": lambda w: F.count(F.lit(1)).over(frame(w)), "r": lambda w: F.when(F.count(F.lit(1)).over(frame(w)) >= least, pearson_over(x, y, frame(w)))}
    return windowed(full, order, made, rows - 1, 0, ties, size)


def forward_fill(df: DataFrame, order: str, columns: list[str], ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Each column's last value that isn't null."""
    rows = blocks(df, order, ties, size)
    lasts = rows.groupBy("_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(c) for c in columns])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carry = lasts.select(F.col("_block"), *[F.last(c, ignorenulls=True).over(ahead).alias(f"_c{i}") for i, c in enumerate(columns)])
    w = Window.partitionBy("_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    place = {c: i for i, c in enumerate(columns)}
    filled = [F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c{place[c]}")).alias(c) if c in place else F.col(c) for c in df.columns]
    return rows.join(carry, "_block").select(*filled)


def days_mean(df: DataFrame, order: str, column: str, to: str, days: int = 180, span: int | None = None) -> DataFrame:
    """Mean of a trailing and a leading mean over ``days`` days, each with the row's own day and without the day exactly
    ``days`` away. A block is ``span`` days; days near its edges are sent to its neighbours. Days are summed up first, so
    a day of many rows counts as one."""
    span = span or 16 * days
    per = df.groupBy(F.unix_date(order).alias("_d")).agg(F.sum(column).alias("_s"), F.count(column).alias("_n"))
    block = lambda x: F.floor(x / span).cast("long")
    sent = per.withColumn("_at", F.explode(F.sequence(block(F.col("_d") - (days - 1)), block(F.col("_d") + (days - 1)))))
    w = Window.partitionBy("_at").orderBy("_d")
    back, ahead = w.rangeBetween(-(days - 1), 0), w.rangeBetween(0, days - 1)
    mean = lambda f: F.sum("_s").over(f) / F.nullif(F.sum("_n").over(f), F.lit(0))
    means = sent.select("_d", "_at", ((mean(back) + mean(ahead)) / 2).alias(to)).where(F.col("_at") == block(F.col("_d"))).select("_d", to)
    return df.withColumn("_d", F.unix_date(order)).join(means, "_d").select(*df.columns, to)
