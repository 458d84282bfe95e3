"""Column expressions shared by the operators. All are null- and ANSI-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def both(x, y) -> tuple[Column, Column]:
    """x and y where neither is null, else null: pairwise complete values."""
    x, y = col(x), col(y)
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pairs(x, y) -> Column:
    a, _ = both(x, y)
    return F.count(a)


def pearson(x, y) -> Column:
    """Pearson's r as an aggregate; null, not an error, where a side is constant."""
    a, b = both(x, y)
    vary = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))  # merged parts of a constant's deviation needn't be 0
    return F.when(vary, F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def pearson_over(x, y, window) -> Column:
    a, b = both(x, y)
    return F.covar_samp(a, b).over(window) / F.nullif(F.stddev_samp(a).over(window) * F.stddev_samp(b).over(window), F.lit(0.0))


def stars(p, none: str = "n.s.") -> Column:
    p = col(p)
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(none)


def day(date) -> Column:
    return F.unix_date(col(date))


def changed(x) -> Column:
    """True where x isn't 0, null included: the first difference of a series counts as a change."""
    return ~col(x).eqNullSafe(F.lit(0.0))


def direction(x) -> Column:
    return F.coalesce(F.signum(col(x)), F.lit(0.0)).cast("int")


def regime(x) -> Column:
    x = col(x)
    return F.when(x > 0, "hiking").when(x < 0, "cutting").otherwise("hold")


def composite(date, mro_diff, shadow_diff, zlb=("2012-01-01", "2022-07-01"), least: float = 0.10) -> Column:
    """The policy rate's change, and inside the zero-bound years the shadow rate's where it is at least ``least``."""
    inside = col(date).between(F.to_date(F.lit(zlb[0])), F.to_date(F.lit(zlb[1])))
    signal = F.when(F.abs(col(shadow_diff)) >= least, col(shadow_diff)).otherwise(0.0)
    return F.when(inside, signal).otherwise(col(mro_diff))


def row_mean_abs(*columns) -> Column:
    """Mean of the absolute values of the columns that aren't null; null if all are."""
    values = F.filter(F.array(*[F.abs(col(c)) for c in columns]), lambda x: x.isNotNull())
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def fisher_interval(r, n, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of r by Fisher's transformation; r is clipped off +-1."""
    clipped = F.greatest(F.least(col(r), F.lit(0.999999)), F.lit(-0.999999))
    half = z / F.sqrt(F.greatest(col(n) - 3, F.lit(1)))
    return F.tanh(F.atanh(clipped) - half), F.tanh(F.atanh(clipped) + half)


def year_bin(date, edges: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """Bins (edge, next edge] of the year."""
    y = F.year(col(date))
    out = F.when(F.lit(False), "")
    for low, high, name in zip(edges, edges[1:], names):
        out = out.when((y > low) & (y <= high), name)
    return out


def topic_code(topic) -> Column:
    from ..schema import TOPIC_CODES

    out = F.when(F.lit(False), "")
    for name, code in TOPIC_CODES.items():
        out = out.when(col(topic) == name, code)
    return out


def column_label(model, part=None, is_question=None, topic=None, question_labelled: bool = False) -> Column:
    """model[_part][_question|answer][_topic code]; the third only where asked for, and not for introductions."""
    parts = [col(model)]
    kind = None
    if question_labelled and is_question is not None:
        kind = F.when(col(is_question), "question").otherwise("answer")
    if part is not None:
        parts.append(col(part))
        if kind is not None:
            kind = F.when(col(part) == "QA", kind)
    if kind is not None:
        parts.append(kind)
    if topic is not None:
        parts.append(topic_code(topic))
    return F.concat_ws("_", *parts)
