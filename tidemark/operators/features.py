"""From scored chunks to the meeting-level feature matrix."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import column_label
from ..schema import STATS, labels


def chunk_data(scores: DataFrame, word_limit: int | None = 200, topic_model: str = "facebook", with_label: bool = True, drop_irrelevant: bool = False) -> DataFrame:
    """Scored chunks of one limit and, labelled, of one topic model; clearly irrelevant ones dropped on demand."""
    out = scores if word_limit is None else scores.where(F.col("chunk_limit") == word_limit)
    if not with_label:
        return out
    out = out.where(F.col("topic_model") == topic_model).drop("topic_model")
    if drop_irrelevant:
        out = out.where(~F.coalesce((F.col("topic") == "OTHER_IRRELEVANT") & (F.col("topic_prob") > 0.7), F.lit(False)))
    return out


def moments(data: DataFrame, with_label: bool = True, is_qa: bool = True, by_question: bool = True, distinct: tuple[str, ...] | None = None) -> DataFrame:
    """min, mean, max, std (sample) and count of the score per meeting [part] [topic] [question] model.

    Unlabelled rows are made distinct first: the join with topics repeats a chunk per topic."""
    if not with_label:
        data = data.dropDuplicates(list(distinct or ("date", "part", "is_question", "chunk_rowid", "sentiment_model", "score")))
    keys = ["date", *(["part"] if is_qa else []), *(["topic"] if with_label else []), *(["is_question"] if by_question else []), "sentiment_model"]
    return data.groupBy(*keys).agg(F.min("score").alias("min"), F.avg("score").alias("mean"), F.max("score").alias("max"), F.stddev_samp("score").alias("std"), F.count("score").alias("count"))


def forward_fill(df: DataFrame, columns: list[str], order: str = "date") -> DataFrame:
    """Each column's last value that isn't null. The order is global: for frames of one row a meeting."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def wide_matrix(agg: DataFrame, is_qa: bool, qa_options: str, with_label: bool) -> DataFrame:
    """One row a meeting and a column per label and statistic, filled forward.

    The labels are listed beforehand, so the schema is static and no job looks for them. Columns of question times stay
    null at meetings that had none. Meetings without any value are dropped."""
    label = column_label("sentiment_model", "part" if is_qa else None, "is_question" if "is_question" in agg.columns else None, "topic" if with_label else None, qa_options == "both_divided")
    rows = agg.withColumn("label", label)
    if qa_options.startswith("just"):
        rows = rows.where(F.col("is_question") == (qa_options == "just_questions"))
    names = labels(is_qa, qa_options, with_label)
    has_qa = [F.max(F.when(F.col("part") == "QA", 1).otherwise(0)).alias("_qa")] if is_qa else []
    cells = [F.max(F.when(F.col("label") == n, F.col(s))).alias(f"{n}_{s}") for n in names for s in STATS]
    wide = rows.groupBy("date").agg(*has_qa, *cells)
    columns = [f"{n}_{s}" for n in names for s in STATS]
    filled = forward_fill(wide, columns)
    if is_qa:
        filled = filled.select("date", *[F.when(F.col("_qa") == 1, F.col(c)).alias(c) if "_QA_" in c else F.col(c) for c in columns])
    return filled.dropna(how="all", subset=columns)


def feature_matrix(scores: DataFrame, word_limit: int | None = 200, is_qa: bool = True, qa_options: str = "just_answers", with_label: bool = True, topic_model: str = "facebook", drop_irrelevant: bool = False) -> DataFrame:
    data = chunk_data(scores, word_limit, topic_model, with_label, drop_irrelevant)
    return wide_matrix(moments(data, with_label, is_qa, qa_options != "both_together"), is_qa, qa_options, with_label)


def join_panels(panels: list[DataFrame]) -> DataFrame:
    """Inner join on date of panels whose columns clash: later ones get the panel's number as a suffix."""
    seen = {"date"}
    renamed = []
    for i, p in enumerate(panels):
        renamed.append(p.select("date", *[F.col(c).alias(f"{c}_{i}" if c in seen else c) for c in p.columns if c != "date"]))
        seen |= set(p.columns)
    return functools.reduce(lambda a, b: a.join(b, "date"), renamed)


def model_data(market: DataFrame, features: DataFrame) -> DataFrame:
    return market.join(features, "date")


def join_new_columns(frames: list[DataFrame]) -> DataFrame:
    """Left joins on date that add only columns not there yet."""
    out = frames[0]
    for f in frames[1:]:
        fresh = [c for c in f.columns if c not in out.columns]
        out = out.join(f.select("date", *fresh), "date", "left")
    return out


def outer_chain(frames: dict[str, DataFrame], value: str) -> DataFrame:
    """Full outer joins on date; the value column is named after its frame."""
    parts = [f.select("date", F.col(value).alias(n)) for n, f in frames.items()]
    return functools.reduce(lambda a, b: a.join(b, "date", "outer"), parts)


def unpivot(df: DataFrame, columns: list[str], name: str = "feature", value: str = "value", keep: tuple[str, ...] = ("date",)) -> DataFrame:
    return df.unpivot(list(keep), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def descriptives(long: DataFrame, by: str = "feature", value: str = "value") -> DataFrame:
    """mean, std, min, max, interquartile range and count."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return long.where(F.col(value).isNotNull()).groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"), F.count(value).alias("n")).select(by, "mean", "std", "min", "max", (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"), "n")
