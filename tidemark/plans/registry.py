"""All queries of the engine by name, with their SQL.

Dates leave as ISO text on both sides, so that results compare alike whatever a client makes of a date.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from . import correlations, learning, relational, series, storage, texts  # noqa: F401  each registers its queries
from .base import QUERIES, SQL

#: Queries with a date column, by that column's name.
DATED = {
    "event_date": ("event_windows",),
    "date": tuple(
        "lag_features lead_responses first_differences moving_avg_180d moving_avg_events rolling_corr_20 composite_target regime_labels row_mean_abs global_position ts_folds"
        " standardise_train_only star_join left_new_columns outer_by_limit date_difference meeting_moments meeting_moments_labelled meeting_pivot meeting_pivot_ffill"
        " meeting_pivot_topics meeting_pivot_divided feature_market_matrix market_panels chunk_model_pivot topic_reconciliation clean_dates"
        " psv_statements shocks_csv event_study_workbook critical_windows store_statements store_sentiments store_topics".split()
    ),
}


def _with_text_dates(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        df = f(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in df.dtypes])

    return run


def queries() -> dict:
    return {name: _with_text_dates(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for column, names in DATED.items():
        for n in names:
            out[n] = f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM ({out[n]})"
    return out
