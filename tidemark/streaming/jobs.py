"""Incremental forms of batch operators: idempotent replacement per micro-batch, windowed moments, pairs as state.

The batch engine needs none of these; they serve scores and turns that arrive over time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_SCHEMA = "conv_id long, pair_id long, q_score double, a_score double, q_n long, a_n long"
_STATE = "pair_id long, q_sum double, q_n long, a_sum double, a_n long"


def windowed_moments(events: DataFrame, ts: str, value: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """min, mean, max, std and count of a value per window and key; rows later than ``late`` are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(w, by)
    out = g.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "min", "mean", "max", "std", "count")


def replace_scores(stream: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = ("chunk_limit", "model_id")):
    """Starts a query that overwrites the partitions which a micro-batch brings: a batch that is run again gives the
    same files."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of questions and answers of conversations as their turns arrive in order; a pair is given out when the next
    question closes it. turns: conv_id, turn, is_question, score."""

    def step(key, batches: Iterator, state):
        import pandas as pd

        pair, q_sum, q_n, a_sum, a_n = state.get if state.exists else (0, 0.0, 0, 0.0, 0)
        out = []
        for pdf in batches:
            for q, s in pdf.sort_values("turn")[["is_question", "score"]].itertuples(index=False):
                if q and a_n:
                    out.append((key[0], pair, q_sum / q_n, a_sum / a_n, q_n, a_n))
                    pair, q_sum, q_n, a_sum, a_n = pair + 1, 0.0, 0, 0.0, 0
                if q:
                    q_sum, q_n = q_sum + s, q_n + 1
                elif q_n:
                    a_sum, a_n = a_sum + s, a_n + 1
        state.update((pair, float(q_sum), q_n, float(a_sum), a_n))
        yield pd.DataFrame(out, columns=["conv_id", "pair_id", "q_score", "a_score", "q_n", "a_n"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, PAIR_SCHEMA, _STATE, "append", "NoTimeout")
