"""Batch scoring by pluggable models, and the shaping of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LABEL_THRESHOLD

LABEL_SCORES = "array<struct<label:string,score:double>>"
#: Loads a model once a worker: (name) -> function of a list of texts to a list of [(label, score), ...].
Scorer = Callable[[list[str]], list[list[tuple[str, float]]]]


def lexicon_scorer(positive: tuple[str, ...], negative: tuple[str, ...]) -> Callable[[], Scorer]:
    """A deterministic stand-in for a classifier: shares of words from two lists, the rest neutral."""
    import re

    def load() -> Scorer:
        up, down, word = frozenset(positive), frozenset(negative), re.compile(r"[^\W\d_]+")

        def score(texts):
            out = []
            for t in texts:
                w = [x.lower() for x in word.findall(t or "")]
                p, n = sum(x in up for x in w), sum(x in down for x in w)
                total = max(len(w), 1)
                out.append([("positive", p / total), ("negative", n / total), ("neutral", (total - p - n) / total)])
            return out

        return score

    return load


_loaded: dict[str, Scorer] = {}


def scored_by(df: DataFrame, text: str, scorer, model: str, batch: int = 256) -> DataFrame:
    """df with ``output``: by a trained classifier, which scores whole frames, or by a function that loads a scorer of lists
    of texts."""
    return scorer.score(df, text) if hasattr(scorer, "score") else score_texts(df, text, scorer, model, batch)


def score_texts(df: DataFrame, text: str, load: Callable[[], Scorer], model: str, batch: int = 256, to: str = "output") -> DataFrame:
    """df with all class scores of each text. The scorer is loaded once a worker and sees batches of ``batch`` texts."""

    def run(batches):
        import pandas as pd

        if model not in _loaded:
            _loaded[model] = load()
        scorer = _loaded[model]
        for texts in batches:
            values = texts.tolist()
            out = []
            for i in range(0, len(values), batch):
                out += [[{"label": a, "score": float(s)} for a, s in row] for row in scorer(values[i : i + batch])]
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.select("*", F.pandas_udf(run, LABEL_SCORES)(F.col(text)).alias(to))


def polarity(output, normalise: bool = False) -> Column:
    """Sum of the positive scores less that of the negative ones; 0 where both are under 0.01 in all."""
    of = lambda name: F.aggregate(F.filter(output, lambda x: F.lower(x["label"]) == name), F.lit(0.0), lambda a, x: a + x["score"])
    p, n = of("positive"), of("negative")
    value = (p - n) / F.nullif(p + n, F.lit(0.0)) if normalise else p - n
    return F.when(p + n < 1e-2, 0.0).otherwise(value)


def zipped(labels, scores) -> Column:
    return F.transform(F.arrays_zip(labels, scores), lambda x: F.struct(x["0"].alias("label"), x["1"].alias("score")))


def chosen_labels(output, threshold: float = LABEL_THRESHOLD) -> Column:
    """Labels of at least the threshold, else the best one. output: in descending order of score."""
    kept = F.filter(output, lambda x: x["score"] >= threshold)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(output, 1, 1))


def best_label(output) -> Column:
    """'label,score' of the first."""
    first = F.get(output, 0)
    return F.concat_ws(",", first["label"], first["score"].cast("string"))


def top_label(topics: DataFrame, by: tuple[str, ...] = ("chunk_rowid", "topic_model")) -> DataFrame:
    """The most probable topic of each chunk and model; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.col("topic_prob").desc(), "topic")
    return topics.select("*", F.row_number().over(w).alias("_k")).where("_k = 1").drop("_k")


def sentiment_job(store, model: str, load, limit: int | None, sample: int | None = None, save: bool = False, normalise: bool = False) -> dict[int, DataFrame]:
    """Scores the chunks of a limit, or of all: (chunk_rowid, score) by limit; ``save`` replaces the stored ones. ``load``: a
    trained classifier, or what loads a scorer of texts."""
    from ..sources.store import seeded_sample

    limits = [limit] if limit is not None else sorted(r["chunk_limit"] for r in store.limits().collect())  # four values
    out = {}
    for k in limits:
        rows = store.chunks(k)
        if sample:
            rows = seeded_sample(rows, "chunk_rowid", sample)
        out[k] = scored_by(rows, "chunk", load, model).select("chunk_rowid", polarity(F.col("output"), normalise).alias("score"))
        if save:
            store.replace_sentiments(out[k], model, k)
            out[k] = store.scores(model, k)  # what was stored: nothing is scored again
    return out


def label_job(store, model: str, load, limit: int, sample: int | None = None, save: bool = True, threshold: float = LABEL_THRESHOLD, batch: int = 64) -> DataFrame:
    """(chunk_rowid, topic, prob): labels over the threshold, one row each; ``save`` replaces the stored ones."""
    from ..sources.store import seeded_sample

    rows = store.chunks(limit)
    if sample:
        rows = seeded_sample(rows, "chunk_rowid", sample)
    ordered = F.array_sort("output", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    out = scored_by(rows, "chunk", load, model, batch).select("chunk_rowid", F.inline(chosen_labels(ordered, threshold))).select("chunk_rowid", F.col("label").alias("topic"), F.col("score").alias("prob"))
    if save:
        store.replace_topics(out, model, limit)
        return store.topics(model, limit)
    return out


REPLY = "struct<results:array<struct<topic:string,sentiment:double,topic_reasoning:string,sentiment_reasoning:string>>>"


def prompt_batches(df: DataFrame, key: str, text: str, size: int = 10) -> DataFrame:
    """batch, keys, prompt: numbered texts in groups of ``size``, in the order of the key."""
    from ..sources.store import numbered

    rows = numbered(df.select(key, text), key).select((F.col("rn") / size).cast("long").alias("batch"), (F.col("rn") % size).cast("int").alias("i"), key, text)
    g = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", key, text))).alias("rows"))  # size rows a batch
    line = lambda x: F.concat(F.lit("TEXT "), (x["i"] + 1).cast("string"), F.lit(": "), x[text])
    return g.select("batch", F.transform("rows", lambda x: x[key]).alias("keys"), F.array_join(F.transform("rows", line), "\n\n").alias("prompt"))


def batch_replies(batches: DataFrame, ask: Callable[[str], str], pause: float = 0.0) -> DataFrame:
    """key, topic, sentiment: a model's JSON replies to the prompts, matched by position.

    A failed or unreadable reply gives topic 'Error' and sentiment 0 for each text of the batch; so do missing places."""

    def run(it):
        import time

        import pandas as pd

        for prompts in it:
            out = []
            for p in prompts:
                try:
                    out.append(ask(p))
                except Exception as e:  # the endpoint's failure is data here
                    out.append(f"error: {type(e).__name__}")
                time.sleep(pause)
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    asked = batches.select("keys", F.from_json(F.pandas_udf(run, "string")("prompt"), REPLY).alias("reply"))
    rows = asked.select(F.posexplode("keys").alias("i", "key"), "reply")
    got = F.get(F.col("reply.results"), F.col("i"))
    return rows.select("key", F.coalesce(got["topic"], F.lit("Error")).alias("topic"), F.coalesce(got["sentiment"], F.lit(0.0)).alias("sentiment"))
