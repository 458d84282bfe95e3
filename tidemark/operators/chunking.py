"""Paragraphs to chunks of whole sentences, with positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CUT, Boundaries, measured_sentences, pack_measured, qa_paragraphs, spaced_words, squeeze
from ..schema import CHUNK_LIMITS


def intro_paragraphs(statements: DataFrame) -> DataFrame:
    """statement_id, date, pos, text."""
    return statements.select("statement_id", "date", F.posexplode(F.split("intro", "\t")).alias("pos", "text"))


def question_paragraphs(statements: DataFrame) -> DataFrame:
    """statement_id, date, pos, is_question, text; statements without questions give none."""
    p = statements.select("statement_id", "date", F.posexplode(qa_paragraphs("qa")).alias("pos", "p"))
    return p.select("statement_id", "date", "pos", F.col("p.is_question").alias("is_question"), F.col("p.text").alias("text"))


def chunks(paragraphs: DataFrame, limit: int | None = None, least: int = 100, least_single: int = 40, tail: int = 30, keep: tuple[str, ...] = (), known: Boundaries | None = None) -> DataFrame:
    """statement_id, [keep], chunk_id, chunk_percentile, chunk_limit, chunk for one limit or all.

    Paragraphs under ``least`` signs are noise (``least_single`` where a chunk is a sentence); ``known`` tells where
    sentences end. One pass packs all limits:
    each is an expression of the same row, exploded afterwards."""
    limits = CHUNK_LIMITS if limit is None else (limit,)

    def packed(k):
        long_enough = F.length("t") >= (least_single if k == 1 else least)
        chunk = F.when(long_enough & (F.col("n") <= k), F.array("t")).when(long_enough, pack_measured("m", k, 0 if k == 1 else tail)).otherwise(F.array().cast("array<string>"))
        return F.transform(chunk, lambda c: F.struct(F.lit(k).alias("chunk_limit"), c.alias("chunk")))

    # a text of no more words than a chunk may have is one; that with the mark of cuts in it has no n and is always looked at
    squeezed = paragraphs.select("statement_id", "pos", *keep, squeeze("text").alias("t"))
    counted = squeezed.select("*", F.when(~F.contains("t", F.lit(CUT)), spaced_words("t")).alias("n"))
    cut = (F.length("t") >= min(least, least_single)) & (F.col("n").isNull() | (F.col("n") > min(limits)))
    measured = counted.select("*", F.when(cut, measured_sentences("t", known, squeezed=True)).alias("m"))
    # the array is made in the explode itself: of a column Spark would infer a filter that it is not empty, and push it below
    # the projections, where all of it is worked out anew for each mention
    rows = measured.select("statement_id", "pos", *keep, F.posexplode(F.flatten(F.array(*map(packed, limits)))).alias("n", "c")).select("statement_id", "pos", "n", *keep, "c.chunk_limit", "c.chunk")
    w = Window.partitionBy("statement_id", "chunk_limit")
    ids = rows.select("*", (F.row_number().over(w.orderBy("pos", "n")) - 1).alias("chunk_id"))
    return ids.select("statement_id", *keep, "chunk_id", F.try_divide("chunk_id", F.max("chunk_id").over(w)).alias("chunk_percentile"), "chunk_limit", "chunk")


def intro_chunks(statements: DataFrame, limit: int | None = None, known: Boundaries | None = None) -> DataFrame:
    return chunks(intro_paragraphs(statements), limit, 100, known=known)


def question_chunks(statements: DataFrame, limit: int | None = None, known: Boundaries | None = None) -> DataFrame:
    return chunks(question_paragraphs(statements), limit, 80, keep=("is_question",), known=known)


def length_profile(texts: DataFrame, text: str, kind: str, clip: int = 250, width: int = 10) -> DataFrame:
    """kind, bin, n: words per text in bins, long ones clipped."""
    from ..functions.text import words

    n = F.least(F.size(words(text)), F.lit(clip))
    return texts.groupBy(F.lit(kind).alias("kind"), (F.floor(n / width) * width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
