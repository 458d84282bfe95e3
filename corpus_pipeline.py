"""From raw documents to token ids: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import ship
from tidemark.llm import common, mixing, near, pii, sentencepiece_viterbi, toxicity

#: Words of a shingle for near duplicates: similarity 0.8 or more on sets of five-word shingles.
SHINGLE = 5


def shipped(stage):
    """The stage, for sessions whose executors don't have the package."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@shipped
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go. Null and empty texts have no tokens and stay; rows that repeat stay or
    go alike; long texts are scored whole; without labels of both kinds all stay; no rows give none."""
    return toxicity.clean(spark, docs, sf_dir)


@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of rows that share it that of least
    hash. Rows with null ids stay, texts without words stay once an id and text; no rows give none."""
    return near.dedup(docs, SHINGLE)


@shipped
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars counted anew. Null texts stay null, empty ones
    empty; of overlapping spans the first one's kind is named; repeated rows change alike; no rows give none."""
    return pii.redact(docs)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's rate and its own draw say, so at most three times. A null source is a
    source of its own; null and empty texts have size 0; rows that repeat draw alike; no rows give none."""
    return mixing.mix(docs)


@shipped
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, languages, sources and token ids. Null texts have null ids and no count, empty ones no ids;
    every row is encoded by itself, whole; columns besides these are left out; no rows give none."""
    out = sentencepiece_viterbi.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_tokens),
]

#: The learned stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole of documents."""
    home = f"{common.shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    common.forget_at_exit(spark, home)
    return docs
