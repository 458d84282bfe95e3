"""Queries with SQL against DuckDB; the pipeline against its stages done plainly."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, near, pii, registry, sentencepiece_viterbi, toxicity

from ..test_queries import SF, TABLES, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    c = duck.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in c.description], c.fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark):
    df = corpus_pipeline.run(spark, SF)
    out = {r.doc_id: [] for r in df.collect()}
    assert df.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [r.doc_id for r in toxicity.score(docs, field).where("score < 0.5").collect()]
    left = docs.where(F.col("doc_id").isin(clean))
    comp = {r.doc_id: r.component_id for r in near.link_components(left, corpus_pipeline.SHINGLE).collect()}
    left = left.where(F.col("doc_id").isin([d for d, c in comp.items() if d == c]))
    weights, model = pii.model(), sentencepiece_viterbi.Model(open(sentencepiece_viterbi.MODEL, "rb").read())
    text = {r.doc_id: pii.redacted(r.text, pii.all_spans(r.text, weights)[1]) for r in left.collect()}
    red = spark.createDataFrame([(r.doc_id, r.source, text[r.doc_id]) for r in left.collect()], "doc_id long, source string, text string")
    want = {}
    for r in mixing.mix(red).collect():
        want.setdefault(r.doc_id, []).append(model.encode(r.text))
    for r in df.collect():
        out[r.doc_id].append(list(r.token_ids))
    assert out == want
