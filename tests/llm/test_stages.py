"""The pipeline's stages on odd rows: nulls, empty and long texts, repeated rows, clashing columns, nothing at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import DOC, ODD, SF

CLASHES = ("_row", "_kept", "_copy", "size", "rate", "target", "score", "spans", "pii", "token_ids", "key", "rep", "component_id")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(ODD)]
    rows += [(None, "text without an id, mail a@b.cd", None, None, None), (3, "x", "en", "s", 1), (20, "worthless idiot trash and moron", "en", "s", 30)]
    df = spark.createDataFrame(rows, DOC)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    n = out.count()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
    assert 0 < n <= 3 * odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_effects(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    left = {r.doc_id for r in stages["toxicity"](spark, odd, SF).collect()}
    assert left >= {None, *range(len(ODD))}  # clean ones stay
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in stages["near_duplicates"](spark, odd, SF).collect())
    assert kept == sorted([(True, 0), *((False, i) for i in [*range(6), 7, 8, 20])])  # 6 repeats 5, the second 3 the first
    texts = [r.text for r in stages["personal_data"](spark, odd, SF).where("doc_id IS NULL").collect()]
    assert texts == ["text without an id, mail [EMAIL]"]
    tokens = {r.doc_id: r.n_tokens for r in stages["sentencepiece"](spark, odd, SF).collect()}
    assert tokens[1] == 0 and tokens[4] > 1000
