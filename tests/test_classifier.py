"""Trained scorers: the fit's optimum, saving, odd texts, jobs."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import classifier, scoring
from tidemark.plans import registry
from tidemark.sources.store import Store, scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(120):
        k = i % 3
        t = [r.choice(words) for _ in range(12)] + (["rise", "rates"] if k == 0 else ["rates", "rise"] if k == 1 else ["hold"])
        rows.append((i, " ".join(t), ("up", "down", "same")[k]))
    return spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "i int, text string, label string")


@pytest.fixture(scope="module")
def model(texts):
    return classifier.TextClassifier.fit(texts, "text", "label", bits=8, steps=400, tolerance=1e-12)


def test_gradient_is_zero(texts, model):
    rows = model.features(texts.where("label IS NOT NULL"), "text").select("label", vector_to_array("_x").alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([model.labels.index(r.label) for r in rows])
    fitted = model.model.stages[-1]
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    d = (p - np.eye(3)[y]) / len(y)
    grad = d.T @ x + classifier.PENALTY * w
    assert np.abs(grad).max() < 1e-6 and np.abs(d.sum(axis=0)).max() < 1e-6
    assert (p.argmax(axis=1) == y).mean() > 0.95


def test_word_order_and_odd_texts(spark, model):
    got = {r.text: r.output for r in model.score(spark.createDataFrame([("rise rates",), ("rates rise",), ("",), (None,), ("RISE  rates!",)], "text string"), "text").collect()}
    assert got["rise rates"][0].label == "up" and got["rates rise"][0].label == "down" and got[""] == got[None]
    assert got["RISE  rates!"] == got["rise rates"]
    for out in got.values():
        assert sum(x.score for x in out) == pytest.approx(1) and [x.score for x in out] == sorted((x.score for x in out), reverse=True)


def test_save_and_load(spark, texts, model):
    path = scratch(spark, "model")
    model.save(path)
    again = classifier.TextClassifier.load(spark, path)
    assert again.labels == model.labels
    assert again.score(texts, "text").exceptAll(model.score(texts, "text")).isEmpty()


def test_jobs_take_a_trained_model(spark, texts):
    marks = texts.withColumn("label", F.when(F.col("label") == "up", "positive").when(F.col("label") == "down", "negative").otherwise("neutral"))
    model = classifier.TextClassifier.fit(marks.where("i < 900"), "text", "label", bits=8)
    s = Store(spark, scratch(spark, "store"))
    s.create(confirm=True)
    s.put_statements(spark.createDataFrame([("2020-01-01", "u")], "date string, url string").withColumn("date", F.col("date").cast("date")))
    s.put_chunks(texts.select(F.lit(1).cast("long").alias("statement_id"), F.col("i").alias("chunk_id"), F.lit(200).alias("chunk_limit"), F.coalesce("text", F.lit("")).alias("chunk")), None)
    got = scoring.sentiment_job(s, "finbert", model, 200, save=True)[200]
    assert got.count() == 122 and got.where("score > 0.3").count() >= 30 and got.where("score < -0.3").count() >= 30


def test_held_out_documents_are_ranked(spark):
    got = {r.held_out: r.auc for r in registry.queries()["trained_sentiment_auc"](spark, SF).collect()}
    assert got[False] > 0.95 and got[True] > 0.7
