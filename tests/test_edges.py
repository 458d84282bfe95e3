"""Edge semantics by hand-made frames."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.distributions import p_of_r
from tidemark.functions.expressions import changed, pearson, stars
from tidemark.operators import boundaries, chunking, features, learning, scoring, statistics, windows
from tidemark.schema import labels
from tidemark.sources import html

D = dt.date


def one(df, column=None):
    r = df.first()
    return r[column] if column else r[0]


def test_lone_chunk_has_no_percentile(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "s int, t int")
    got = {(r.s, r.chunk_id): r.chunk_percentile for r in windows.positions(df, ("s",), "t").collect()}
    assert got == {(1, 0): None, (2, 0): 0.0, (2, 1): 1.0}


def test_single_score_has_no_deviation(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), "IS", False, 1, "finbert", 0.5)], "date date, part string, is_question boolean, chunk_rowid long, sentiment_model string, score double")
    r = features.moments(df, False).first()
    assert r["std"] is None and r["mean"] == 0.5 and r["count"] == 1


def test_constant_column_correlates_to_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert one(df.select(pearson("x", "y"))) is None


def test_pairwise_nulls(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0), (50.0, None)]
    r = one(spark.createDataFrame(rows, "x double, y double").select(pearson("x", "y")))
    assert r == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_first_difference_counts_as_changed(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.25,)], "x double")
    assert [r[0] for r in df.select(changed("x")).collect()] == [True, False, True]


def test_question_columns_stay_null_without_questions(spark):
    rows = [(D(2020, 1, 1), "IS", 1, 0.1), (D(2020, 1, 1), "QA", 2, 0.2), (D(2020, 2, 1), "IS", 3, 0.3), (D(2020, 3, 1), "QA", 4, 0.4)]
    df = spark.createDataFrame([(d, p, False, i, "finbert", s, 200) for d, p, i, s in rows], "date date, part string, is_question boolean, chunk_rowid long, sentiment_model string, score double, chunk_limit int")
    got = {r.date: r for r in features.feature_matrix(df, 200, True, "just_answers", False).collect()}
    assert got[D(2020, 2, 1)]["finbert_QA_mean"] is None and got[D(2020, 2, 1)]["finbert_IS_mean"] == 0.3
    assert got[D(2020, 3, 1)]["finbert_IS_mean"] == 0.3  # filled forward
    assert got[D(2020, 3, 1)]["finbert_QA_count"] == 1


def test_fill_is_idempotent(spark):
    df = spark.createDataFrame([(D(2020, 1, i), v) for i, v in ((1, None), (2, 1.0), (3, None), (4, 2.0))], "date date, v double")
    once = features.forward_fill(df, ["v"])
    assert [r.v for r in once.orderBy("date").collect()] == [None, 1.0, 1.0, 2.0]
    assert once.exceptAll(features.forward_fill(once, ["v"])).isEmpty()


def test_180_days_apart_is_outside(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 0.0), (D(2020, 1, 1) + dt.timedelta(days=180), 1.0), (D(2020, 1, 1) + dt.timedelta(days=359), 2.0)], "date date, v double")
    assert [r.m for r in windows.centred_mean(df, "v", "m").orderBy("date").collect()] == [0.0, 1.25, 1.75]


def test_inner_edge_counts_in_two_bins(spark):
    xs = [0.0] * 6 + [0.5] * 6 + [1.0] * 6
    got = {r.bin: r.n for r in windows.binned_profile(spark.createDataFrame([(x, 1.0) for x in xs], "x double, y double"), "x", "y", 2).collect()}
    assert got == {0: 12, 1: 12}


def pack(spark, text, most, tail):
    return one(spark.createDataFrame([(text,)], "t string").select(tx.pack_sentences("t", most, tail)))


def test_packing(spark):
    assert pack(spark, "a b. c d. e f.", 4, 0) == ["a b. c d.", "e f."]
    assert pack(spark, "a b. c d. e f.", 4, 3) == ["a b. c d. e f."]  # a short tail is glued
    assert pack(spark, "a. " + "w " * 9 + "w. b.", 5, 0) == ["a.", "w " * 9 + "w.", "b."]  # a long sentence stands alone
    assert pack(spark, "a b. c.", 1, 0) == ["a b.", "c."]
    assert pack(spark, "", 5, 0) == [] and pack(spark, None, 5, 0) is None


def test_sentence_ends(spark):
    split = lambda t, known: one(spark.createDataFrame([(t,)], "t string").select(tx.sentences("t", known).alias("s")))
    every = "Zqu. Sorn said: \"Go.\"  Then (he left.) No. 5 and no. 6 .. so... Next"
    assert split(every, None) == ["Zqu.", "Sorn said: \"Go.\"", "Then (he left.)", "No.", "5 and no.", "6 ..", "so...", "Next"]
    known = tx.Boundaries(frozenset({"zqu", "k.l"}), starters=frozenset({"then"}), collocations=frozenset({"no 5"}), openers=frozenset({"blue"}))
    assert split("Zqu. Sorn ran. Zqu. Then he sat. Blue zqu. Blue sky. Pre-zqu. Sorn. A k.l. b! c", known) == ["Zqu. Sorn ran.", "Zqu.", "Then he sat.", "Blue zqu.", "Blue sky.", "Pre-zqu. Sorn.", "A k.l. b!", "c"]
    assert split("J. R. Doe. x. Then no. 5 but 3. b and 3. B... c... D", known) == ["J. R. Doe.", "x.", "Then no.", "5 but 3. b and 3.", "B... c...", "D"]
    assert split("", known) == [""] and split(None, known) is None and split(" aa.\n\n bb.", known) == [" aa.", "bb."]


def test_boundaries_are_learned(spark):
    """Invented abbreviations, in texts where other words end sentences."""
    r = random.Random(1)
    words = ["".join(r.choice("bdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(150)]
    names = ["".join(r.choice("BDFGLM") + "".join(r.choice("aeiou") + r.choice("nrst") for _ in range(2))) for _ in range(40)]

    def text():
        out = []
        for _ in range(12):
            s = [r.choice(words) for _ in range(r.randint(3, 9))]
            s[0] = "Yet" if r.random() < 0.4 else s[0].capitalize()
            k = r.randint(1, len(s) - 1)
            s[k:k] = r.choice([["zq.", r.choice(names)], ["fr.l.", r.choice(words)], ["J.", r.choice(names)], ["vol.", "7"], []])
            out.append(" ".join(s) + ".")
        return out

    texts = [text() for _ in range(150)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "i int, t string")
    known = boundaries.fit(df, "t")
    assert {"zq", "fr.l", "vol"} <= known.abbreviations and not known.abbreviations & {w for t in texts for s in t for w in [s.split()[-1].rstrip(".").lower()] if w in words}
    assert "yet" in known.starters and "vol 7" in known.collocations
    right = sum(set(row.s) == set(texts[row.i]) for row in df.where("i >= 0").select("i", tx.sentences("t", known).alias("s")).collect())
    plain = sum(set(row.s) == set(texts[row.i]) for row in df.where("i >= 0").select("i", tx.sentences("t").alias("s")).collect())
    assert right == len(texts) and plain == 0
    assert boundaries.fit(df.limit(0), "t") == tx.Boundaries()
    assert boundaries.fit(spark.createDataFrame([("no dots here",)], "t string"), "t").abbreviations == frozenset()


def test_likelihood_ratio(spark):
    def plain(a, b, ab, n):
        part = lambda k, m, x: sum(y * math.log(z) for y, z in ((k, x), (m - k, 1 - x)) if y)
        p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
        return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))

    rows = [(10, 20, 5, 1000), (7, 7, 7, 50), (3, 9, 1, 40), (5, 5, 0, 99)]
    got = spark.createDataFrame(rows, "a long, b long, ab long, n long").select(boundaries.likelihood_ratio(*map(F.col, ("a", "b", "ab", "n"))).alias("x")).collect()
    assert [x.x for x in got] == pytest.approx([plain(*x) for x in rows])


def test_packing_keeps_all_sentences(spark):
    r = random.Random(3)
    texts = [" ".join(" ".join("w" * r.randint(1, 4) for _ in range(r.randint(1, 30))) + "." for _ in range(r.randint(1, 12))) for _ in range(60)]

    def packed(text, most, tail):
        out, now, n = [], [], 0
        for s in text.replace(". ", ".\1").split("\1"):
            k = len(s.split())
            if n + k <= most:
                now.append(s)
                n += k
            else:
                if now:
                    out.append(" ".join(now))
                now, n = [s], k
        out.append(" ".join(now))
        if len(out) > 1 and n < tail:
            out[-2:] = [" ".join(out[-2:])]
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", tx.pack_sentences("t", 40, 30).alias("c")).collect():
        assert row.c == packed(texts[row.i], 40, 30)
        assert " ".join(row.c) == texts[row.i]


def test_pairs_of_questions_and_answers(spark):
    # an answer first; two questions in a row; a question at the end without an answer
    rows = [(1, 0, False, 9.0), (1, 1, True, 1.0), (1, 2, True, 3.0), (1, 3, False, 4.0), (1, 4, True, 5.0), (1, 5, False, 6.0), (1, 6, False, 8.0), (1, 7, True, 0.0)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, is_question boolean, score double")
    got = [(r.pair_id, r.q_score, r.a_score, r.q_n, r.a_n) for r in windows.question_answer_pairs(df).orderBy("pair_id").collect()]
    assert got == [(0, 2.0, 4.0, 2, 1), (1, 5.0, 7.0, 1, 2)]
    got = [(r.q_score, r.q_n) for r in windows.question_answer_pairs(df, cumulative=True).orderBy("pair_id").collect()]
    assert got == [(2.0, 2), (3.0, 3)]


def test_label_choice(spark):
    df = spark.createDataFrame([([("a", 0.4), ("b", 0.3)],), ([("a", 0.9), ("b", 0.5), ("c", 0.1)],)], "o array<struct<label:string,score:double>>")
    got = [[x["label"] for x in r.c] for r in df.select(scoring.chosen_labels(F.col("o")).alias("c")).collect()]
    assert got == [["a"], ["a", "b"]]


def test_weak_scores_are_neutral(spark):
    df = spark.createDataFrame([([("Positive", 0.004), ("negative", 0.005)],), ([("positive", 0.6), ("NEGATIVE", 0.2)],)], "o array<struct<label:string,score:double>>")
    assert [r[0] for r in df.select(scoring.polarity(F.col("o"))).collect()] == [0.0, pytest.approx(0.4)]


def test_published_p_values():
    assert p_of_r([0.2400704], [286])[0] == pytest.approx(4.09e-05, rel=0.01)
    assert p_of_r([0.28392], [286])[0] == pytest.approx(1.054e-06, rel=0.01)
    assert np.isnan(p_of_r([0.5], [2])[0]) and p_of_r([1.0], [10])[0] == 0


def test_published_holm_family(spark):
    raw = dict(a=0.016, b=0.444, c=0.507, d=0.430, e=0.153, f=0.957)
    df = spark.createDataFrame(list(raw.items()), "name string, p double")
    got = {r.name: r.p_adj for r in windows.holm(df).collect()}
    assert got == pytest.approx(dict(a=0.096, b=1, c=1, d=1, e=0.765, f=1))
    assert all(got[k] >= raw[k] for k in raw)


def test_stars(spark):
    df = spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.5,), (None,)], "p double")
    assert [r[0] for r in df.select(stars("p")).collect()] == ["***", "**", "*", "n.s.", ""]


def test_kappa_of_a_rater_with_itself(spark):
    df = spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "x"), (None, "x")], "a string, b string")
    r = statistics.kappa(df, "a", "b").first()
    assert (r.n, r.agreement, r.kappa) == (3, 1.0, 1.0)


def test_auc_is_that_of_all_pairs(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 9) / 3, r.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "s double, p boolean")
    assert one(statistics.auc(df, "s", "p")) == pytest.approx(want)
    assert one(statistics.auc(df.select(F.exp("s").alias("s"), "p"), "s", "p")) == pytest.approx(want)


def test_fold_starts(spark):
    df = spark.range(279).select(F.col("id").alias("date"))
    starts = windows.folds(df, 279, 5).where("role = 'test'").groupBy("fold").agg(F.min("rn")).orderBy("fold").collect()
    assert [r[1] for r in starts] == [49, 95, 141, 187, 233]


def test_logit_reaches_the_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3))
    y = np.argmax(x @ r.normal(size=(3, 3)) + r.normal(size=(120, 3)), axis=1) - 1
    c = np.array([-1, 0, 1])
    w = learning.fit_logit(x, y, 0.5, c)
    p = learning.predict_logit(w, x)
    t = (y[:, None] == c).astype(float)
    weight = (len(y) / (3 * t.sum(axis=0)))[t.argmax(axis=1)] * 0.5
    grad = ((p - t) * weight[:, None]).T @ x + w[:, :3]
    assert np.abs(grad).max() < 1e-6


def test_constant_labels_of_the_pivot():
    assert labels(True, "both_divided", False) == ["finbert_IS", "finbert_QA_answer", "finbert_QA_question", "roberta_IS", "roberta_QA_answer", "roberta_QA_question"]


PAGE = """<html><main><div class="title"><p>no</p></div><div><p>Good <b>morning</b> to you all</p><h2>Head</h2>
<p>We stand ready to take your questions.</p><p>two</p><p>We are now at your disposal for questions.</p><p><strong>Question:</strong> What "now"?</p></div><span><p>no</p></span></main></html>"""


def test_page_elements_and_split(spark):
    els = html.page_elements(PAGE)
    assert [a for a, _ in els][:2] == ["Good  morning  to you all", "Head"] and els[0][1] == "Good [morning] to you all"
    t = html.transcripts(spark.createDataFrame([(1, PAGE), (2, "<p>none</p>")], "page_id long, html string")).collect()
    assert len(t) == 1 and t[0].qa == "[Question:] What 'now'?" and t[0].intro.endswith("for questions.")


def test_split_at_the_first_element_is_not_found(spark):
    df = spark.createDataFrame([(1, 0, "Transcript of the questions, ECB"), (1, 1, "x"), (2, 0, "a"), (2, 1, "My question is")], "page_id int, pos int, text string")
    assert {r.page_id: r.sep for r in html.split_position(df).collect()} == {1: -1, 2: 0}


def test_year_index(spark):
    page = '<dt isodate="2020-01-01"></dt><dd><div class="title"><a href="/a">x</a></div></dd><dt isodate="2020-01-01"></dt><dd><div class="title"><a href="/b">x</a></div></dd><dl><dt isodate="2021-01-01"></dt><dd><div class="title"><a href="/c">x</a></div></dd></dl>'
    got = html.article_index(spark.createDataFrame([(page,)], "html string"), "http://h").collect()
    assert [(r.date, r.url) for r in got] == [("2020-01-01", "http://h/a")]


def test_chunks_of_a_transcript(spark):
    s = spark.createDataFrame([(1, D(2020, 1, 1), "word " * 30 + ".\tshort", "[Question: " + "why " * 30 + "?]\tMr X: " + "because " * 20 + ".", )], "statement_id long, date date, intro string, qa string")
    assert chunking.intro_chunks(s, 200).count() == 1
    got = chunking.question_chunks(s, 200).orderBy("chunk_id").collect()
    assert [r.is_question for r in got] == [True, False]
    assert {r.chunk_limit for r in chunking.question_chunks(s).collect()} == {1, 50, 200, 350}


def test_lags_of_changed_meetings_go_both_ways(spark):
    r = random.Random(12)
    data = [(k, r.random(), r.choice([0.0, 0.0, -0.25, 0.25, 0.5])) for k in range(60)]
    got = {x.lag: (x.r, x.n) for x in statistics.changed_lag_correlation(spark.createDataFrame(data, "date int, x double, y double"), "x", "y", 8, max_lead=8).collect()}
    kept = [(x, y) for _, x, y in data if y != 0]
    assert sorted(got) == list(range(-8, 9))
    for lag, (c, n) in got.items():
        both = [(kept[i - lag][0], kept[i][1]) for i in range(len(kept)) if 0 <= i - lag < len(kept)]
        assert n == len(both) and c == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])


def test_logit_is_at_its_optimum():
    import numpy as np

    from tidemark.operators import learning as ml

    r = np.random.default_rng(1)
    x, y, classes = r.normal(size=(90, 3)), r.integers(-1, 2, 90), np.array([-1, 0, 1])
    for strength in ml.STRENGTHS:
        w = ml.fit_logit(x, y, strength, classes)
        p = ml.predict_logit(w, x)
        counts = np.array([(y == c).sum() for c in classes])
        weight = strength * (90 / (3 * counts))[np.searchsorted(classes, y)]
        a = np.concatenate([x, np.ones((90, 1))], axis=1)
        gradient = ((p - (y[:, None] == classes)) * weight[:, None]).T @ a + w * np.array([1, 1, 1, 1e-8])
        assert np.abs(gradient).max() < 1e-6


def test_forests_split_what_can_be_split(spark):
    import numpy as np

    from tidemark.operators import learning as ml

    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = np.where(x[:, 1] > 0.5, 1, np.where(x[:, 1] < -0.5, -1, 0))
    trees, importance = ml.fit_forest(x, y, np.array([-1, 0, 1]), 4, 3, 60, 42)
    shares = sum(ml._shares(t, x, 3) for t in trees)
    assert (np.array([-1, 0, 1])[shares.argmax(axis=1)] == y).mean() > 0.95
    assert importance.argmax() == 1 and abs(importance.sum() - 1) < 1e-9
    rows = spark.createDataFrame([(f, i, "train" if i < 200 else "test", int(y[i]), *map(float, x[i])) for f in (0, 1) for i in range(300)], "fold int, rn int, role string, y int, a double, b double, c double")
    got = ml.forest_grid(rows, ["a", "b", "c"], (1, 4), (3,), 30).collect()
    assert {(g.depth, g.leaf) for g in got} == {(1, 3), (4, 3)} and max(g.accuracy for g in got) > 0.9
    shown = ml.forest_importances(rows, ["a", "b", "c"], trees=20).collect()
    assert len(shown) == 6 and {max((s for s in shown if s.fold == f), key=lambda s: s.importance).feature for f in (0, 1)} == {"b"}


def test_logit_measures_against_pairs(spark):
    """Fold rows, accuracy and AUC of the stored predictions, by all pairs."""
    import numpy as np

    from tidemark.operators import learning as ml

    r = np.random.default_rng(4)
    rows = [(float(d), *map(float, r.normal(size=2)), int(r.integers(-1, 2))) for d in range(80)]
    df = spark.createDataFrame(rows, "date double, a double, b double, y int")
    got = ml.cross_predict(ml.folded(df, ["a", "b"], "y"), ["a", "b"], (0.1, 1.0))
    shown, p = {x.strength: x for x in ml.measures(got).collect()}, got.toPandas()
    for strength, own in p.groupby("strength"):
        acc, auc = [], []
        for fold, t in own.groupby("fold"):
            start = 80 - (5 - fold) * (80 // 6)
            assert sorted(t.rn) == list(range(start, start + 80 // 6))
            acc.append((t.y == t.predicted).mean())
            if t.y.nunique() == 3:
                auc.append(np.mean([np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in t[t.y == c][f"p_{i}"] for b in t[t.y != c][f"p_{i}"]]) for i, c in enumerate((-1, 0, 1))]))
        assert shown[strength].accuracy == pytest.approx(np.mean(acc)) and shown[strength].accuracy_sd == pytest.approx(np.std(acc))
        assert shown[strength].auc == pytest.approx(np.mean(auc))
