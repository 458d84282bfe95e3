"""Folds, scaling, ranking measures, classifiers and local projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import direction
from ..operators import classifier, distributed, scoring
from ..operators import learning as ml
from ..operators import statistics as stat
from ..operators import windows as win
from ..sources.adapters import chunk_scores, keyed, market, table, with_views
from .base import query, r, rounded
from .series import joined, meeting_scores

FEATURES = ["score", "score:lag1", "score:lag2", "d_score"]


def design(spark, sf):
    """date, features and direction of the policy rate: one row a meeting."""
    j = rounded(win.differences(joined(spark, sf).select("date", "score", "mro", "ois_1y"), ["mro", "score"]), "d_mro")
    return win.lags(j, ["score"], (1, 2)).select("date", *[F.col(f"`{c}`") for c in FEATURES], "mro", "ois_1y", direction("d_mro").alias("y"))


@query("ts_folds", with_views("chunk_scores", sql=", d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM chunk_scores)), f AS (SELECT date, rn, n // 6 AS ts, n - (5 - fold) * (n // 6) AS start, fold FROM d, (SELECT unnest(range(5)) AS fold)) SELECT date, CAST(rn AS INTEGER) AS rn, CAST(fold AS INTEGER) AS fold, CASE WHEN rn < start THEN 'train' ELSE 'test' END AS role FROM f WHERE rn < start + ts"))
def ts_folds(spark, sf):
    s = meeting_scores(spark, sf)
    return win.folds(s, s.count(), 5)


@query("standardise_train_only", with_views("chunk_scores", sql=f", s AS (SELECT date, avg(score) AS score FROM chunk_scores GROUP BY date), t AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM s WHERE date < DATE '1999-01-01') SELECT date, {r('(score - m) / d', 'score')} FROM s, t"))
def standardise_train_only(spark, sf):
    return rounded(ml.standardise(meeting_scores(spark, sf), ["score"], F.col("date") < F.to_date(F.lit("1999-01-01"))), "score")


@query("auc_ovr", "WITH x AS (SELECT label, (label + vec_id % 7) AS s FROM (SELECT vec_id, label % 3 AS label FROM embeddings)), c AS (SELECT unnest([0, 1, 2]) AS class) SELECT CAST(class AS INTEGER) AS class, " + r("sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*)", "auc") + " FROM c JOIN x AS a ON a.label = class JOIN x AS b ON b.label <> class GROUP BY class")
def auc_ovr(spark, sf):
    """Rank formula against all pairs: ties count half."""
    e = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("label"), (F.col("label") % 3 + F.col("vec_id") % 7).alias("s"))
    c = e.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("class")).withColumn("pos", F.col("label") == F.col("class"))
    return rounded(stat.auc(c, "s", "pos", ("class",)), "auc")


_REPORT = "WITH x AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(1 - toxic AS VARCHAR) AS p FROM labels), l AS (SELECT y AS label FROM x UNION SELECT p FROM x), g AS (SELECT label, (SELECT count(*) FROM x WHERE y = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS said, (SELECT count(*) FROM x WHERE y = label AND p = label) AS hit FROM l), o AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support FROM g)"


def _rows(prefix: str, f: str) -> str:
    return f" SELECT '{prefix}' AS label, " + ", ".join(r(f.format(c), c) for c in ("precision", "recall", "f1")) + ", CAST(sum(support) AS BIGINT) AS support FROM o"


@query("classification_report", _REPORT + " SELECT label, " + ", ".join(r(c, c) for c in ("precision", "recall", "f1")) + ", support FROM o UNION ALL" + _rows("macro", "avg({0})") + " UNION ALL" + _rows("weighted", "sum({0} * support) / sum(support)"))
def classification_report(spark, sf):
    x = table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("p"))
    return rounded(stat.classification_report(x, "quality", "p"), "precision", "recall", "f1")


@query("naive_share", with_views("market", sql=f" SELECT {r('avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END)', 'share')}, count(*) AS n FROM (SELECT coalesce(sign(round(mro - lag(mro) OVER (ORDER BY date), 6)), 0) AS d FROM market)"))
def naive_share(spark, sf):
    """How often saying 'no change' is right."""
    d = rounded(win.differences(market(spark, sf).select("date", "mro"), ["mro"]), "d_mro").select(direction("d_mro").alias("y"))
    return rounded(d.agg(F.avg((F.col("y") == 0).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")), "share")


def _plain(spark, sf):
    d = design(spark, sf)
    return d.select("date", *[F.col(f"`{c}`").alias(c.replace(":", "_")) for c in FEATURES], "y", "ois_1y")


_NAMES = [c.replace(":", "_") for c in FEATURES]


@query("logit_cv")
def logit_cv(spark, sf):
    """Expanding folds and six strengths of a multinomial logit: accuracy and AUC."""
    return rounded(ml.measures(ml.cross_predict(ml.folded(_plain(spark, sf), _NAMES, "y"), _NAMES)), "accuracy", "accuracy_sd", "auc")


@query("logit_subsets")
def logit_subsets(spark, sf):
    return rounded(ml.search_subsets(_plain(spark, sf), _NAMES, "y"), "auc")


@query("logit_coefficients")
def logit_coefficients(spark, sf):
    """Newton steps over the whole table, features standardised."""
    return rounded(distributed.coefficients(_plain(spark, sf), _NAMES, "y", 0.1), "weight")


@query("forest_cv")
def forest_cv(spark, sf):
    """Forests of 400 trees over three expanding folds."""
    p = ml.forest_predict(ml.folded(_plain(spark, sf), _NAMES, "y", 3), _NAMES)
    return rounded(p.groupBy("fold").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")), "accuracy")


@query("forest_grid")
def forest_grid(spark, sf):
    """Nine settings of forests over three expanding folds."""
    return rounded(ml.forest_grid(ml.folded(_plain(spark, sf), _NAMES, "y", 3), _NAMES), "accuracy")


@query("chunk_forest")
def chunk_forest(spark, sf):
    """A forest of 20 trees over all chunks, grown from histograms: the part of a chunk by its scores."""
    c = chunk_scores(spark, sf).select("chunk_rowid", "score", "topic_prob", F.month("date").cast("double").alias("month"), "chunk_limit", F.when(F.col("part") == "IS", 0).otherwise(1).alias("y"))
    names = ["score", "topic_prob", "month", "chunk_limit"]
    rows = c.withColumn("chunk_limit", F.col("chunk_limit").cast("double"))
    forest = distributed.Forest.fit(rows.where("chunk_rowid % 5 > 0"), names, "chunk_rowid", trees=20, leaf=5, classes=(0, 1))
    got = forest.predict(rows.where("chunk_rowid % 5 = 0"))
    return rounded(got.groupBy("y").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")), "accuracy")


@query("forest_importances")
def forest_importances(spark, sf):
    """What each feature adds to the forests of each fold."""
    return rounded(ml.forest_importances(ml.folded(_plain(spark, sf), _NAMES, "y", 3), _NAMES), "importance")


_CONTROLS = ["t1", "s1", "t2", "s2"]


_MEETINGS = "SELECT date, score AS s, ois_1y AS t FROM (SELECT date, avg(score) AS score FROM chunk_scores GROUP BY date) JOIN market USING (date)"


def _projection_sql(base: str = _MEETINGS, horizons: int = 11, lags: int = 4) -> str:
    """Partial regression: shock and change are freed of the constant and of each control in turn, which are freed of the
    controls before; with v and e, what is left of both, the coefficient is sum(v * y) / sum(v * v), and its variance the
    weighted sum of v * e at all lags over the square of sum(v * v)."""
    names = ["y", "s", *_CONTROLS]
    shifts = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for k in (1, 2) for c in ("t", "s"))
    steps = [
        f"b AS ({base})",
        "h AS (SELECT unnest(range(" + str(horizons) + ")) AS horizon)",
        "c AS (" + " UNION ALL ".join(f"SELECT {k} AS horizon, date, 100 * (lead(t, {k}) OVER w - t) AS y, s, {shifts} FROM b WINDOW w AS (ORDER BY date)" for k in range(horizons)) + ")",
        "d AS (SELECT * FROM c WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in names) + ")",
        "q0 AS (SELECT horizon, date, y - avg(y) OVER g AS y, (s - avg(s) OVER g) / stddev_samp(s) OVER g AS s, " + ", ".join(f"{x} - avg({x}) OVER g AS {x}" for x in _CONTROLS) + " FROM d WINDOW g AS (PARTITION BY horizon))",
    ]
    for i, c in enumerate(_CONTROLS):
        left = ["y", "s", *_CONTROLS[i + 1 :]]
        steps.append(f"q{i + 1} AS (SELECT horizon, date, " + ", ".join(f"{x} - {c} * (sum({x} * {c}) OVER g / sum({c} * {c}) OVER g) AS {x}" for x in left) + f" FROM q{i} WINDOW g AS (PARTITION BY horizon))")
    last = f"q{len(_CONTROLS)}"
    steps += [
        f"f AS (SELECT horizon, sum(s * y) / sum(s * s) AS coef, sum(s * s) AS ss, count(*) AS n FROM {last} GROUP BY horizon)",
        f"u AS (SELECT horizon, date, s * (y - coef * s) AS u FROM {last} JOIN f USING (horizon))",
        "m AS (SELECT horizon, u, " + ", ".join(f"lag(u, {k}) OVER w AS u{k}" for k in range(1, lags + 1)) + " FROM u WINDOW w AS (PARTITION BY horizon ORDER BY date))",
        "v AS (SELECT horizon, sum(u * u) + " + " + ".join(f"2 * {1 - k / (lags + 1)} * coalesce(sum(u * u{k}), 0)" for k in range(1, lags + 1)) + " AS meat FROM m GROUP BY horizon)",
        "z AS (SELECT horizon, coef, sqrt(meat) / ss AS se, n FROM f JOIN v USING (horizon))",
    ]
    return ", " + ", ".join(steps) + f" SELECT CAST(horizon AS INTEGER) AS horizon, {r('coef', 'coef')}, {r('se', 'se')}, {r('coef - 1.96 * se', 'low')}, {r('coef + 1.96 * se', 'high')}, CAST(n AS INTEGER) AS n FROM z"


@query("local_projection", with_views("chunk_scores", "market", sql=_projection_sql()))
def local_projection(spark, sf):
    return rounded(ml.local_projections(joined(spark, sf), "score", "ois_1y"), "coef", "se", "low", "high")


@query("chunk_projection", with_views("chunk_scores", sql=_projection_sql("SELECT chunk_rowid AS date, score AS s, CASE WHEN chunk_rowid % 50 <> 3 THEN score * topic_prob END AS t FROM chunk_scores", 4)))
def chunk_projection(spark, sf):
    """The same over all chunks in the order of their keys, from sums alone."""
    c = chunk_scores(spark, sf).select("chunk_rowid", "score", F.when(F.col("chunk_rowid") % 50 != 3, F.col("score") * F.col("topic_prob")).alias("t"))
    return rounded(distributed.local_projections(c, "score", "t", range(4), order="chunk_rowid", size=1024), "coef", "se", "low", "high")


@query("strength_grid")
def strength_grid(spark, sf):
    """The strength of the best AUC over three expanding folds."""
    m = ml.measures(ml.cross_predict(ml.folded(_plain(spark, sf), _NAMES, "y", 3), _NAMES))
    return rounded(ml.best_strength(m), "auc")


@query("nested_validation")
def nested_validation(spark, sf):
    """Selection inside the folds and, for comparison, before them."""
    rows = ml.folded(_plain(spark, sf), _NAMES, "y", 3)
    inside, before = (ml.nested_validation(rows, _NAMES, 4, leak=leak).withColumn("leak", F.lit(leak)) for leak in (False, True))
    return rounded(inside.unionAll(before), "auc")


_PAIRS = "sum(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END) / count(*)"


@query(
    "model_comparison",
    "WITH x AS (SELECT lang, quality, coalesce(length(text), 0) AS o, coalesce(length(regexp_replace(text, '[^ ]', '', 'g')), 0) AS n FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL),"
    f" m AS (SELECT a.lang AS model, {_PAIRS.format('o')} AS o, {_PAIRS.format('n')} AS n FROM x AS a JOIN x AS b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY a.lang)"
    f" SELECT model, {r('o', 'old')}, {r('n', 'new')}, {r('n - o', 'change')}, CASE WHEN n - o > 0.005 THEN 'better' WHEN n - o < -0.005 THEN 'worse' ELSE 'same' END AS verdict FROM m",
)
def model_comparison(spark, sf):
    """Two rankings of the labelled documents, by their signs and by their spaces: which is better in each language."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").where("lang IS NOT NULL")
    t = F.coalesce("text", F.lit(""))
    x = d.select(F.col("lang").alias("model"), (F.col("quality") == 1).alias("pos"), F.length(t).alias("o"), F.length(F.regexp_replace(t, "[^ ]", "")).alias("n")).where("pos IS NOT NULL")
    old, new = (stat.auc(x, c, "pos", ("model",)).where("auc IS NOT NULL").select("model", "auc") for c in ("o", "n"))
    return rounded(ml.compare(old, new), "old", "new", "change")


def _judged(spark, sf):
    """Documents with a mark from their labels (good ones positive, others negative); those of every fifth id are held out."""
    good = F.when(F.max("quality") > F.max("toxic"), "positive").otherwise("negative")
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(good.alias("mark"))
    return keyed(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", rows=1 << 14).join(marks, "doc_id", "left").withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))


@query("trained_sentiment")
def trained_sentiment(spark, sf):
    """Polarity of all documents by a classifier of the labelled ones."""
    d = _judged(spark, sf)
    model = classifier.TextClassifier.fit(d.where(~F.col("held_out")), "text", "mark")
    return rounded(model.score(d, "text").select("doc_id", "held_out", scoring.polarity(F.col("output")).alias("polarity")), "polarity", digits=4)


@query("trained_sentiment_auc")
def trained_sentiment_auc(spark, sf):
    """How well the classifier ranks labelled documents that it hasn't seen, and those that it has."""
    d = _judged(spark, sf)
    model = classifier.TextClassifier.fit(d.where(~F.col("held_out")), "text", "mark")
    scored = model.score(d.where("mark IS NOT NULL"), "text").select("held_out", classifier.score_of(F.col("output"), "positive").alias("s"), (F.col("mark") == "positive").alias("pos"))
    return rounded(stat.auc(scored, "s", "pos", ("held_out",)), "auc", digits=4)


@query("trained_topics")
def trained_topics(spark, sf):
    """Topics (languages) of held-out documents by a classifier of four: labels over the threshold, as labelling jobs store
    them, and how often the best one is right."""
    d = _judged(spark, sf)
    model = classifier.TextClassifier.fit(d.where(~F.col("held_out")), "text", "lang")
    chosen = model.score(d.where("held_out AND lang IS NOT NULL"), "text").select("lang", F.inline(scoring.chosen_labels(F.col("output"))))
    return rounded(chosen.groupBy("lang", F.col("label").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("prob")), "prob", digits=3)
