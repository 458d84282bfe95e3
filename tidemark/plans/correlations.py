"""Correlation tables over eras, lags and features, in long format."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expressions import pairs, pearson
from ..operators import statistics as stat
from ..operators import windows as win
from ..operators.features import unpivot
from ..schema import FIXED_LAGS, MAX_LAG
from ..sources.adapters import chunk_scores, market, with_views
from .base import query, r, rounded, sql_corr

#: Eras on the driver tables' years: (era, start, end, target, changed only).
ERAS = (("Full", "1995-01-01", "2001-12-31", "mro_diff", True), ("Pre-ZLB", "1995-01-01", "1997-06-30", "mro_diff", True), ("ZLB", "1997-07-01", "1999-06-30", "shadow_diff", False), ("Hiking", "1999-07-01", "2001-12-31", "mro_diff", True))
LEAST = 8
#: Meetings that a score goes back and ahead where only meetings with a change count.
CHANGED_LAGS = 8

_LONG = (
    ", m AS (SELECT date, sentiment_model || '_' || part AS label, avg(score) AS mean, stddev_samp(score) AS std, max(score) AS max, min(score) AS min, count(*) AS count FROM chunk_scores GROUP BY ALL),"
    " l AS (SELECT date, label || '_mean' AS feature, mean AS value FROM m UNION ALL SELECT date, label || '_std', std FROM m UNION ALL SELECT date, label || '_max', max FROM m UNION ALL SELECT date, label || '_min', min FROM m),"
    " d AS (SELECT date, feature AS base, value FROM l UNION ALL SELECT date, 'd_' || feature, value - lag(value) OVER (PARTITION BY feature ORDER BY date) FROM l),"
    " k AS (SELECT date, base, lag, value FROM (" + " UNION ALL ".join(f"SELECT date, base, {k} AS lag, lag(value, {k}) OVER (PARTITION BY base ORDER BY date) AS value FROM d" for k in range(MAX_LAG + 1)) + ")),"
    " t AS (SELECT date, 'mro_diff' AS target, round(mro - lag(mro) OVER (ORDER BY date), 6) AS y FROM market UNION ALL SELECT date, 'shadow_diff', round(shadow - lag(shadow) OVER (ORDER BY date), 6) FROM market),"
    " e(era, a, b, target, changed) AS (VALUES " + ", ".join(f"('{e}', DATE '{a}', DATE '{b}', '{t}', {str(c).lower()})" for e, a, b, t, c in ERAS) + "),"
    " y AS (SELECT era, date, t.target, y FROM t JOIN e ON t.target = e.target AND date BETWEEN a AND b WHERE NOT changed OR y IS DISTINCT FROM 0),"
    f" c AS (SELECT era, base, lag, target, round(covar_samp(value, y) / nullif(stddev_samp(value) * stddev_samp(y), 0), 4) AS r, count(*) AS n FROM k JOIN y USING (date) WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST} AND stddev_samp(value) >= 1e-8 AND stddev_samp(y) >= 1e-8),"
    " corr AS (SELECT era, base || CASE WHEN lag > 0 THEN ':lag' || lag ELSE '' END AS feature, base, CAST(lag AS INTEGER) AS lag, r + 0.0 AS r, n, target FROM c)"
)
_VIEWS = with_views("chunk_scores", "market", sql=_LONG)


def long_features(spark, sf):
    s = chunk_scores(spark, sf).groupBy("date", F.concat_ws("_", "sentiment_model", "part").alias("label"))
    m = s.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.max("score").alias("max"), F.min("score").alias("min"))
    return unpivot(m, ["mean", "std", "max", "min"], "stat", keep=("date", "label")).select("date", F.concat_ws("_", "label", "stat").alias("feature"), "value")


def targets(spark, sf):
    d = rounded(win.differences(market(spark, sf).select("date", "mro", "shadow"), ["mro", "shadow"]), "d_mro", "d_shadow")
    return unpivot(d.select("date", F.col("d_mro").alias("mro_diff"), F.col("d_shadow").alias("shadow_diff")), ["mro_diff", "shadow_diff"], "target", "y")


def era_rows(spark):
    e = spark.createDataFrame([list(x) for x in ERAS], "era string, start string, end string, target string, changed_only boolean")
    return e.select("era", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "target", "changed_only")


def corr_table(spark, sf, lags=MAX_LAG):
    t = stat.correlation_table(stat.long_lags(long_features(spark, sf), lags, True), targets(spark, sf), era_rows(spark), LEAST)
    return t.withColumn("r", F.col("r") + F.lit(0.0))


_OUT = "era, feature, base, lag, r, n, target"


@query("era_corr_table", _VIEWS + f" SELECT {_OUT} FROM corr")
def era_corr_table(spark, sf):
    return corr_table(spark, sf)


@query("coverage_filter", with_views("chunk_scores", sql=", m AS (SELECT date, sentiment_model || '_' || part || '_' || topic AS feature, count(*) AS n FROM chunk_scores GROUP BY ALL) SELECT feature FROM m GROUP BY feature HAVING avg(n) >= 20"))
def coverage_filter(spark, sf):
    m = chunk_scores(spark, sf).groupBy("date", F.concat_ws("_", "sentiment_model", "part", "topic").alias("feature")).agg(F.count(F.lit(1)).alias("count"))
    return stat.covered(m, 20.0)


_BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY abs(r) DESC, feature) AS q FROM corr WHERE era = 'Full') WHERE q = 1 ORDER BY abs(r) DESC, feature LIMIT {k})"


@query("peak_lag_pivot", _VIEWS + _BEST.format(k=30) + ', p AS (SELECT feature, ' + ", ".join(f"max(r) FILTER (era = '{e[0]}') AS \"{e[0]}\"" for e in ERAS) + ' FROM corr WHERE feature IN (SELECT feature FROM best) GROUP BY feature) SELECT * FROM p WHERE "Pre-ZLB" IS NOT NULL AND "ZLB" IS NOT NULL AND "Hiking" IS NOT NULL ORDER BY abs("Full") DESC, feature LIMIT 10')
def peak_lag_pivot(spark, sf):
    return stat.peak_pivot(corr_table(spark, sf), [e[0] for e in ERAS], "Full", 10)


@query("fixed_lag_top5", _VIEWS + f", f AS (SELECT *, row_number() OVER (PARTITION BY lag, base ORDER BY abs(r) DESC, feature) AS a FROM corr WHERE era = 'Full' AND lag IN {FIXED_LAGS}), g AS (SELECT {_OUT}, CAST(row_number() OVER (PARTITION BY lag ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank FROM f WHERE a = 1) SELECT * FROM g WHERE rank <= 5")
def fixed_lag_top5(spark, sf):
    return stat.fixed_lags(corr_table(spark, sf), FIXED_LAGS, "Full")


@query("lag_profile", _VIEWS + f", b AS (SELECT base FROM corr WHERE era = 'Full' GROUP BY base ORDER BY max(abs(r)) DESC, base LIMIT 6) SELECT {_OUT} FROM corr WHERE base IN (SELECT base FROM b)")
def lag_profile(spark, sf):
    return stat.lag_profile(corr_table(spark, sf), "Full").select("era", "feature", "base", "lag", "r", "n", "target")


@query("peak_lag", _VIEWS + " SELECT era, base, feature, r FROM (SELECT *, row_number() OVER (PARTITION BY era, base ORDER BY abs(r) DESC, feature) AS q FROM corr) WHERE q = 1")
def peak_lag(spark, sf):
    """The lag of the largest |r| of each series in each era."""
    return win.top_rows(corr_table(spark, sf), ("era", "base"), 1, F.abs("r").desc(), "feature").select("era", "base", "feature", "r")


@query("overlap_pairs", _VIEWS + ", x AS (SELECT * FROM l WHERE value IS NOT NULL) SELECT a.feature AS a, b.feature AS b, round(covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0), 3) + 0.0 AS r, count(*) AS n FROM x AS a JOIN x AS b ON a.date = b.date AND a.feature < b.feature GROUP BY 1, 2 HAVING count(*) >= 20")
def overlap_pairs(spark, sf):
    return stat.overlap(long_features(spark, sf)).withColumn("r", F.col("r") + F.lit(0.0))


@query("era_top10", _VIEWS + f" SELECT {_OUT}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY abs(r) DESC, feature) AS rank FROM corr) WHERE rank <= 10")
def era_top10(spark, sf):
    """The ten strongest features of each era, at any lag."""
    t = corr_table(spark, sf)
    w = Window.partitionBy("era").orderBy(F.abs("r").desc(), "feature")
    return t.select(*_OUT.split(", "), F.row_number().over(w).alias("rank")).where("rank <= 10")


@query("ordered_features", _VIEWS + ", s AS (SELECT base, row_number() OVER (ORDER BY abs(r) DESC, feature, era) AS place FROM corr) SELECT base, min(place) AS place, CAST(row_number() OVER (ORDER BY min(place)) AS INTEGER) AS nth FROM s GROUP BY base")
def ordered_features(spark, sf):
    """Base features, each once, in the order in which a list of strongest first names them."""
    t = corr_table(spark, sf)
    listed = t.select("base", F.row_number().over(Window.orderBy(F.abs("r").desc(), "feature", "era")).alias("place"))  # a row a result
    return stat.first_of_each(listed, "base", "place").select("base", F.col("place").cast("long").alias("place"), "nth")


@query("n_changed", _VIEWS + " SELECT era, count(*) AS n_total, count(*) FILTER (y IS DISTINCT FROM 0) AS n_changed FROM t JOIN e ON t.target = e.target AND date BETWEEN a AND b GROUP BY era")
def n_changed(spark, sf):
    from ..functions.expressions import changed

    e = F.broadcast(era_rows(spark)).withColumnRenamed("target", "_t")
    t = targets(spark, sf).join(e, (F.col("target") == F.col("_t")) & F.col("date").between(F.col("start"), F.col("end")))
    return t.groupBy("era").agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(changed("y"), 1)).alias("n_changed"))


_GAP = ", w AS (SELECT date, avg(score) FILTER (part = 'IS') AS i, avg(score) FILTER (part = 'QA') AS q, avg(score) FILTER (is_question) AS k, avg(score) FILTER (part = 'QA' AND NOT is_question) AS a FROM chunk_scores GROUP BY date), j AS (SELECT date, abs(i - q) AS div, abs(k - a) AS gap, mro, shadow, stoxx50 FROM w JOIN market USING (date))"
_TESTS = [(x, y) for x in ("div", "gap") for y in ("mro", "shadow", "stoxx50")]


def divergences(spark, sf):
    s = chunk_scores(spark, sf)
    of = lambda test: F.avg(F.when(test, F.col("score")))
    q = F.col("is_question")
    w = s.groupBy("date").agg(of(F.col("part") == "IS").alias("i"), of(F.col("part") == "QA").alias("q"), of(q).alias("k"), of((F.col("part") == "QA") & ~q).alias("a"))
    return w.select("date", F.abs(F.col("i") - F.col("q")).alias("div"), F.abs(F.col("k") - F.col("a")).alias("gap")).join(market(spark, sf), "date")


def six_tests(spark, sf):
    """name, r, n of the family of tests: both divergences against three market series, in one aggregate."""
    d = divergences(spark, sf)
    one = d.agg(*[x.alias(f"{n}{k}") for k, (a, b) in enumerate(_TESTS) for n, x in (("r", pearson(a, b)), ("n", pairs(a, b)))])
    rows = F.array(*[F.struct(F.lit(f"{a}:{b}").alias("name"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(_TESTS)])
    return one.select(F.inline(rows))


@query("divergence_correlations", with_views("chunk_scores", "market", sql=_GAP + " " + " UNION ALL ".join(f"SELECT '{a}:{b}' AS name, {r(sql_corr(a, b), 'r', 5)}, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM j" for a, b in _TESTS)))
def divergence_correlations(spark, sf):
    return rounded(six_tests(spark, sf), "r", digits=5)


#: The published family: raw p-values by name.
HOLM = (("a", 0.016), ("b", 0.444), ("c", 0.507), ("d", 0.430), ("e", 0.153), ("f", 0.957))


@query("holm_family", "WITH f(name, p) AS (VALUES " + ", ".join(f"('{n}', CAST({p} AS DOUBLE))" for n, p in HOLM) + "), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM f) SELECT name, p, " + r("least(max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1)", "p_adj") + " FROM k")
def holm_family(spark, sf):
    return rounded(win.holm(spark.createDataFrame([list(x) for x in HOLM], "name string, p double")), "p_adj")


def sql_p(r: str, n: str) -> str:
    """Two-sided p of Pearson's r over n pairs: Student's t with whole degrees of freedom by its finite series."""
    c = f"(1 - ({r}) * ({r}))"
    terms = lambda last, term: f"list_sum(list_transform(range(0, {last}), lambda j: {term} * power({c}, j)))"
    even = f"abs({r}) * coalesce({terms(f'({n} - 2) // 2', 'coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2.0 * i))), 1)')}, 0)"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt({c}) * coalesce({terms(f'({n} - 3) // 2', 'coalesce(list_product(list_transform(range(1, j + 1), lambda i: 2 * i / (2.0 * i + 1))), 1)')}, 0))"
    return f"CASE WHEN {n} > 2 THEN 1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END END"


def sql_stars(p: str, none: str = "n.s.") -> str:
    return f"CASE WHEN {p} IS NULL THEN '' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '{none}' END"


_FAMILY = ", h AS (" + " UNION ALL ".join(f"SELECT '{a}:{b}' AS name, {sql_corr(a, b)} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM j" for a, b in _TESTS) + f"), p AS (SELECT *, {sql_p('r', 'n')} AS p FROM h), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p), a AS (SELECT name, r, n, p, least(max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS p_adj FROM k)"


@query("divergence_tests", with_views("chunk_scores", "market", sql=_GAP + _FAMILY + f" SELECT name, {r('r', 'r')}, n, {r('p', 'p')}, {r('p_adj', 'p_adj')}, {sql_stars('p_adj')} AS sig FROM a"))
def divergence_tests(spark, sf):
    """The family with its p-values (Student's t by the incomplete beta function), Holm's adjustment and stars."""
    from ..functions.distributions import correlation_p
    from ..functions.expressions import stars

    t = six_tests(spark, sf).select("name", "r", "n", correlation_p(F.col("r"), F.col("n")).alias("p"))
    return rounded(win.holm(t).select("*", stars("p_adj").alias("sig")), "r", "p", "p_adj")


@query("era_corr_significance", _VIEWS + f", p AS (SELECT {_OUT}, round({sql_p('r', 'n')}, 4) AS p FROM corr) SELECT {_OUT}, p, {sql_stars('p', '')} AS sig FROM p")
def era_corr_significance(spark, sf):
    """The correlation table at lags up to MAX_LAG with p-values and stars."""
    from ..functions.distributions import correlation_p
    from ..functions.expressions import stars

    t = corr_table(spark, sf).withColumn("p", F.round(correlation_p(F.col("r"), F.col("n")), 4))
    return t.withColumn("sig", stars("p", ""))


@query("pretty_features", _VIEWS + " SELECT DISTINCT feature, CASE WHEN starts_with(feature, 'd_') THEN 'Δ ' ELSE '' END || replace(replace(replace(regexp_replace(regexp_replace(feature, ':lag[0-9]+$', ''), '^d_', ''), '_', ' '), 'finbert', 'Finbert'), 'roberta', 'Roberta') || CASE WHEN contains(feature, ':lag') THEN ' (t-' || regexp_extract(feature, ':lag([0-9]+)$', 1) || ')' ELSE '' END AS lower_name FROM corr")
def pretty_features(spark, sf):
    """Feature names as tables show them; compared apart from the capitals of sections and statistics."""
    from ..functions.text import pretty_feature

    shown = pretty_feature("feature")
    for a, b in (("IS ", "IS "), ("Q&A ", "QA "), ("Mean", "mean"), ("Std", "std"), ("Max", "max"), ("Min", "min")):
        shown = F.replace(shown, F.lit(a), F.lit(b))
    return corr_table(spark, sf).select("feature").distinct().select("feature", shown.alias("lower_name"))


_CHANGED = ", s AS (SELECT date, avg(score) AS score FROM chunk_scores GROUP BY date), j AS (SELECT s.date, score, round(mro - lag(mro) OVER (ORDER BY s.date), 6) AS y FROM s JOIN market USING (date)), c AS (SELECT * FROM j WHERE y IS DISTINCT FROM 0)"


@query(
    "lag_corr_changed",
    with_views("chunk_scores", "market", sql=_CHANGED + ", k AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, {'lag' if k >= 0 else 'lead'}(score, {abs(k)}) OVER (ORDER BY date) AS x, y FROM c" for k in range(-CHANGED_LAGS, CHANGED_LAGS + 1)) + f") SELECT CAST(lag AS INTEGER) AS lag, {r('covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)', 'r', 5)}, count(*) AS n FROM k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY lag HAVING count(*) >= 8"),
)
def lag_corr_changed(spark, sf):
    """Correlation at lags either way, counted over meetings with a change only."""
    s = chunk_scores(spark, sf).groupBy("date").agg(F.avg("score").alias("score")).join(market(spark, sf).select("date", "mro"), "date")
    return rounded(stat.changed_lag_correlation(rounded(win.differences(s, ["mro"]), "d_mro"), "score", "d_mro", CHANGED_LAGS, max_lead=CHANGED_LAGS), "r", digits=5)
