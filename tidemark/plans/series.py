"""Ordered series: lags, rolling windows, events, positions, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import changed, composite, direction, fisher_interval, pairs, pearson, regime, row_mean_abs
from ..operators import intervals, ordered, quantiles
from ..operators import windows as win
from ..operators.statistics import CRITICAL_R_20
from ..schema import eras
from ..sources.adapters import chunk_scores, market, qa_turns, table, with_views
from .base import query, r, rounded, sql_corr

_S = ", s AS (SELECT date, avg(score) AS score FROM chunk_scores GROUP BY date)"
_SM = _S + ", j AS (SELECT s.date, s.score, m.* EXCLUDE (date) FROM s JOIN market AS m USING (date))"


def meeting_scores(spark, sf):
    return chunk_scores(spark, sf).groupBy("date").agg(F.avg("score").alias("score"))


def joined(spark, sf):
    return meeting_scores(spark, sf).join(market(spark, sf), "date")


_LAGS = (1, 2, 3, 5, 7, 11)


@query("lag_features", with_views("chunk_scores", sql=_S + f" SELECT date, {r('score', 'score')}, " + ", ".join(r(f"lag(score, {k}) OVER (ORDER BY date)", f"score:lag{k}") for k in _LAGS) + " FROM s"))
def lag_features(spark, sf):
    return rounded(win.lags(meeting_scores(spark, sf), ["score"], _LAGS), "score", *[f"score:lag{k}" for k in _LAGS])


@query("lead_responses", with_views("market", sql=" SELECT date, ois_1y, " + ", ".join(r(f"100.0 * (lead(ois_1y, {h}) OVER (ORDER BY date) - ois_1y)", f"y_h{h}") for h in range(11)) + " FROM market"))
def lead_responses(spark, sf):
    return rounded(win.responses(market(spark, sf).select("date", "ois_1y"), "ois_1y", range(11)), *[f"y_h{h}" for h in range(11)])


@query("first_differences", with_views("market", sql=f" SELECT date, mro, shadow, {r('mro - lag(mro) OVER (ORDER BY date)', 'd_mro')}, {r('shadow - lag(shadow) OVER (ORDER BY date)', 'd_shadow')} FROM market"))
def first_differences(spark, sf):
    return rounded(win.differences(market(spark, sf).select("date", "mro", "shadow"), ["mro", "shadow"]), "d_mro", "d_shadow")


@query("moving_avg_180d", with_views("chunk_scores", sql=_S + f", d AS (SELECT date, datediff('day', DATE '1970-01-01', date) AS n, score FROM s) SELECT date, {r('score', 'score')}, {r('(avg(score) OVER (ORDER BY n RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) + avg(score) OVER (ORDER BY n RANGE BETWEEN CURRENT ROW AND 179 FOLLOWING)) / 2', 'smooth')} FROM d"))
def moving_avg_180d(spark, sf):
    return rounded(win.centred_mean(meeting_scores(spark, sf), "score", "smooth"), "score", "smooth")


@query(
    "moving_avg_events",
    "WITH e AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY ALL), d AS (SELECT *, datediff('day', DATE '1970-01-01', date) AS n FROM e) "
    f"SELECT event_type, date, {r('v', 'v')}, {r('(avg(v) OVER (PARTITION BY event_type ORDER BY n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) + avg(v) OVER (PARTITION BY event_type ORDER BY n RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING)) / 2', 'smooth')} FROM d",
)
def moving_avg_events(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("v"))
    return rounded(win.centred_mean(e, "v", "smooth", 7, ("event_type",)), "v", "smooth")


_W20 = "(ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_corr_20",
    with_views("chunk_scores", "market", sql=_SM + f" SELECT date, {r(f'CASE WHEN count(*) OVER {_W20} >= 10 THEN covar_samp(score, stoxx50) OVER {_W20} / nullif(stddev_samp(score) OVER {_W20} * stddev_samp(stoxx50) OVER {_W20}, 0) END', 'r', 5)}, count(*) OVER {_W20} AS n FROM j"),
)
def rolling_corr_20(spark, sf):
    return rounded(win.rolling_correlation(joined(spark, sf), "score", "stoxx50"), "r", digits=5)


@query(
    "critical_windows",
    with_views("chunk_scores", "market", sql=_SM + f", w AS (SELECT date, count(*) OVER {_W20} AS n, covar_samp(score, stoxx50) OVER {_W20} / nullif(stddev_samp(score) OVER {_W20} * stddev_samp(stoxx50) OVER {_W20}, 0) AS r FROM j) SELECT date, {r('r', 'r', 5)}, abs(r) > {CRITICAL_R_20} AS significant FROM w WHERE n = 20"),
)
def critical_windows(spark, sf):
    """Full windows of 20 rows whose correlation is beyond the critical one."""
    w = win.rolling_correlation(joined(spark, sf), "score", "stoxx50").where("n = 20")
    return rounded(w.select("date", "r", (F.abs("r") > CRITICAL_R_20).alias("significant")), "r", digits=5)


@query("fisher_ci", with_views("chunk_scores", "market", sql=_SM + f", c AS (SELECT {sql_corr('score', 'stoxx50')} AS r, count(*) AS n FROM j) SELECT n, {r('r', 'r', 5)}, {r('tanh(atanh(greatest(least(r, 0.999999), -0.999999)) - 1.959963984540054 / sqrt(greatest(n - 3, 1)))', 'low', 5)}, {r('tanh(atanh(greatest(least(r, 0.999999), -0.999999)) + 1.959963984540054 / sqrt(greatest(n - 3, 1)))', 'high', 5)} FROM c"))
def fisher_ci(spark, sf):
    c = joined(spark, sf).agg(pearson("score", "stoxx50").alias("r"), pairs("score", "stoxx50").alias("n"))
    low, high = fisher_interval("r", "n")
    return rounded(c.select("n", "r", low.alias("low"), high.alias("high")), "r", "low", "high", digits=5)


@query(
    "composite_target",
    with_views("market", sql=f", d AS (SELECT date, mro - lag(mro) OVER (ORDER BY date) AS dm, shadow - lag(shadow) OVER (ORDER BY date) AS ds FROM market), c AS (SELECT date, dm, ds, CASE WHEN date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' THEN CASE WHEN abs(round(ds, 6)) >= 0.1 THEN ds ELSE 0 END ELSE dm END AS c FROM d) SELECT date, {r('dm', 'd_mro')}, {r('ds', 'd_shadow')}, {r('c', 'composite')}, CAST(coalesce(sign(round(c, 6)), 0) AS INTEGER) AS direction, NOT (round(c, 6) IS NOT DISTINCT FROM 0) AS changed FROM c"),
)
def composite_target(spark, sf):
    d = rounded(win.differences(market(spark, sf).select("date", "mro", "shadow"), ["mro", "shadow"]), "d_mro", "d_shadow").select("date", "d_mro", "d_shadow")
    c = d.select("*", composite("date", "d_mro", "d_shadow", ("1997-01-01", "1999-06-30")).alias("composite"))
    return c.select("*", direction("composite").alias("direction"), changed("composite").alias("changed"))


_REG = ", g AS (SELECT date, score, CASE WHEN d > 0 THEN 'hiking' WHEN d < 0 THEN 'cutting' ELSE 'hold' END AS regime FROM (SELECT date, score, round(mro - lag(mro) OVER (ORDER BY date), 6) AS d FROM j))"


def _regimes(spark, sf):
    d = rounded(win.differences(joined(spark, sf), ["mro"]), "d_mro")
    return d.select("date", "score", regime("d_mro").alias("regime"))


@query("regime_labels", with_views("chunk_scores", "market", sql=_SM + _REG + " SELECT date, regime FROM g"))
def regime_labels(spark, sf):
    return _regimes(spark, sf).select("date", "regime")


@query("regime_boxes", with_views("chunk_scores", "market", sql=_SM + _REG + f" SELECT regime, count(*) AS n, {r('avg(score)', 'mean')}, " + ", ".join(r(f"quantile_cont(score, {q})", n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + " FROM g GROUP BY regime"))
def regime_boxes(spark, sf):
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = _regimes(spark, sf).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), q.alias("q"))
    return rounded(g.select("regime", "n", "mean", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]), "mean", "q1", "q2", "q3")


_EV = [("early", "1995-01-01", "1998-12-31"), ("late", "1998-06-01", "2001-12-31")]
_EVW = (
    _SM
    + ", e(era, a, b) AS (VALUES ('early', DATE '1995-01-01', DATE '1998-12-31'), ('late', DATE '1998-06-01', DATE '2001-12-31')),"
    " x AS (SELECT date, score, coalesce(round(mro - lag(mro) OVER (ORDER BY date), 6) <> 0, false) AS ev FROM j),"
    " n AS (SELECT era, date, score, ev, row_number() OVER (PARTITION BY era ORDER BY date) AS rn FROM x JOIN e ON date BETWEEN a AND b),"
    " w AS (SELECT p.era, p.date AS event_date, q.rn - p.rn AS lag, q.score AS value FROM n AS p JOIN n AS q ON p.era = q.era AND q.rn BETWEEN p.rn - 6 AND p.rn + 6 WHERE p.ev)"
)


def _events(spark, sf):
    d = rounded(win.differences(joined(spark, sf), ["mro"]), "d_mro")
    return win.event_windows(d, eras(spark, _EV), "score", F.coalesce(F.col("d_mro") != 0, F.lit(False)))


@query("event_windows", with_views("chunk_scores", "market", sql=_EVW + f" SELECT era, event_date, CAST(lag AS INTEGER) AS lag, {r('value', 'value')} FROM w"))
def event_windows(spark, sf):
    return rounded(_events(spark, sf), "value")


@query("event_windows_sem", with_views("chunk_scores", "market", sql=_EVW + f" SELECT era, CAST(lag AS INTEGER) AS lag, {r('avg(value)', 'mean')}, {r('stddev_samp(value) / sqrt(count(value))', 'sem')}, count(value) AS n FROM w GROUP BY ALL"))
def event_windows_sem(spark, sf):
    return rounded(win.event_profile(_events(spark, sf)), "mean", "sem")


@query("row_mean_abs", with_views("market", sql=f" SELECT date, {r('list_avg(list_filter([abs(ois_1m), abs(ois_3m), abs(ois_6m), abs(ois_1y)], lambda x: x IS NOT NULL))', 'ois_uncertainty')} FROM market"))
def row_mean_abs_(spark, sf):
    return rounded(market(spark, sf).select("date", row_mean_abs("ois_1m", "ois_3m", "ois_6m", "ois_1y").alias("ois_uncertainty")), "ois_uncertainty")


@query("ols_line", with_views("chunk_scores", "market", sql=_SM + f" SELECT {r('regr_slope(stoxx50, score)', 'slope', 5)}, {r('regr_intercept(stoxx50, score)', 'intercept', 5)}, regr_count(stoxx50, score) AS n FROM j"))
def ols_line(spark, sf):
    g = joined(spark, sf).agg(F.regr_slope("stoxx50", "score").alias("slope"), F.regr_intercept("stoxx50", "score").alias("intercept"), F.regr_count("stoxx50", "score").alias("n"))
    return rounded(g, "slope", "intercept", digits=5)


@query("position_percentile", "SELECT conv_id, turn, row_number() OVER w - 1 AS chunk_id, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN " + r("(row_number() OVER w - 1) / (count(*) OVER (PARTITION BY conv_id) - 1)") + " END AS chunk_percentile FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def position_percentile(spark, sf):
    t = qa_turns(spark, sf).select("conv_id", "turn")
    return rounded(win.positions(t, ("conv_id",), "turn").withColumn("chunk_id", F.col("chunk_id").cast("long")), "chunk_percentile")


_POS = ", p AS (SELECT date, part, chunk_rowid, score, row_number() OVER (PARTITION BY date, part ORDER BY chunk_rowid) - 1 AS id, count(*) OVER (PARTITION BY date, part) - 1 AS top FROM chunk_scores), g AS (SELECT date, part, chunk_rowid, score, CASE part WHEN 'IS' THEN id / nullif(top, 0) / 2 ELSE 0.5 + id / nullif(top, 0) / 2 END AS x FROM p)"


def _global(spark, sf):
    p = win.positions(chunk_scores(spark, sf).select("date", "part", "chunk_rowid", "score"), ("date", "part"), "chunk_rowid")
    return p.select("date", "part", "chunk_rowid", "score", win.global_position("part", "chunk_percentile").alias("x"))


@query("global_position", with_views("chunk_scores", sql=_POS + f" SELECT date, part, chunk_rowid, {r('x', 'x')} FROM g"))
def global_position(spark, sf):
    return rounded(_global(spark, sf).drop("score"), "x")


@query(
    "binned_profile",
    with_views("chunk_scores", sql=_POS + ", b AS (SELECT unnest(range(20)) AS bin), e AS (SELECT min(x) AS lo, max(x) AS hi FROM g), k AS (SELECT bin, lo + bin * (hi - lo) / 20 AS a, lo + (bin + 1) * (hi - lo) / 20 AS c FROM b, e)"
    f" SELECT CAST(bin AS INTEGER) AS bin, {r('any_value((a + c) / 2)', 'centre')}, {r('avg(score)', 'mean')}, {r('stddev_pop(score) / sqrt(count(score))', 'se')}, count(score) AS n FROM k JOIN g ON x >= a AND x <= c GROUP BY bin HAVING count(score) > 5"),
)
def binned_profile(spark, sf):
    return rounded(win.binned_profile(_global(spark, sf), "x", "score"), "centre", "mean", "se")


_QA = (
    "WITH o AS (SELECT *, CASE WHEN is_question AND NOT coalesce(lag(is_question) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 1 ELSE 0 END AS o FROM qa_turns),"
    " k AS (SELECT *, sum(o) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM o),"
    " g AS (SELECT conv_id, k, sum(score) FILTER (is_question) AS qs, count(score) FILTER (is_question) AS qn, avg(score) FILTER (NOT is_question) AS a_score, count(score) FILTER (NOT is_question) AS a_n FROM k WHERE k > 0 GROUP BY conv_id, k)"
)


def _qa_sql(q: str, n: str) -> str:
    return f", c AS (SELECT conv_id, k, {q} AS q_score, {n} AS q_n, a_score, a_n FROM g), p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS pair_id, q_score, a_score, q_n, a_n, abs(q_score - a_score) AS gap FROM c WHERE a_n > 0)"


_RUN = "OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)"
_PAIRS = with_views("qa_turns", sql=_QA.replace("WITH o", ", o") + _qa_sql("qs / qn", "qn"))
_PAIRS_ALL = with_views("qa_turns", sql=_QA.replace("WITH o", ", o") + _qa_sql(f"sum(qs) {_RUN} / sum(qn) {_RUN}", f"CAST(sum(qn) {_RUN} AS BIGINT)"))
_PAIR_OUT = f" SELECT conv_id, pair_id, {r('q_score', 'q_score')}, {r('a_score', 'a_score')}, q_n, a_n, {r('gap', 'gap')} FROM p"


def _pairs(spark, sf, cumulative=False):
    return win.question_answer_pairs(qa_turns(spark, sf), cumulative=cumulative).withColumn("pair_id", F.col("pair_id").cast("long"))


@query("qa_pairs", _PAIRS + _PAIR_OUT)
def qa_pairs(spark, sf):
    return rounded(_pairs(spark, sf), "q_score", "a_score", "gap")


@query("qa_pairs_cumulative", _PAIRS_ALL + _PAIR_OUT)
def qa_pairs_cumulative(spark, sf):
    return rounded(_pairs(spark, sf, True), "q_score", "a_score", "gap")


@query("pair_aggregate", _PAIRS + f" SELECT conv_id, {r('avg(gap)', 'mean_gap')}, {r('avg(q_score)', 'mean_q')}, {r('avg(a_score)', 'mean_a')}, count(*) AS n_pairs, {r('max(gap)', 'max_gap')} FROM p GROUP BY conv_id")
def pair_aggregate(spark, sf):
    return rounded(win.pairs_per_meeting(_pairs(spark, sf)), "mean_gap", "mean_q", "mean_a", "max_gap")


@query("signed_gap", _PAIRS + f" SELECT {r('avg(q_score - a_score)', 'mean')}, {r('median(q_score - a_score)', 'median')}, {r('avg(CASE WHEN q_score - a_score < 0 THEN 1.0 ELSE 0.0 END)', 'below')}, {r('avg(CASE WHEN q_score - a_score > 0 THEN 1.0 ELSE 0.0 END)', 'above')}, count(*) AS n FROM p")
def signed_gap(spark, sf):
    g = _pairs(spark, sf).select((F.col("q_score") - F.col("a_score")).alias("g"))
    out = g.agg(F.avg("g").alias("mean"), F.median("g").alias("median"), F.avg((F.col("g") < 0).cast("double")).alias("below"), F.avg((F.col("g") > 0).cast("double")).alias("above"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "mean", "median", "below", "above")


@query("qa_texts", with_views("qa_turns", sql=_QA.replace("WITH o", ", o") + " SELECT conv_id, CAST(k AS BIGINT) AS pair, trim(coalesce(string_agg(text, chr(9) ORDER BY turn) FILTER (is_question), '')) AS question, trim(coalesce(string_agg(text, chr(9) ORDER BY turn) FILTER (NOT is_question), '')) AS answer FROM k GROUP BY conv_id, k"))
def qa_texts(spark, sf):
    return win.question_answer_texts(qa_turns(spark, sf))


@query("short_chunks", "SELECT words, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (ORDER BY words) AS BIGINT) AS running FROM (SELECT len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS words FROM conversations WHERE role <> 'system' AND length(text) <= 85) GROUP BY words")
def short_chunks(spark, sf):
    """Short texts by their number of words, with a running count."""
    from pyspark.sql import Window

    from ..functions.text import words

    c = qa_turns(spark, sf).where(F.length("text") <= 85).select(F.size(words("text")).cast("long").alias("words")).groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    return c.select("words", "n", F.sum("n").over(Window.orderBy("words")).alias("running"))  # a row per number of words


@query("gap_boxes", _PAIRS + f" SELECT CASE WHEN conv_id % 3 = 0 THEN 'a' WHEN conv_id % 3 = 1 THEN 'b' ELSE 'c' END AS era, count(*) AS n, " + ", ".join(r(f"quantile_cont(gap, {q})", n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + " FROM p GROUP BY 1")
def gap_boxes(spark, sf):
    q = F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    era = F.element_at(F.array(*map(F.lit, "abc")), (F.col("conv_id") % 3 + 1).cast("int")).alias("era")
    g = _pairs(spark, sf).groupBy(era).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return rounded(g.select("era", "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]), "q1", "q2", "q3")


@query("local_means_by_limit", with_views("chunk_scores", sql=f" SELECT chunk_limit, part, {r('avg(score)', 'mean')}, count(*) AS n FROM chunk_scores GROUP BY ALL"))
def local_means_by_limit(spark, sf):
    return rounded(chunk_scores(spark, sf).groupBy("chunk_limit", "part").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


@query("year_summary", with_views("chunk_scores", sql=f" SELECT CAST(year(date) AS INTEGER) AS year, {r('avg(score)', 'mean')}, count(*) AS n FROM chunk_scores GROUP BY 1"))
def year_summary(spark, sf):
    return rounded(chunk_scores(spark, sf).groupBy(F.year("date").alias("year")).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


_CHUNKS = ", c AS (SELECT chunk_rowid, CASE WHEN chunk_rowid % 7 = 0 THEN score END AS score, topic_prob FROM chunk_scores)"


def _by_chunk(spark, sf):
    """Chunks in the order of their keys; six of seven have no score."""
    return chunk_scores(spark, sf).select("chunk_rowid", F.when(F.col("chunk_rowid") % 7 == 0, F.col("score")).alias("score"), "topic_prob")


@query("chunk_forward_fill", with_views("chunk_scores", sql=_CHUNKS + f" SELECT chunk_rowid, {r('last_value(score IGNORE NULLS) OVER (ORDER BY chunk_rowid)', 'score')} FROM c"))
def chunk_forward_fill(spark, sf):
    """A forward fill over all chunks, by blocks and their carries."""
    return rounded(ordered.forward_fill(_by_chunk(spark, sf), "chunk_rowid", ["score"], size=512).select("chunk_rowid", "score"), "score")


@query("chunk_lags", with_views("chunk_scores", sql=_CHUNKS + f" SELECT chunk_rowid, {r('lag(score, 7) OVER w', 'score:lag7')}, {r('lead(topic_prob, 2) OVER w', 'topic_prob:lag-2')}, {r('lag(topic_prob, 1) OVER w', 'topic_prob:lag1')} FROM c WINDOW w AS (ORDER BY chunk_rowid)"))
def chunk_lags(spark, sf):
    """Values of neighbouring chunks, by blocks with halos."""
    rows = _by_chunk(spark, sf)
    both = ordered.windowed(rows, "chunk_rowid", {"score:lag7": lambda w: F.lag("score", 7).over(w), "topic_prob:lag-2": lambda w: F.lead("topic_prob", 2).over(w), "topic_prob:lag1": lambda w: F.lag("topic_prob").over(w)}, 7, 2, size=512)
    return rounded(both.drop("score", "topic_prob"), "score:lag7", "topic_prob:lag-2", "topic_prob:lag1")


@query("chunk_rolling_corr", with_views("chunk_scores", sql=f", d AS (SELECT chunk_rowid, score AS x, topic_prob AS y FROM chunk_scores), n AS (SELECT *, count(*) OVER w AS n, covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) AS c FROM d WINDOW w AS (ORDER BY chunk_rowid ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT chunk_rowid, n, {r('CASE WHEN n >= 10 THEN c END', 'r', 5)} FROM n"))
def chunk_rolling_corr(spark, sf):
    """Rolling correlation over the last 50 chunks."""
    return rounded(ordered.rolling_correlation(chunk_scores(spark, sf).select("chunk_rowid", "score", "topic_prob"), "chunk_rowid", "score", "topic_prob", 50, size=512).select("chunk_rowid", "n", "r"), "r", digits=5)


@query("chunk_quantiles", with_views("chunk_scores", sql=f", q AS (SELECT part, chunk_limit, count(score) AS n, quantile_cont(score, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM chunk_scores GROUP BY part, chunk_limit) SELECT part, chunk_limit, n, {', '.join(r(f'q[{i + 1}]', f'q{i}') for i in range(5))} FROM q"))
def chunk_quantiles(spark, sf):
    """Exact quantiles of all chunks of a part and size, from a sketch and a second pass."""
    q = quantiles.quantiles(chunk_scores(spark, sf), "score", (0.05, 0.25, 0.5, 0.75, 0.95), ("part", "chunk_limit"), 200)
    return rounded(q.select("part", "chunk_limit", "n", *[F.get("q", i).alias(f"q{i}") for i in range(5)]), *[f"q{i}" for i in range(5)])


@query("open_intervals", "WITH i AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 2 AS INTEGER) AS b, o_totalprice AS v FROM orders), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT CAST(d AS VARCHAR) AS day, count(*) AS n, " + r("sum(v)", "total", 2) + " FROM d JOIN i ON d BETWEEN a AND b GROUP BY d")
def open_intervals(spark, sf):
    """Of each shipping day the orders whose interval holds it: an interval an order, overlapping, of 0 to 37 days or empty."""
    a = F.to_date("o_orderdate")
    i = table(spark, sf, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 40 - 2).cast("int")).alias("b"), F.col("o_totalprice").alias("v"))
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    got = intervals.interval_join(d, i, F.unix_date("day"), F.unix_date("a"), F.unix_date("b"))
    return rounded(got.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total", digits=2)
