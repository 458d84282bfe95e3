"""Scans, joins, set operations and grouped moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import year_bin
from ..operators import features as feat
from ..operators.windows import top_rows
from ..schema import STATS, labels
from ..sources.adapters import chunk_scores, keyed, market, qa_turns, table, with_views
from .base import query, r, rounded

_CODE = "CASE topic WHEN 'MONETARY_POLICY_AND_INFLATION' THEN 'MP' WHEN 'ECONOMIC_PERFORMANCE' THEN 'EP' WHEN 'FISCAL_AND_STRUCTURAL' THEN 'FS' ELSE 'OI' END"


@query("scan_filter_project", with_views("chunk_scores", sql=" SELECT chunk_rowid, part, score FROM chunk_scores WHERE chunk_limit = 200 AND score > 0.5"))
def scan_filter_project(spark, sf):
    return chunk_scores(spark, sf).where((F.col("chunk_limit") == 200) & (F.col("score") > 0.5)).select("chunk_rowid", "part", "score")


@query("distinct_limits", with_views("chunk_scores", sql=" SELECT DISTINCT chunk_limit FROM chunk_scores"))
def distinct_limits(spark, sf):
    return chunk_scores(spark, sf).select("chunk_limit").distinct()


@query(
    "star_join",
    "SELECT o_orderkey AS chunk_rowid, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS model, n_name AS label, r_name AS topic_model, l_quantity AS prob "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_linenumber = 1",
)
def star_join(spark, sf):
    """Facts with two dimensions of fixed size (nations, regions); the rest is left to the planner."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").where("l_linenumber = 1").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("o_orderkey").alias("chunk_rowid"), F.col("o_orderdate").cast("date").alias("date"), F.col("c_mktsegment").alias("model"), F.col("n_name").alias("label"), F.col("r_name").alias("topic_model"), F.col("l_quantity").alias("prob"))


@query("label_join_fanout", "SELECT o_orderkey AS chunk_rowid, CAST(count(*) AS BIGINT) AS labels, count(DISTINCT l_returnflag) AS kinds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def label_join_fanout(spark, sf):
    """A chunk joined with its topics comes once per topic: that is meant. Both sides are counted by key before they meet."""
    o = table(spark, sf, "orders").where("o_orderkey IS NOT NULL").groupBy(F.col("o_orderkey").alias("chunk_rowid")).agg(F.count(F.lit(1)).alias("m"))
    li = keyed(table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL").select("l_orderkey", "l_returnflag"), "l_orderkey")
    t = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_returnflag").alias("kinds"))
    return o.join(t, F.col("chunk_rowid") == F.col("l_orderkey")).select("chunk_rowid", (F.col("m") * F.col("n")).alias("labels"), "kinds")


@query("key_lookup", "SELECT o_orderkey AS chunk_rowid, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS model FROM orders")
def key_lookup(spark, sf):
    """Scalar subqueries that resolve keys, as a left join."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("model"))
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("chunk_rowid"), "model")


@query("irrelevant_filter", with_views("chunk_scores", sql=" SELECT chunk_rowid, topic, topic_prob FROM chunk_scores WHERE topic_model = 'facebook' AND NOT (topic = 'OTHER_IRRELEVANT' AND topic_prob > 0.7)"))
def irrelevant_filter(spark, sf):
    return feat.chunk_data(chunk_scores(spark, sf), None, "facebook", True, True).select("chunk_rowid", "topic", "topic_prob")


_MEANS = ", m AS (SELECT chunk_limit, date, avg(score) AS mean FROM chunk_scores GROUP BY ALL)"


@query("left_new_columns", with_views("chunk_scores", "market", sql=f" SELECT m.date, mro, shadow, s.mean FROM market AS m LEFT JOIN (SELECT date, {r('avg(score)')} AS mean FROM chunk_scores WHERE part = 'IS' GROUP BY date) AS s USING (date)"))
def left_new_columns(spark, sf):
    m = market(spark, sf).select("date", "mro", "shadow")
    s = rounded(chunk_scores(spark, sf).where("part = 'IS'").groupBy("date").agg(F.avg("score").alias("mean")), "mean")
    return feat.join_new_columns([m, s])


@query("outer_by_limit", with_views("chunk_scores", sql=_MEANS + f" SELECT date, {r('max(mean) FILTER (chunk_limit = 1)')} AS l1, {r('max(mean) FILTER (chunk_limit = 50)')} AS l50, {r('max(mean) FILTER (chunk_limit = 200)')} AS l200, {r('max(mean) FILTER (chunk_limit = 350)')} AS l350 FROM m GROUP BY date"))
def outer_by_limit(spark, sf):
    s = chunk_scores(spark, sf)
    frames = {f"l{k}": s.where(F.col("chunk_limit") == k).groupBy("date").agg(F.avg("score").alias("mean")) for k in (1, 50, 200, 350)}
    return rounded(feat.outer_chain(frames, "mean"), "l1", "l50", "l200", "l350")


@query("semi_delete", with_views("chunk_scores", sql=" SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT chunk_rowid FROM chunk_scores WHERE chunk_limit = 50 AND sentiment_model = 'finbert')"))
def semi_delete(spark, sf):
    """The rows that a delete for a limit and a model would take."""
    keys = chunk_scores(spark, sf).where("chunk_limit = 50 AND sentiment_model = 'finbert'").select(F.col("chunk_rowid").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(keys, "l_orderkey", "left_semi")


@query("anti_overwrite", with_views("chunk_scores", sql=" SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT chunk_rowid FROM chunk_scores WHERE chunk_limit = 50 AND sentiment_model = 'finbert')"))
def anti_overwrite(spark, sf):
    """The rows that stay."""
    keys = chunk_scores(spark, sf).where("chunk_limit = 50 AND sentiment_model = 'finbert'").select(F.col("chunk_rowid").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(keys, "l_orderkey", "left_anti")


@query("date_difference", with_views("chunk_scores", "market", sql=" SELECT date FROM market EXCEPT SELECT date FROM chunk_scores"))
def date_difference(spark, sf):
    return market(spark, sf).select("date").subtract(chunk_scores(spark, sf).select("date"))


@query("union_sections", "SELECT conv_id AS statement_id, 1 AS part, role = 'user' AS is_question, text FROM conversations WHERE role <> 'system' UNION ALL SELECT doc_id, 0, NULL, text FROM documents")
def union_sections(spark, sf):
    qa = qa_turns(spark, sf).select(F.col("conv_id").alias("statement_id"), F.lit(1).alias("part"), "is_question", "text")
    intro = table(spark, sf, "documents").select(F.col("doc_id").alias("statement_id"), F.lit(0).alias("part"), "text")
    return qa.unionByName(intro, allowMissingColumns=True)


_MOMENTS = ", ".join([r("min(score)", "min"), r("avg(score)", "mean"), r("max(score)", "max"), r("stddev_samp(score)", "std"), 'CAST(count(score) AS BIGINT) AS "count"'])


@query("meeting_moments", with_views("chunk_scores", sql=f" SELECT date, part, is_question, sentiment_model, {_MOMENTS} FROM (SELECT DISTINCT date, part, is_question, chunk_rowid, sentiment_model, score FROM chunk_scores) GROUP BY ALL"))
def meeting_moments(spark, sf):
    return rounded(feat.moments(feat.chunk_data(chunk_scores(spark, sf), None, with_label=False), False), "min", "mean", "max", "std")


@query("meeting_moments_labelled", with_views("chunk_scores", sql=f" SELECT date, part, topic, is_question, sentiment_model, {_MOMENTS} FROM chunk_scores WHERE topic_model = 'facebook' GROUP BY ALL"))
def meeting_moments_labelled(spark, sf):
    return rounded(feat.moments(feat.chunk_data(chunk_scores(spark, sf), None)), "min", "mean", "max", "std")


_AGG = {"max": "max(score)", "mean": "avg(score)", "min": "min(score)", "std": "stddev_samp(score)", "count": "count(score)"}


def _cells(where: dict[str, str]) -> str:
    return ", ".join(f'CASE WHEN count(*) FILTER ({w}) > 0 THEN {_AGG[s]} FILTER ({w}) END AS "{n}_{s}"' for n, w in where.items() for s in STATS)


def _filled(names: list[str], qa_null: bool) -> str:
    def one(c, s):
        fill = f'last_value("{c}_{s}" IGNORE NULLS) OVER w'
        fill = f"CASE WHEN qa > 0 THEN {fill} END" if qa_null and "_QA" in c else fill
        return f'CAST({fill} AS BIGINT) AS "{c}_{s}"' if s == "count" else r(fill, f"{c}_{s}")

    return ", ".join(one(c, s) for c in names for s in STATS)


_PIVOT = {n: " AND ".join([f"sentiment_model = '{n.split('_')[0]}'", f"part = '{n.split('_')[1]}'", "NOT is_question"]) for n in labels(True, "just_answers", False)}
_WIDE = f", p AS (SELECT date, count(*) FILTER (part = 'QA' AND NOT is_question) AS qa, {_cells(_PIVOT)} FROM chunk_scores WHERE NOT is_question GROUP BY date)"
_ROUND = [f"{n}_{s}" for n in _PIVOT for s in STATS if s != "count"]


@query("meeting_pivot", with_views("chunk_scores", sql=_WIDE + " SELECT date, " + ", ".join(f'CAST("{n}_{s}" AS BIGINT) AS "{n}_{s}"' if s == "count" else r(f'"{n}_{s}"', f"{n}_{s}") for n in _PIVOT for s in STATS) + " FROM p"))
def meeting_pivot(spark, sf):
    """Without filling: the plain pivot, labels listed beforehand."""
    m = feat.moments(feat.chunk_data(chunk_scores(spark, sf), None, with_label=False), False).where("NOT is_question")
    wide = m.withColumn("label", F.concat_ws("_", "sentiment_model", "part")).groupBy("date").pivot("label", list(_PIVOT)).agg(*[F.first(s, ignorenulls=True).alias(s) for s in STATS])
    return rounded(wide, *_ROUND)


@query("meeting_pivot_ffill", with_views("chunk_scores", sql=_WIDE + f" SELECT date, {_filled(list(_PIVOT), True)} FROM p WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"))
def meeting_pivot_ffill(spark, sf):
    return rounded(feat.feature_matrix(chunk_scores(spark, sf), None, True, "just_answers", False), *_ROUND)


_TOPIC = {n: f"sentiment_model = '{n.split('_')[0]}' AND {_CODE} = '{n.split('_')[1]}'" for n in labels(False, "both_together", True)}


@query(
    "meeting_pivot_topics",
    with_views("chunk_scores", sql=f", p AS (SELECT date, {_cells(_TOPIC)} FROM chunk_scores WHERE topic_model = 'facebook' AND NOT (topic = 'OTHER_IRRELEVANT' AND topic_prob > 0.7) GROUP BY date) SELECT date, {_filled(list(_TOPIC), False)} FROM p WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"),
)
def meeting_pivot_topics(spark, sf):
    return rounded(feat.feature_matrix(chunk_scores(spark, sf), None, False, "both_together", True, "facebook", True), *[f"{n}_{s}" for n in _TOPIC for s in STATS if s != "count"])


_DIVIDED = {}
for _n in labels(True, "both_divided", False):
    _p = _n.split("_")
    _DIVIDED[_n] = f"sentiment_model = '{_p[0]}' AND part = '{_p[1]}'" + ("" if len(_p) < 3 else f" AND is_question = {str(_p[2] == 'question').lower()}")


@query("meeting_pivot_divided", with_views("chunk_scores", sql=f", p AS (SELECT date, count(*) FILTER (part = 'QA') AS qa, {_cells(_DIVIDED)} FROM chunk_scores GROUP BY date) SELECT date, {_filled(list(_DIVIDED), True)} FROM p WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"))
def meeting_pivot_divided(spark, sf):
    return rounded(feat.feature_matrix(chunk_scores(spark, sf), None, True, "both_divided", False), *[f"{n}_{s}" for n in _DIVIDED for s in STATS if s != "count"])


@query("feature_market_matrix", with_views("chunk_scores", "market", sql=_WIDE + f", f AS (SELECT date, {_filled(list(_PIVOT), True)} FROM p WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT m.*, f.* EXCLUDE (date) FROM market AS m JOIN f USING (date)"))
def feature_market_matrix(spark, sf):
    return rounded(feat.model_data(market(spark, sf), feat.feature_matrix(chunk_scores(spark, sf), None, True, "just_answers", False)), *_ROUND)


@query("market_panels", with_views("market", sql=" SELECT date, mro, stoxx50, stoxx50 AS stoxx50_1, shadow FROM market"))
def market_panels(spark, sf):
    """Panels whose columns clash keep both, the later one with a suffix."""
    m = market(spark, sf)
    return feat.join_panels([m.select("date", "mro", "stoxx50"), m.select("date", "stoxx50", "shadow")])


_MODELS = ", w AS (SELECT date, avg(score) FILTER (sentiment_model = 'finbert') AS finbert, avg(score) FILTER (sentiment_model = 'roberta') AS roberta FROM chunk_scores GROUP BY date)"


def model_means(spark, sf):
    s = chunk_scores(spark, sf)
    return s.groupBy("date").agg(*[F.avg(F.when(F.col("sentiment_model") == m, F.col("score"))).alias(m) for m in ("finbert", "roberta")])


@query("descriptives_iqr", with_views("chunk_scores", sql=_MODELS + f", u AS (SELECT 'finbert' AS feature, finbert AS v FROM w UNION ALL SELECT 'roberta', roberta FROM w) SELECT feature, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, count(v) AS n FROM u GROUP BY feature"))
def descriptives_iqr(spark, sf):
    long = feat.unpivot(model_means(spark, sf), ["finbert", "roberta"])
    return rounded(feat.descriptives(long), "mean", "std", "min", "max", "iqr")


@query("topic_descriptives", with_views("chunk_scores", sql=f", t AS (SELECT {_CODE} AS feature, date, avg(score) AS v FROM chunk_scores WHERE sentiment_model = 'roberta' GROUP BY ALL) SELECT feature, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, count(v) AS n FROM t GROUP BY feature"))
def topic_descriptives(spark, sf):
    from ..functions.expressions import topic_code

    t = chunk_scores(spark, sf).where("sentiment_model = 'roberta'").groupBy(topic_code("topic").alias("feature"), "date").agg(F.avg("score").alias("value"))
    return rounded(feat.descriptives(t), "mean", "std", "min", "max", "iqr")


@query("topic_share_by_year", with_views("chunk_scores", sql=f", c AS (SELECT year(date) AS year, {_CODE} AS topic, count(*) AS n FROM chunk_scores GROUP BY ALL) SELECT CAST(year AS INTEGER) AS year, " + ", ".join(r(f"100.0 * coalesce(max(n) FILTER (topic = '{t}'), 0) / sum(n)", t) for t in ("MP", "EP", "FS", "OI")) + " FROM c GROUP BY year"))
def topic_share_by_year(spark, sf):
    from ..functions.expressions import topic_code

    c = chunk_scores(spark, sf).groupBy(F.year("date").alias("year"), topic_code("topic").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda t: (100.0 * F.coalesce(F.max(F.when(F.col("topic") == t, F.col("n"))), F.lit(0)) / F.sum("n")).alias(t)
    return rounded(c.groupBy("year").agg(*[share(t) for t in ("MP", "EP", "FS", "OI")]), "MP", "EP", "FS", "OI")


_ERA = "CASE WHEN year(date) > 1994 AND year(date) <= 1996 THEN 'early' WHEN year(date) > 1996 AND year(date) <= 1999 THEN 'middle' WHEN year(date) > 1999 AND year(date) <= 2001 THEN 'late' END"


def _era():
    return year_bin("date", (1994, 1996, 1999, 2001), ("early", "middle", "late"))


@query("era_distribution", with_views("chunk_scores", sql=f" SELECT {_ERA} AS era, sentiment_model, count(score) AS n, {r('avg(score)', 'mean', 3)}, {r('stddev_samp(score)', 'std', 3)}, {r('avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END)', 'positive', 3)} FROM chunk_scores GROUP BY ALL"))
def era_distribution(spark, sf):
    s = chunk_scores(spark, sf).groupBy(_era().alias("era"), "sentiment_model")
    out = s.agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.avg((F.col("score") > 0).cast("double")).alias("positive"))
    return rounded(out, "mean", "std", "positive", digits=3)


@query("era_model_correlation", with_views("chunk_scores", sql=_MODELS + f" SELECT {_ERA} AS era, {r('covar_samp(finbert, roberta) / nullif(stddev_samp(finbert) * stddev_samp(roberta), 0)', 'r')}, count(*) AS n FROM w WHERE finbert IS NOT NULL AND roberta IS NOT NULL GROUP BY 1"))
def era_model_correlation(spark, sf):
    from ..functions.expressions import pairs, pearson

    g = model_means(spark, sf).groupBy(_era().alias("era")).agg(pearson("finbert", "roberta").alias("r"), pairs("finbert", "roberta").alias("n"))
    return rounded(g.where("n > 0"), "r")


@query("chunk_model_pivot", with_views("chunk_scores", sql=" SELECT date, statement_id, chunk_limit, " + ", ".join(r(f"avg(score) FILTER (sentiment_model = '{m}')", m) for m in ("finbert", "roberta")) + " FROM chunk_scores GROUP BY ALL"))
def chunk_model_pivot(spark, sf):
    p = chunk_scores(spark, sf).groupBy("date", "statement_id", "chunk_limit").pivot("sentiment_model", ["finbert", "roberta"]).agg(F.avg("score"))
    return rounded(p, "finbert", "roberta")


@query(
    "limit_metrics_argmax",
    with_views(
        "chunk_scores",
        sql=", m AS (SELECT chunk_limit, date, sentiment_model, avg(score) AS v, stddev_samp(score) AS s, count(*) AS n FROM chunk_scores GROUP BY ALL),"
        " w AS (SELECT chunk_limit, date, max(v) FILTER (sentiment_model = 'finbert') AS f, max(v) FILTER (sentiment_model = 'roberta') AS b, avg(s) AS s, sum(n) AS n FROM m GROUP BY ALL),"
        " k AS (SELECT chunk_limit, covar_samp(f, b) / nullif(stddev_samp(f) * stddev_samp(b), 0) AS r, avg(s) AS sigma, CAST(sum(n) AS BIGINT) AS n FROM w WHERE f IS NOT NULL AND b IS NOT NULL GROUP BY chunk_limit)"
        f" SELECT chunk_limit, {r('r', 'r')}, {r('sigma', 'sigma')}, n, {r('r / sigma', 'score')}, row_number() OVER (ORDER BY r / sigma DESC, chunk_limit) = 1 AS best FROM k",
    ),
)
def limit_metrics_argmax(spark, sf):
    """Cross-model correlation against the spread within a meeting, for each chunk size, and the best size."""
    from pyspark.sql import Window

    from ..functions.expressions import pearson

    m = chunk_scores(spark, sf).groupBy("chunk_limit", "date", "sentiment_model").agg(F.avg("score").alias("v"), F.stddev_samp("score").alias("s"), F.count(F.lit(1)).alias("n"))
    of = lambda name: F.max(F.when(F.col("sentiment_model") == name, F.col("v")))
    w = m.groupBy("chunk_limit", "date").agg(of("finbert").alias("f"), of("roberta").alias("b"), F.avg("s").alias("s"), F.sum("n").alias("n")).where("f IS NOT NULL AND b IS NOT NULL")
    k = w.groupBy("chunk_limit").agg(pearson("f", "b").alias("r"), F.avg("s").alias("sigma"), F.sum("n").alias("n")).withColumn("score", F.col("r") / F.col("sigma"))
    best = F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_limit")) == 1  # four rows
    return rounded(k.select("*", best.alias("best")), "r", "sigma", "score")


@query("divergence_mae_rmse", with_views("chunk_scores", sql=_MEANS + f", d AS (SELECT a.chunk_limit, a.mean - b.mean AS d FROM m AS a JOIN m AS b ON a.date = b.date AND b.chunk_limit = 200 WHERE a.chunk_limit <> 200) SELECT chunk_limit, {r('avg(abs(d))', 'mae')}, {r('sqrt(avg(d * d))', 'rmse')}, {r('max(abs(d))', 'max')} FROM d GROUP BY chunk_limit"))
def divergence_mae_rmse(spark, sf):
    m = chunk_scores(spark, sf).groupBy("chunk_limit", "date").agg(F.avg("score").alias("mean"))
    base = m.where("chunk_limit = 200").select("date", F.col("mean").alias("base"))
    d = m.where("chunk_limit <> 200").join(base, "date").select("chunk_limit", (F.col("mean") - F.col("base")).alias("d"))
    return rounded(d.groupBy("chunk_limit").agg(F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max(F.abs("d")).alias("max")), "mae", "rmse", "max")


@query("topic_reconciliation", with_views("chunk_scores", sql=" SELECT date, part, " + ", ".join(f"CAST(count(*) FILTER ({_CODE} = '{t}') AS BIGINT) AS {t.lower()}" for t in ("MP", "EP", "FS", "OI")) + ", CAST(count(*) AS BIGINT) AS total FROM chunk_scores GROUP BY GROUPING SETS ((date, part), ())"))
def topic_reconciliation(spark, sf):
    """Counts per section and topic with a row of grand totals."""
    from ..functions.expressions import topic_code

    s = chunk_scores(spark, sf).withColumn("code", topic_code("topic"))
    s.createOrReplaceTempView("_reconciled")
    cells = ", ".join(f"count_if(code = '{t}') AS {t.lower()}" for t in ("MP", "EP", "FS", "OI"))
    return spark.sql(f"SELECT date, part, {cells}, count(*) AS total FROM _reconciled GROUP BY GROUPING SETS ((date, part), ())")


@query("date_coverage", with_views("chunk_scores", "market", sql=" SELECT (SELECT count(DISTINCT date) FROM chunk_scores) AS meetings, (SELECT count(DISTINCT date) FROM market) AS months, (SELECT count(*) FROM (SELECT date FROM chunk_scores INTERSECT SELECT date FROM market)) AS both_n"))
def date_coverage(spark, sf):
    a, b = chunk_scores(spark, sf).select("date").distinct(), market(spark, sf).select("date")
    seen = a.select("date", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("date", F.lit(0), F.lit(1))).groupBy("date").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.agg(F.sum("a").alias("meetings"), F.sum("b").alias("months"), F.sum(F.col("a") * F.col("b")).alias("both_n"))


@query("row_paging", "SELECT CAST(page AS BIGINT) AS page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS page FROM orders) GROUP BY page")
def row_paging(spark, sf):
    """Inclusive ranges of 400 rows; see :func:`tidemark.sources.store.page_ranges`."""
    from ..sources.store import page_ranges

    return page_ranges(table(spark, sf, "orders"), "o_orderkey", 400).withColumnsRenamed({"first": "first_key", "last": "last_key"})


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf):
    """The last row of each key wins, as where an index lists a date twice."""
    return top_rows(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ("user_id",), 1, F.col("ts").desc(), F.col("event_id").desc()).drop("ts")
