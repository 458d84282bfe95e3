"""Correlation tables, agreement, ranking and classification measures, all as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import changed, pairs, pearson
from ..schema import MIN_STD
from .gram import pair_correlations


def long_lags(long: DataFrame, max_lag: int, deltas: bool = False, order: str = "date") -> DataFrame:
    """(date, base, lag, value) for lags 0..max_lag of each feature, and of its first difference as d_feature.

    Long format: the windows are partitioned by feature, and thousands of lag columns never become a wide plan."""
    w = Window.partitionBy("feature").orderBy(order)
    base = long.select(order, F.col("feature").alias("base"), "value")
    if deltas:  # both kinds from one pass over the features
        d = F.struct(F.concat(F.lit("d_"), "feature").alias("base"), (F.col("value") - F.lag("value").over(w)).alias("value"))
        both = long.select(order, F.array(F.struct(F.col("feature").alias("base"), "value"), d).alias("x"))
        base = both.select(order, F.inline("x"))
    w = Window.partitionBy("base").orderBy(order)
    shifted = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("value")) for k in range(max_lag + 1)])
    return base.select(order, "base", shifted.alias("s")).select(order, "base", F.inline("s"))


def covered(counts: DataFrame, least: float = 5.0) -> DataFrame:
    """feature: those whose mean number of chunks is at least ``least``. counts: (feature, count)."""
    return counts.groupBy("feature").agg(F.avg("count").alias("c")).where(F.col("c") >= least).select("feature")


def correlation_table(lagged: DataFrame, targets: DataFrame, eras: DataFrame, least: int) -> DataFrame:
    """era, feature, base, lag, r, n, target: one pass over features x eras.

    targets: (date, target, y). eras: (era, start, end, target, changed_only); an era's rows may be in others too. The
    join with eras is by their bounds against a handful of broadcast rows."""
    y = targets.join(F.broadcast(eras), (targets["target"] == eras["target"]) & targets["date"].between(eras["start"], eras["end"])).where(~F.col("changed_only") | changed("y")).select("era", targets["date"], targets["target"], "y")
    rows = lagged.join(y, "date").where("value IS NOT NULL AND y IS NOT NULL")
    g = rows.groupBy("era", "base", "lag", "target").agg(pearson("value", "y").alias("r"), pairs("value", "y").alias("n"), F.stddev_samp("value").alias("sx"), F.stddev_samp("y").alias("sy"))
    ok = g.where((F.col("n") >= least) & (F.col("sx") >= MIN_STD) & (F.col("sy") >= MIN_STD))
    feature = F.when(F.col("lag") > 0, F.concat("base", F.lit(":lag"), "lag")).otherwise(F.col("base"))
    return ok.select("era", feature.alias("feature"), "base", "lag", F.round("r", 4).alias("r"), "n", "target")


def top_bases(corr: DataFrame, era: str, k: int, by: tuple[str, ...] = ("base",)) -> DataFrame:
    """The peak |r| row of each base in an era, best k of them."""
    w = Window.partitionBy(*by).orderBy(F.abs("r").desc(), "feature")
    best = corr.where(F.col("era") == era).select("*", F.row_number().over(w).alias("_k")).where("_k = 1").drop("_k")
    return best.orderBy(F.abs("r").desc(), "feature").limit(k)


def peak_pivot(corr: DataFrame, eras: list[str], focus: str, k: int = 25, need: tuple[str, ...] = ("Pre-ZLB", "ZLB", "Hiking")) -> DataFrame:
    """A row per base feature at its peak lag in the focus era, a column of r per era; rows lacking a needed era go."""
    best = F.broadcast(top_bases(corr, focus, 3 * k).select("feature"))  # at most 3k rows
    rows = corr.join(best, "feature", "left_semi")
    wide = rows.groupBy("feature").agg(*[F.first(F.when(F.col("era") == e, F.col("r")), ignorenulls=True).alias(e) for e in eras])
    wide = wide.dropna(subset=[e for e in need if e in eras])
    return wide.orderBy(F.abs(F.col(f"`{focus}`")).desc(), "feature").limit(k)


def fixed_lags(corr: DataFrame, lags: tuple[int, ...], focus: str, per_lag: int = 5) -> DataFrame:
    """The best features at each of some lags in the focus era, one per base and lag."""
    rows = corr.where((F.col("era") == focus) & F.col("lag").isin(*lags))
    one = Window.partitionBy("lag", "base").orderBy(F.abs("r").desc(), "feature")
    rows = rows.select("*", F.row_number().over(one).alias("_a")).where("_a = 1").drop("_a")
    w = Window.partitionBy("lag").orderBy(F.abs("r").desc(), "feature")
    return rows.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= per_lag)


def lag_profile(corr: DataFrame, focus: str, k: int = 6) -> DataFrame:
    """All rows of the k bases with the largest |r| in the focus era."""
    top = corr.where(F.col("era") == focus).groupBy("base").agg(F.max(F.abs("r")).alias("m")).orderBy(F.desc("m"), "base").limit(k)
    return corr.join(F.broadcast(top.select("base")), "base", "left_semi")  # k rows


def first_of_each(rows: DataFrame, name: str, place: str) -> DataFrame:
    """name, place, nth: each name once, at its first place, numbered in that order. rows: an ordered list of names."""
    one = rows.groupBy(name).agg(F.min(place).alias(place))
    return one.select(name, place, F.row_number().over(Window.orderBy(place)).alias("nth"))


def overlap(long: DataFrame, least: int = 20) -> DataFrame:
    """a, b, r, n for unordered pairs of features, by blocked Gram matrices; r is null where one doesn't vary."""
    return pair_correlations(long, least, flat=True).select("a", "b", F.round("r", 3).alias("r"), "n")


#: Labels of a confusion matrix at most.
MOST_LABELS = 1000


def confusion(df: DataFrame, a: str, b: str, share: bool = False) -> DataFrame:
    """a, b, n for every pair of labels, zeros included; ``share``: of the row's total. Labels that are in no pair with
    all others make a cell each, so the result has the square of their number: beyond MOST_LABELS it is refused."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(F.explode(F.array("a", "b")).alias("x")).distinct().limit(MOST_LABELS + 1)
    names = names.select(F.when(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > MOST_LABELS, F.raise_error(F.lit(f"more than {MOST_LABELS} labels"))).otherwise(F.lit(0)).alias("_ok"), "x").where("_ok = 0").select("x")
    cells = names.select(F.col("x").alias("a")).join(F.broadcast(names.select(F.col("x").alias("b"))), how="cross")
    out = cells.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.select("*", F.try_divide("n", F.sum("n").over(Window.partitionBy("a"))).alias("share")) if share else out


def kappa(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """[by], n, agreement, kappa from the contingency table."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    one = [F.lit(0).alias("_g")] if not by else []
    counts = counts.select("*", *one)
    keys = list(by) or ["_g"]
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("same"))
    side = lambda c, n: counts.groupBy(*keys, F.col(c).alias("_l")).agg(F.sum("_n").alias(n))
    chance = side("_a", "na").join(side("_b", "nb"), [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    g = total.join(chance, keys, "left").where(F.col("n") >= least)
    po, pe = F.col("same") / F.col("n"), F.coalesce("pe", F.lit(0)) / (F.col("n") * F.col("n"))
    return g.select(*by, "n", po.alias("agreement"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def auc(df: DataFrame, score: str, positive: str, by: tuple[str, ...] = ()) -> DataFrame:
    """[by], auc by ranks, ties at their mean. Counts per distinct score come first, so the window sees those only."""
    g = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(positive).cast("long")).alias("_p"), F.sum((~F.col(positive)).cast("long")).alias("_q"))
    w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_q").over(w), F.lit(0))
    ranked = g.select(*by, "_p", "_q", below.alias("_below"))
    return ranked.groupBy(*by).agg((F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)) / F.nullif(F.sum("_p") * F.sum("_q"), F.lit(0))).alias("auc"))


def classification_report(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support; and rows 'macro' and 'weighted'."""
    pairs_ = df.groupBy(F.col(y).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    names = pairs_.select(F.explode(F.array("y", "p")).alias("label")).distinct()
    true = pairs_.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs_.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    g = names.join(true, "label", "left").join(said, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hit", "said")])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    one = g.select("label", zero(F.try_divide("hit", "said")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"), zero(F.try_divide(2 * F.col("hit"), F.col("said") + F.col("support"))).alias("f1"), "support")
    m = one.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro").alias("label"), "precision", "recall", "f1", "support")
    v = one.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("weighted").alias("label"), "precision", "recall", "f1", "support")
    return one.unionAll(m).unionAll(v)


def word_counts(texts: DataFrame, text: str, by: tuple[str, ...], stopwords, least_length: int = 4) -> DataFrame:
    """[by], word, n: plain words that are long enough and no stopwords."""
    from ..functions.text import plain_words

    w = texts.select(*by, F.explode(F.split(plain_words(F.col(text)), " ")).alias("word")).where(F.length("word") >= least_length)
    stop = texts.sparkSession.createDataFrame([(s,) for s in sorted(stopwords)], "word string")
    return w.join(F.broadcast(stop), "word", "left_anti").groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def relative_frequency(counts: DataFrame, totals: DataFrame, by: str, least: int = 20) -> DataFrame:
    """by, word, ratio: a word's frequency per text in a group against that in all texts. totals: (by, texts)."""
    background = counts.groupBy("word").agg(F.sum("n").alias("all_n"))
    every = totals.agg(F.sum("texts").alias("all_texts"))
    rows = counts.where(F.col("n") >= least).join(background, "word").join(totals, by).crossJoin(F.broadcast(every))  # one row
    return rows.select(by, "word", "n", ((F.col("n") / F.col("texts")) / (F.col("all_n") / F.col("all_texts") + F.lit(1e-6))).alias("ratio"))


def word_polarity(rows: DataFrame, by: str, threshold: float, band: float, text: str, stopwords) -> DataFrame:
    """by, word, polarity, shift, side: (hawkish - dovish) / all of the strongly scored texts, against the whole."""
    strong = rows.where(F.abs("score") > threshold).withColumn("_hawk", F.col("score") > threshold)
    c = word_counts(strong, text, (by, "_hawk"), stopwords)
    h, d = F.sum(F.when(F.col("_hawk"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("_hawk"), F.col("n")).otherwise(0))
    ratio = lambda g: g.select("*", ((F.col("h") - F.col("d")) / F.greatest(F.col("h") + F.col("d"), F.lit(1))).alias("polarity")).drop("h", "d")
    one = ratio(c.groupBy(by, "word").agg(h.alias("h"), d.alias("d")))
    whole = ratio(c.groupBy("word").agg(h.alias("h"), d.alias("d"))).withColumnRenamed("polarity", "whole")
    shift = F.col("polarity") - F.col("whole")
    return one.join(whole, "word").select(by, "word", "polarity", shift.alias("shift"), F.when(shift > band, "hawkish").when(shift < -band, "dovish").otherwise("neutral").alias("side"))


def changed_lag_correlation(df: DataFrame, x: str, y: str, max_lag: int, least: int = 8, order: str = "date", max_lead: int = 0) -> DataFrame:
    """lag, r, n of x some rows back (ahead, if the lag is negative) against y, over the rows where y changed (a missing y
    counts as a change)."""
    w = Window.orderBy(order)  # a row a meeting
    rows = df.where(changed(y)).select(F.col(y).alias("_y"), F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(x, k).over(w).alias("_x")) for k in range(-max_lead, max_lag + 1)]).alias("s"))
    g = rows.select("_y", F.inline("s")).where("_x IS NOT NULL AND _y IS NOT NULL").groupBy("lag").agg(pearson("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


#: Fixed value: |r| over 20 pairs at which the two-sided p is 0.05.
CRITICAL_R_20 = 0.4438
