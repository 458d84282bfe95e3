"""Mixing sources to target weights.

Tokens are summed per source, targets are shared out by weight under a cap, and each document comes floor(rate) times
plus once more where a seeded hash of its id falls below the rate's fraction.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; an empty table gives no
rows; a source without words has target 0 and rate 0; rows repeated with one id share one draw, so each of them is
taken as often as the others; columns besides id, text and source pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_counted, settle, table, text_or_empty

#: Sources take these weights in turn, in the order of their names.
WEIGHTS = (1, 2, 3)
#: No target is above this many times its source's words, so no document is repeated more often.
MOST = 3
SEED = "mix-1"
#: Up to so many sources the table of rates (under 100 bytes a row) is broadcast; beyond, only those of many rows are.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on id and seed alone: 48 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, size) rows: source, source_size, target.

    Shares of the total by weight, where a source above ``most`` times its words is cut to that and the excess is
    shared again. The cut sources are the first in the order of words per weight, so running sums find them exactly,
    in whole numbers. The windows see one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (n % len(weights)) + 1).cast("long")
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("source_size") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    left = by.select("source", "source_size", n.alias("n"), w.alias("w")).select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("words_left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("weight_left"),
    )
    # in decimals, for sums of words times sums of weights pass 64 bits at some size
    cut = (cap.cast("decimal(20,0)") * F.col("weight_left").cast("decimal(18,0)")) <= (F.col("words_left").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)"))
    free = left.select("*", cut.alias("cut"))
    # the first uncut source has the most of both
    weight = F.max(F.when(~F.col("cut"), F.col("weight_left"))).over(every)
    words = F.max(F.when(~F.col("cut"), F.col("words_left"))).over(every)
    return free.select("source", "source_size", F.when(F.col("cut"), cap.cast("double")).otherwise((F.col("w") * words).cast("double") / weight.cast("double")).alias("target"))


def _with_source(rows: DataFrame, targets: DataFrame, light: DataFrame) -> DataFrame:
    """rows with their source's other columns of targets; light: a row with its source for each of rows."""
    if targets.count() <= BROADCAST_SOURCES:
        t = F.broadcast(targets.withColumnRenamed("source", "_source"))
        return rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    counts = light.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    per = settle(targets.select(key.alias("_key"), *[c for c in targets.columns if c != "source"]).join(counts, "_key"), "mix-rates")
    return join_counted(rows.withColumn("_key", key), per, "_key", "_rows").drop("_key", "_rows")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sized (source, size, ...) with source_size, target and rate."""
    targets = settle(source_targets(sized.select("source", "size"), weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return _with_source(sized, targets, sized.select("source")).select(*sized.columns, "source_size", "target", rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row as often as its source's rate and its draw say, all columns kept."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col("source"), word_count(text_or_empty()).alias("size"))
    light = settle(packed.select("source", "size"), "mix-sizes")
    targets = settle(source_targets(light, weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = _with_source(packed, targets.select("source", rate.alias("rate")), light)
    n = copies(F.col("_row.doc_id"), F.col("rate"), seed).cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), n)).alias("_copy")).select(*[F.col("_row").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = settle(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size")), "mix-sizes")
    got = rates(sized)
    return got.select("doc_id", "size", "source_size", "target", (copies(F.col("doc_id"), F.col("rate")) * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * source_size * weight_left <= words_left * w AS cut FROM o
), t AS (
  SELECT source, source_size, CASE WHEN cut THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(w * max(CASE WHEN NOT cut THEN words_left END) OVER () AS DOUBLE)
      / CAST(max(CASE WHEN NOT cut THEN weight_left END) OVER () AS DOUBLE) END AS target
  FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
