"""Canonical views of transcripts, scores and markets on the driver's tables, and the same views as SQL.

A meeting is a month of orders, an order is a scored chunk; a month of line items gives the market panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of up to so many bytes are dealt out where their files are fewer than the cores.
DEALT_BYTES = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a small table in one file would be one task's work. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= DEALT_BYTES and len(df.inputFiles()) < cores else df


def keyed(df: DataFrame, *keys: str, rows: int = 1 << 19) -> DataFrame:
    """df dealt by keys into as many parts as its rows ask for, so that a larger table has more of them, not larger ones."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, chunk_rowid, statement_id, part, is_question, chunk_limit, sentiment_model, topic, topic_prob, topic_model, score."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.date_trunc("month", "o_orderdate").cast("date").alias("date"),
        k.alias("chunk_rowid"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("statement_id"),
        F.when(k % 3 == 0, "IS").otherwise("QA").alias("part"),
        ((k % 3 != 0) & (k % 5 == 0)).alias("is_question"),
        F.element_at(F.array(*map(F.lit, (1, 50, 200, 350))), (k % 4 + 1).cast("int")).alias("chunk_limit"),
        F.when(F.col("o_custkey") % 2 == 0, "finbert").otherwise("roberta").alias("sentiment_model"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "MONETARY_POLICY_AND_INFLATION")
        .when(F.col("o_orderpriority") == "2-HIGH", "ECONOMIC_PERFORMANCE")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "FISCAL_AND_STRUCTURAL")
        .otherwise("OTHER_IRRELEVANT")
        .alias("topic"),
        ((k % 100).cast("double") / F.lit(100.0).cast("double")).alias("topic_prob"),
        F.when(k % 2 == 0, "facebook").otherwise("moritz").alias("topic_model"),
        ((F.floor("o_totalprice").cast("long") % 2001).cast("double") / F.lit(1000).cast("double") - 1).alias("score"),
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, mro, shadow, ois_1m, ois_3m, ois_6m, ois_1y, stoxx50: one row a month."""
    li = table(spark, sf_dir, "lineitem")
    edge = lambda x, k: F.round(x + F.lit(1.234e-9), k)  # noqa: E731  off the edges that means of round numbers lie on
    flag = lambda f, c: F.avg(F.when(F.col("l_returnflag") == f, F.col(c)))
    return li.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("date")).agg(
        edge(F.avg("l_tax") * 100, 1).alias("mro"),
        edge(F.avg("l_discount") * 100, 1).alias("shadow"),
        edge(flag("A", "l_discount"), 6).alias("ois_1m"),
        edge(flag("N", "l_discount"), 6).alias("ois_3m"),
        edge(flag("R", "l_discount"), 6).alias("ois_6m"),
        edge(flag("A", "l_tax"), 6).alias("ois_1y"),
        edge(F.avg("l_quantity") - 25, 6).alias("stoxx50"),
    )


def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, is_question, text, score: a conversation is a question time, its users ask."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", (F.col("role") == "user").alias("is_question"), "text", ((F.length("text") % 201).cast("double") / F.lit(100).cast("double") - 1).alias("score"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, pos, paragraph: lines of the documents."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))


VIEWS = {
    "chunk_scores": """chunk_scores AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderkey AS chunk_rowid,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS statement_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'IS' ELSE 'QA' END AS part, (o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0) AS is_question,
    CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 200 ELSE 350 END AS chunk_limit,
    CASE WHEN o_custkey % 2 = 0 THEN 'finbert' ELSE 'roberta' END AS sentiment_model,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'MONETARY_POLICY_AND_INFLATION' WHEN '2-HIGH' THEN 'ECONOMIC_PERFORMANCE'
      WHEN '3-MEDIUM' THEN 'FISCAL_AND_STRUCTURAL' ELSE 'OTHER_IRRELEVANT' END AS topic,
    CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS topic_prob,
    CASE WHEN o_orderkey % 2 = 0 THEN 'facebook' ELSE 'moritz' END AS topic_model,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 2001 AS DOUBLE) / CAST(1000 AS DOUBLE) - 1 AS score
  FROM orders)""",
    "market": """market AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(avg(l_tax) * 100 + 1.234e-9, 1) AS mro, round(avg(l_discount) * 100 + 1.234e-9, 1) AS shadow,
    round(avg(l_discount) FILTER (l_returnflag = 'A') + 1.234e-9, 6) AS ois_1m, round(avg(l_discount) FILTER (l_returnflag = 'N') + 1.234e-9, 6) AS ois_3m,
    round(avg(l_discount) FILTER (l_returnflag = 'R') + 1.234e-9, 6) AS ois_6m, round(avg(l_tax) FILTER (l_returnflag = 'A') + 1.234e-9, 6) AS ois_1y,
    round(avg(l_quantity) - 25 + 1.234e-9, 6) AS stoxx50
  FROM lineitem GROUP BY 1)""",
    "qa_turns": """qa_turns AS (
  SELECT conv_id, turn, role = 'user' AS is_question, text, CAST(length(text) % 201 AS DOUBLE) / CAST(100 AS DOUBLE) - 1 AS score
  FROM conversations WHERE role <> 'system')""",
    "paragraphs": """paragraphs AS (
  SELECT doc_id, source, lang, unnest(range(len(p))) AS pos, unnest(p) AS paragraph
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents))""",
}


def with_views(*names: str, sql: str) -> str:
    """The SQL with the named views in front; further common tables may follow a leading comma."""
    return "WITH " + ", ".join(VIEWS[n] for n in names) + sql
