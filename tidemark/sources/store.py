"""The transcript store: seven Parquet tables with explicit keys, loads and idempotent replacement."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SENTIMENT_MODELS, TABLES, TOPIC_MODELS
from .manifest import Versions


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under the one that driver and executors share; it goes at exit. Where no shared folder is named,
    a local one serves if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/tidemark-scratch/{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _scratch:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to ask
            return


atexit.register(_clean)


class Store:
    """Tables under one folder, each a sequence of versions (see ``manifest``): every load is one commit, and what has been
    read keeps its rows. chunks are partitioned by chunk_limit; scores by chunk_limit and model as well, so that replacing
    one (limit, model) writes one partition."""

    PARTITIONS = {"chunks": ["chunk_limit"], "sentiments": ["chunk_limit", "model_id"], "topics": ["chunk_limit", "model_id"]}

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def _schema(self, name: str):
        s = TABLES[name]
        if name in ("sentiments", "topics"):
            s = type(s)(list(s.fields)).add("chunk_limit", "integer")
        return s

    def versions(self, name: str) -> Versions:
        return Versions(self.spark, self.path(name), self._schema(name), self.PARTITIONS.get(name, []))

    def create(self, confirm: bool = False) -> None:
        """Empty tables and seeded dimensions; what is there goes, so it wants ``confirm``."""
        if not confirm:
            raise PermissionError("create(confirm=True) drops all tables")
        for name in TABLES:
            self.versions(name).commit(lambda _: [])
        for name, names in (("sentiment_models", SENTIMENT_MODELS), ("topic_models", TOPIC_MODELS)):
            self.versions(name).replace(self.spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], self._schema(name)))

    def ddl(self) -> dict[str, str]:
        """Each table's columns as DDL."""
        return {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._schema(n)) for n in TABLES}

    def read(self, name: str) -> DataFrame:
        return self.versions(name).read()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the files of older versions of all tables."""
        for name in TABLES:
            self.versions(name).vacuum(keep)

    # scans

    def statements(self) -> DataFrame:
        return self.read("statements")

    def chunks(self, limit: int | None = 200) -> DataFrame:
        """All columns, or key and text of one limit: one partition and two columns are read."""
        df = self.read("chunks")
        return df if limit is None else df.where(F.col("chunk_limit") == limit).select("chunk_rowid", "chunk")

    def limits(self) -> DataFrame:
        return self.read("chunks").select("chunk_limit").distinct()

    def topic_labels(self, version: int = 0) -> DataFrame:
        return self.read("topic_labels").where(F.col("version") == version).select("label_id", "name", "description")

    def sentiment(self, limit: int | None = 200, with_label: bool = False) -> DataFrame:
        """The star join: a row a chunk and sentiment model, with labels a row a topic and topic model as well."""
        se, ch = self.read("sentiments"), self.read("chunks")
        if limit is not None:
            se, ch = se.where(F.col("chunk_limit") == limit), ch.where(F.col("chunk_limit") == limit)
        models = self.read("sentiment_models").select("model_id", F.col("name").alias("sentiment_model"))
        out = se.drop("chunk_limit").join(ch, "chunk_rowid").join(self.read("statements"), "statement_id").join(F.broadcast(models), "model_id")  # models: two rows
        part = F.when(F.col("part") == 0, "IS").otherwise("QA").alias("part")
        cols = ["date", "chunk_rowid", "chunk_id", part, "is_question", "chunk_limit", "chunk", "score", "sentiment_model"]
        if with_label:
            t = self.read("topics").select("chunk_rowid", "label_id", F.col("prob").alias("topic_prob"), F.col("model_id").alias("topic_model_id"))
            lab = F.broadcast(self.read("topic_labels").select("label_id", F.col("name").alias("topic")))  # four labels a version
            tm = F.broadcast(self.read("topic_models").select(F.col("model_id").alias("topic_model_id"), F.col("name").alias("topic_model")))
            out = out.join(t, "chunk_rowid").join(lab, "label_id").join(tm, "topic_model_id")
            cols += ["topic", "topic_prob", "topic_model"]
        return out.select(*cols)

    def _of_model(self, name: str, models: str, model: str, limit: int) -> DataFrame:
        dim = F.broadcast(self.read(models).where(F.col("name") == model).select("model_id"))  # one row
        return self.read(name).where(F.col("chunk_limit") == limit).join(dim, "model_id")

    def scores(self, model: str, limit: int) -> DataFrame:
        """chunk_rowid, score of one limit and model."""
        return self._of_model("sentiments", "sentiment_models", model, limit).select("chunk_rowid", "score")

    def topics(self, model: str, limit: int) -> DataFrame:
        """chunk_rowid, topic, prob of one limit and model."""
        lab = F.broadcast(self.read("topic_labels").select("label_id", F.col("name").alias("topic")))  # a few labels a version
        return self._of_model("topics", "topic_models", model, limit).join(lab, "label_id").select("chunk_rowid", "topic", "prob")

    # loads

    def put_statements(self, df: DataFrame) -> None:
        """Replaces all statements; keys by date."""
        rows = numbered(df.select("date", "url", F.unix_date(F.to_date("date")).alias("_day")), "_day", ties=("date", "url"))
        self.versions("statements").replace(rows.select("date", "url", (F.col("rn") + 1).alias("statement_id")))

    def put_chunks(self, intro: DataFrame | None = None, qa: DataFrame | None = None) -> None:
        """Appends chunks of introductions and question times; keys follow (limit, statement, part, chunk)."""
        parts = [*([intro.withColumns({"part": F.lit(0), "is_question": F.lit(False)})] if intro is not None else []), *([qa.withColumn("part", F.lit(1))] if qa is not None else [])]
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        key = F.xxhash64("chunk_limit", "statement_id", "part", "chunk_id")
        df = df.withColumn("chunk_rowid", key).repartition("chunk_limit", "statement_id").sortWithinPartitions("statement_id", "part", "chunk_id")
        casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema("chunks")]
        self.versions("chunks").append(df.select(*casts))

    def put_topic_labels(self, labels: dict[str, str], version: int = 0) -> None:
        rows = [(100 * version + i + 1, n, d, version) for i, (n, d) in enumerate(labels.items())]
        self.versions("topic_labels").append(self.spark.createDataFrame(rows, self._schema("topic_labels")))

    def _replace(self, df: DataFrame, name: str, models: str, model: str, limit: int) -> None:
        """In one version what the model had of this limit goes, even where nothing comes."""
        found = self.read(models).where(F.col("name") == model).select("model_id").first()
        if found is None:
            raise ValueError(f"no model {model}")
        rows = df.withColumns({"model_id": F.lit(found.model_id), "chunk_limit": F.lit(limit)})
        self.versions(name).replace_part(rows, {"chunk_limit": limit, "model_id": found.model_id})

    def replace_sentiments(self, df: DataFrame, model: str, limit: int) -> None:
        """(chunk_rowid, score) of one limit and model; what was there goes in the same commit."""
        self._replace(df, "sentiments", "sentiment_models", model, limit)

    def replace_topics(self, df: DataFrame, model: str, limit: int, version: int = 0) -> None:
        """(chunk_rowid, topic name, prob) of one limit and model; names are resolved against the label dimension."""
        lab = F.broadcast(self.topic_labels(version).select("label_id", F.col("name").alias("topic")))
        self._replace(df.join(lab, "topic"), "topics", "topic_models", model, limit)

    def clear(self, name: str, limit: int, model_id: int) -> None:
        """Empties one partition of scores, in one version."""
        self.versions(name).replace_part(None, {"chunk_limit": limit, "model_id": model_id})


def _place(x: Column, cuts: list[float], base: int) -> Column:
    """How many of the ascending cuts are below x (0 for null), by binary search: as many comparisons as the number has digits."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(x > cuts[mid], _place(x, cuts[mid + 1 :], base + mid + 1)).otherwise(_place(x, cuts[:mid], base))


def numbered(df: DataFrame, order: str, name: str = "rn", ties: tuple[str, ...] = ()) -> DataFrame:
    """Row numbers from 0 in the order of a numeric column, without one global window: rows are numbered within ranges,
    then shifted by the rows of the ranges before (one row a range is what meets in a single task). The ranges' bounds
    are quantiles that are found first, so both uses of them agree."""
    parts = min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(order).cast("double")
    cuts = sorted(set(df.select(x.alias("x")).stat.approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ranged = df.withColumn("_p", _place(x, cuts, 0))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order, *ties)) - 1
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.withColumn("_o", own).join(F.broadcast(before), "_p").withColumn(name, (F.col("_o") + F.col("_b")).cast("long")).drop("_p", "_o", "_b")


def page_ranges(df: DataFrame, key: str, size: int = 400) -> DataFrame:
    """page, first, last, n: inclusive ranges of ``size`` rows in the order of a key."""
    rows = numbered(df.select(key), key)
    return rows.groupBy(F.floor(F.col("rn") / size).cast("long").alias("page")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of their key and the seed: the same on every run. Each task sends its first n rows only."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
