"""Schemas, enumerations and small dimension tables of the transcript store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Sizes of chunks in words, and the names that the dimension tables are seeded with.
CHUNK_LIMITS = (1, 50, 200, 350)
SENTIMENT_MODELS = ("finbert", "roberta")
TOPIC_MODELS = ("facebook", "moritz")
TOPIC_CODES = {"MONETARY_POLICY_AND_INFLATION": "MP", "ECONOMIC_PERFORMANCE": "EP", "FISCAL_AND_STRUCTURAL": "FS", "OTHER_IRRELEVANT": "OI"}
PARTS = ("IS", "QA")
QA_OPTIONS = ("both_divided", "both_together", "just_answers", "just_questions")
STATS = ("max", "mean", "min", "std", "count")

#: Eras of the correlation tables, both ends included. An era may hold others.
ERAS_V1 = (("Full", "1999-01-01", "2024-12-31"), ("Pre-ZLB", "1999-01-01", "2011-12-31"), ("ZLB", "2012-01-01", "2022-06-30"), ("Hiking", "2022-07-01", "2025-12-31"))
ERAS_V2 = (
    ("Full_composite", "1999-01-01", "2025-12-31", "composite_diff", True),
    ("Full", "1999-01-01", "2025-12-31", "MRO_diff", True),
    ("Pre-ZLB", "1999-01-01", "2011-12-31", "MRO_diff", True),
    ("ZLB", "2012-01-01", "2022-06-30", "shadow_diff", False),
    ("Hiking", "2022-07-01", "2025-12-31", "MRO_diff", True),
)
EVENT_ERAS = (("Pre-ZLB", "1999-01-01", "2011-12-31"), ("Post-ZLB", "2022-07-01", "2026-12-31"))
PAIR_ERAS = (("1999-2011", "1999-01-01", "2011-12-31"), ("2012-2021", "2012-01-01", "2021-12-31"), ("2022-2024", "2022-01-01", "2024-12-31"))
WORD_ERAS = (("1999-2007", 1999, 2007), ("2008-2013", 2008, 2013), ("2014-2019", 2014, 2019), ("2020-2021", 2020, 2021), ("2022-2024", 2022, 2024))
ZLB = ("2012-01-01", "2022-07-01")

#: Limits of the statistics.
MAX_LAG, MIN_OBS_V1, MIN_OBS_V2, MIN_STD, MIN_CHUNKS = 15, 8, 15, 1e-8, 5
FIXED_LAGS = (1, 2, 5, 7, 11)
MIN_SHADOW_CHANGE = 0.10
WORD_THRESHOLD, WORD_MIN_COUNT, POLARITY_BAND = 0.15, 20, 0.1
LABEL_THRESHOLD, IRRELEVANT_PROB = 0.45, 0.7
ROLLING_DAYS, ROLLING_ROWS, ROLLING_MIN = 180, 20, 10


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
STATEMENTS = _struct(("statement_id", _L), ("date", T.DateType()), ("url", _S))
CHUNKS = _struct(("chunk_rowid", _L), ("statement_id", _L), ("part", _I), ("chunk_id", _I), ("is_question", _B), ("chunk_limit", _I), ("chunk", _S))
MODELS = _struct(("model_id", _I), ("name", _S))
SENTIMENTS = _struct(("chunk_rowid", _L), ("model_id", _I), ("score", _D))
TOPIC_LABELS = _struct(("label_id", _I), ("name", _S), ("description", _S), ("version", _I))
TOPICS = _struct(("chunk_rowid", _L), ("label_id", _I), ("prob", _D), ("model_id", _I))
TRANSCRIPT = _struct(("statement_id", _L), ("date", _S), ("url", _S), ("intro", _S), ("qa", _S))
SHOCKS = _struct(("date", _S), ("pc1", _D), ("STOXX50", _D), ("MP_pm", _D), ("CBI_pm", _D), ("MP_median", _D), ("CBI_median", _D))
EVENT_STUDY = _struct(("date", _S), ("OIS_1M", _D), ("OIS_3M", _D), ("OIS_6M", _D), ("OIS_1Y", _D), ("STOXX50", _D))
MONEY_MARKET = _struct(("date", _S), ("MRO", _D), ("MRO announced", _D), ("Wu-Xia shadow rate", _D))
TABLES = {"statements": STATEMENTS, "chunks": CHUNKS, "sentiment_models": MODELS, "sentiments": SENTIMENTS, "topic_labels": TOPIC_LABELS, "topics": TOPICS, "topic_models": MODELS}


def eras(spark: SparkSession, rows=ERAS_V1) -> DataFrame:
    """(era, start, end) as dates; a handful of constant rows."""
    return spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "era string, start string, end string").selectExpr("era", "to_date(start) AS start", "to_date(end) AS end")


def labels(is_qa: bool, qa_options: str, with_label: bool) -> list[str]:
    """All column labels that a pivot may give, in order, so that its schema does not depend on the data."""
    out = []
    for model in SENTIMENT_MODELS:
        for part in PARTS if is_qa else ("",):
            kinds = ("",)
            if qa_options == "both_divided" and part != "IS":
                kinds = ("answer", "question")
            for kind in kinds:
                for topic in TOPIC_CODES.values() if with_label else ("",):
                    out.append("_".join(x for x in (model, part, kind, topic) if x))
    return sorted(out)
