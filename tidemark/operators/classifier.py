"""Text classifiers trained here: hashed word n-grams and a multinomial logit, fitted over all partitions.

The features are counts of words and of pairs of neighbouring words in 2 ** bits slots, weighted by how few texts have them and scaled
to length one.
The logit is fitted by Spark's own optimiser: each step sums the gradient of every labelled text over the partitions.
Scoring stays in the JVM. A model is saved to and loaded from the shared folder and has the interface that scoring jobs
take beside functions of lists of texts.

Defined cases: null texts are empty; an empty text gets the classes' shares; rows without a label don't count; a label of
its own for all rows gives a model of one class; no labelled rows are an error.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col

#: Fixed by choice: slots of the hashed features, weight of the penalty, steps and their tolerance.
BITS, PENALTY, STEPS, TOLERANCE = 16, 1e-4, 25, 1e-6


def grams(text):
    """Words in lower case, runs of letters; of null texts none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


class TextClassifier:
    """A fitted model; ``score`` gives all classes' scores of each text, the best first."""

    def __init__(self, model: PipelineModel):
        self.model = model
        self.labels: list[str] = model.stages[0].labels

    @classmethod
    def fit(cls, df: DataFrame, text: str, label: str, bits: int = BITS, penalty: float = PENALTY, steps: int = STEPS, tolerance: float = TOLERANCE) -> TextClassifier:
        rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), grams(text).alias("_words"))
        half = 1 << (bits - 1)
        stages = [
            StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc"),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            HashingTF(numFeatures=half, inputCol="_words", outputCol="_one"),
            HashingTF(numFeatures=half, inputCol="_pairs", outputCol="_two"),
            VectorAssembler(inputCols=["_one", "_two"], outputCol="_counts"),
            IDF(inputCol="_counts", outputCol="_rare"),
            Normalizer(inputCol="_rare", outputCol="_x"),  # else a text's length would decide
            LogisticRegression(family="multinomial", featuresCol="_x", labelCol="_y", regParam=penalty, standardization=False, maxIter=steps, tol=tolerance, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class"),
        ]
        return cls(Pipeline(stages=stages).fit(rows))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        return cls(PipelineModel.read().session(spark).load(path))

    def features(self, df: DataFrame, text: str) -> DataFrame:
        """df with the feature vector ``_x``."""
        out = df.select("*", grams(text).alias("_words"))
        for stage in self.model.stages[1:-1]:
            out = stage.transform(out)
        return out.drop("_words", "_pairs", "_one", "_two", "_counts", "_rare")

    def score(self, df: DataFrame, text: str, to: str = "output") -> DataFrame:
        """df with ``to``, an array of struct(label, score)."""
        scored = self.model.stages[-1].transform(self.features(df, text))
        names = F.array(*[F.lit(x) for x in self.labels])
        zipped = F.zip_with(names, vector_to_array("_p"), lambda a, b: F.struct(a.alias("label"), b.alias("score")))
        ordered = F.array_sort(zipped, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1))
        return scored.select(*[c for c in df.columns], ordered.alias(to))


def score_of(output, label: str):
    """A class's score among all of a text's."""
    return F.get(F.filter(output, lambda x: x["label"] == label), 0)["score"]
