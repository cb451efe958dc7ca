"""Boosted trees for several classes, one set of trees a class, with class shares; fitted models are saved and loaded whole."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


class ClassShares(Transformer, HasInputCols, HasOutputCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """One vector of shares that sum to 1, from the probability vectors of one model a class, and the class with the largest
    (the first of equals).  Where no model gives its class a chance, all classes share alike."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, predictionCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = F.array(*(F.get(vector_to_array(c), F.lit(1)) for c in self.getInputCols()))
        n = len(self.getInputCols())
        rows = dataset.withColumn("__own", own).withColumn("__all", F.aggregate("__own", F.lit(0.0), lambda a, p: a + p))
        rows = rows.withColumn("__own", F.transform("__own", lambda p: F.when(F.col("__all") > 0, p / F.col("__all")).otherwise(F.lit(1.0 / n))))
        best = (F.array_position("__own", F.array_max("__own")) - 1).cast("double")
        return rows.withColumns({self.getOutputCol(): array_to_vector("__own"), self.getPredictionCol(): best}).drop("__own", "__all")


def boosted(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, step: float = 0.2, seed: int = 42, at_once: int = 4) -> PipelineModel:
    """A fitted pipeline that adds prediction, probability (shares by class, summing to 1) and predicted_label.

    Spark's boosted trees tell two classes apart, so there is one model for each class against all others; `at_once` of
    them are fitted at a time.  Rows with a null label are not learned from; null features keep a row from being
    predicted.  Classes are ordered by name.
    """
    index = StringIndexer(inputCol=label, outputCol="__code", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train.where(F.col(label).isNotNull()))
    gather = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip")
    rows = gather.transform(index.transform(train)).select("__features", "__code").cache()

    def one(k: int):
        trees = GBTClassifier(featuresCol="__features", labelCol="__mine", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
        model = trees.fit(rows.withColumn("__mine", (F.col("__code") == k).cast("double")))
        return model.setPredictionCol(f"__guess{k}").setRawPredictionCol(f"__raw{k}").setProbabilityCol(f"__share{k}")

    try:
        with ThreadPoolExecutor(at_once) as pool:
            models = list(pool.map(inheritable_thread_target(train.sparkSession)(one), range(len(index.labels))))
    finally:
        rows.unpersist()
    shares = ClassShares(inputCols=[f"__share{k}" for k in range(len(models))], outputCol="probability", predictionCol="prediction")
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)
    return PipelineModel([gather, *models, shares, names])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
