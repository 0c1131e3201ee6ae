"""Classifiers on feature columns, fitted by Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_forest(rows: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 0) -> PipelineModel:
    """A random forest; a null feature counts as 0, rows without a label are left out, labels are in order of the alphabet."""
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    gather = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", numTrees=trees, maxDepth=depth, seed=seed)
    fitted = Pipeline(stages=[index, gather, forest]).fit(rows.na.fill(0, features))
    names = IndexToString(inputCol="_p", outputCol="predicted", labels=fitted.stages[0].labels)
    return PipelineModel(stages=[*fitted.stages[1:], names])


def classify(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``predicted`` and the probability of it, ``confidence``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.na.fill(0, features))
    return out.select(*rows.columns, "predicted", F.array_max(vector_to_array("_q")).alias("confidence"))
