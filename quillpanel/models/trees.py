"""Forest regression and the three outcome classifiers: trees by :mod:`quillpanel.models.grow`, the logistic model on pyspark.ml."""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.models.grow import Boosted, Forest, Grower, Grown
from quillpanel.models.metrics import auc, binary_metrics

# Model settings
FOREST_REGRESSION = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 5, "seed": V.SEED}
FOREST = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 3, "seed": V.SEED}
BOOSTED = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1, "seed": V.SEED}
LOGISTIC_ITERATIONS, LOGISTIC_C = 1000, 1.0
CLASSIFIERS = ["Random Forest", "Gradient Boosting", "Logistic Regression"]


def spread(df: DataFrame) -> DataFrame:
    """Training rows over all cores: a small stored table may sit in a single file."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _assembled(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])


def fit_forest_regression(df: DataFrame, features: list[str], label: str, **settings) -> Grown:
    """Forest that looks at all features at each split."""
    method = Forest(**{**FOREST_REGRESSION, **settings}, most_features=len(features), classes=False)
    return Grower(features, label, method).fit(spread(df))


def classifier(name: str, features: list[str], label: str, weight: str, n_rows: int, **settings) -> Pipeline | Grower:
    """One of :data:`CLASSIFIERS`, unfitted.

    The forest and the logistic model take the row weights (balanced classes), the boosted
    trees do not.  The logistic model wants features standardised on the training rows
    (:func:`quillpanel.models.linear.standardise`); the estimator's own scaling would use
    the row weights.  Its penalty 1/C on the summed loss is 1/(C n) on the mean loss that
    the estimator minimises, as balanced weights add up to n.
    """
    if name == "Random Forest":
        most = ceil(sqrt(len(features)))
        return Grower(features, label, Forest(**{**FOREST, **settings}, most_features=most, classes=True), weight)
    if name == "Gradient Boosting":
        return Grower(features, label, Boosted(**{**BOOSTED, **settings}))
    if name == "Logistic Regression":
        estimator = LogisticRegression(
            labelCol=label,
            weightCol=weight,
            elasticNetParam=0.0,
            standardization=False,
            **{"maxIter": LOGISTIC_ITERATIONS, "regParam": 1.0 / (LOGISTIC_C * n_rows), **settings},
        )
    else:
        raise ValueError(f"unknown classifier {name!r}")
    return _assembled(features, estimator)


def score(model: PipelineModel | Grown, df: DataFrame, label: str) -> DataFrame:
    """label, prediction and the probability of class 1."""
    return model.transform(df).select(
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def evaluate(model: PipelineModel | Grown, train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Train accuracy, test metrics of class 1 and AUC as one row."""
    return judged(score(model, train, label), score(model, test, label))


def judged(on_train: DataFrame, scored: DataFrame) -> DataFrame:
    """Accuracy of the scored training rows, metrics of class 1 and AUC of the scored test rows, as one row."""
    fitted = binary_metrics(on_train).select(F.col("accuracy").alias("a")).scalar()
    return binary_metrics(scored).select(
        fitted.alias("train_accuracy"), "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1",
        auc(scored).scalar().alias("auc"),
    )


class ClassOneF1(Evaluator):
    """F1 of class 1, 0 where a fold has neither a positive label nor a positive prediction."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(binary_metrics(dataset, self.label).first()["f1"])


def cross_validated_f1(pipeline: Pipeline | Grower, df: DataFrame, label: str, fold: str, k: int, parallelism: int = 2) -> tuple[float, float]:
    """Mean and population deviation of class 1's F1 over given folds; trees of all folds are grown side by side."""
    if isinstance(pipeline, Grower):
        models = pipeline.fit_folds(spread(df), fold, k)
        judge = ClassOneF1(label)
        found = [judge.evaluate(model.transform(df.where(F.col(fold) == g))) for g, model in enumerate(models)]
        return float(np.mean(found)), float(np.std(found))
    assembler, estimator = pipeline.getStages()
    read = dict.fromkeys([*assembler.getInputCols(), label, estimator.getWeightCol(), fold])  # the validator keeps its rows in memory
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=ClassOneF1(label),
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
        collectSubModels=False,
    )
    fitted = validator.fit(spread(df.select(*read)))
    return float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def importance(model: PipelineModel | Grown, features: list[str]) -> DataFrame:
    """Feature, importance and sign, highest first.

    Trees give their importances, a logistic model the size of its coefficients.
    """
    if isinstance(model, Grown):
        rows = [(f, float(v), 1) for f, v in zip(features, model.importances)]
    else:
        fitted = model.stages[-1]
        rows = [(f, abs(float(c)), -1 if c < 0 else 1) for f, c in zip(features, fitted.coefficients.toArray())]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double, sign int")
    return frame.orderBy(F.col("importance").desc(), "feature")


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
