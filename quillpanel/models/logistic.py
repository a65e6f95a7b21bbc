"""Penalised logistic regression by iteratively reweighted least squares.

Each round is one aggregate over the rows: the weighted second moments of the features and the weighted
residuals, whose size is the square of the number of features.  The driver solves that system; no row
reaches it, and a round's result depends on the rows only, not on their partitions' order.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticModel:
    features: list[str]
    coefficients: list[float]
    intercept: float
    rounds: int

    def probability(self) -> Column:
        """Probability of class 1; NULL where a feature is missing."""
        return _probability(self.features, [self.intercept, *self.coefficients])

    def score(self, df: DataFrame, label: str) -> DataFrame:
        """label, prediction and score (the probability) of the rows with all features."""
        rows = df.na.drop(subset=self.features).select(F.col(label).cast("int").alias("label"), self.probability().alias("score"))
        return rows.select("label", (F.col("score") > 0.5).cast("int").alias("prediction"), "score")

    def importance(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """Feature, size and sign of its coefficient, largest first."""
        rows = [(f, abs(b), -1 if b < 0 else 1) for f, b in zip(names or self.features, self.coefficients, strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double, sign int").orderBy(F.col("importance").desc(), "feature")


def _probability(features: list[str], beta: list[float]) -> Column:
    eta = F.lit(float(beta[0]))
    for f, b in zip(features, beta[1:], strict=True):
        eta = eta + F.col(f) * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def fit_logistic(
    df: DataFrame,
    features: list[str],
    label: str,
    weight: str | None = None,
    c: float = 1.0,
    max_rounds: int = 50,
    tolerance: float = 1e-10,
) -> LogisticModel:
    """The minimum of the weighted log loss plus the coefficients' squares over 2 ``c``; the intercept is free.

    ``label`` is 0 or 1; rows with a missing feature, label or weight don't count.  Features should be on
    one scale.  Rounds end when no coefficient moves by more than ``tolerance``, relative to the largest.
    Without rows, or with one class only, coefficients are 0 and the intercept is the class's bound.
    """
    p = len(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), w.alias("_w")).na.drop()
    terms = [F.lit(1.0), *[F.col(f) for f in features]]
    pairs = list(combinations_with_replacement(range(p + 1), 2))
    beta, penalty = np.zeros(p + 1), np.diag([0.0] + [1.0 / c] * p)
    seen = rows.agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("n1")).first()
    if not seen["n"] or seen["n1"] in (0.0, seen["n"]):
        bound = 0.0 if not seen["n"] else float("inf") if seen["n1"] else float("-inf")
        return LogisticModel(list(features), [0.0] * p, bound, 0)
    for round_no in range(1, max_rounds + 1):
        scored = rows.withColumn("_p", _probability(features, beta.tolist()))
        spread, rest = F.col("_w") * F.col("_p") * (1 - F.col("_p")), F.col("_w") * (F.col("_y") - F.col("_p"))
        sums = scored.agg(*[F.sum(spread * terms[i] * terms[j]) for i, j in pairs], *[F.sum(rest * t) for t in terms]).first()
        hessian = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, sums, strict=False):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + penalty, np.array(sums[len(pairs) :]) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    return LogisticModel(list(features), beta[1:].tolist(), float(beta[0]), round_no)
