"""Model quality from a table of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.numeric import ratio
from quillpanel.operators.ordered import ordered_totals


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, RMSE, MAE and MAPE, and RMSE and MAE after undoing log1p; one pass."""
    y, p = F.col(label), F.col(prediction)
    e, raw = y - p, F.expm1(y) - F.expm1(p)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - ratio(F.sum(e * e), F.count(y) * F.var_pop(y))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(ratio(e, y))) * 100).alias("mape"),
        F.sqrt(F.avg(raw * raw)).alias("rmse_original"),
        F.avg(F.abs(raw)).alias("mae_original"),
    )


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows with the residual and both values on the original scale."""
    return df.withColumns(
        {
            "residual": F.col(label) - F.col(prediction),
            "actual": F.expm1(label),
            "predicted": F.expm1(prediction),
        }
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2 x 2 table: one row per actual class, one column per predicted class."""
    hit = lambda c: F.count_if(F.col(prediction) == c).alias(f"predicted_{c}")
    return df.groupBy(F.col(label).cast("int").alias("actual")).agg(hit(0), hit(1)).orderBy("actual")


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts, accuracy, and precision, recall and F1 of class 1, each 0 where undefined; one pass."""
    is_ = lambda y, p: F.count_if((F.col(label) == y) & (F.col(prediction) == p))
    counts = df.agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.withColumns(
        {
            "accuracy": zero(ratio(tp + tn, tp + fp + fn + tn)),
            "precision": zero(ratio(tp, tp + fp)),
            "recall": zero(ratio(tp, tp + fn)),
            "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)),
        }
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    measures = {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}
    return ordered_totals(df, score, measures=measures)


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores counted half; 0.5 where a class is empty."""
    pairs = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    area = ratio(F.sum(pairs), F.max("pos_all") * F.max("neg_all").cast("double"))
    return _by_score(df, label, score).agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score (predict 1 at or above it), and the origin with no threshold."""
    at = _by_score(df, label, score).select(
        F.col(score).cast("double").alias("threshold"),
        ratio(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(at)


def best_model(metrics: DataFrame, name: str = "model", score: str = "f1", order: str = "model_no") -> DataFrame:
    """The model with the highest score, the first one on ties."""
    best: Column = F.max_by(name, F.struct(F.col(score), -F.col(order)))
    return metrics.agg(best.alias(name), F.max(score).alias(score))
