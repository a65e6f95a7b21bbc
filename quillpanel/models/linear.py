"""Ridge regression, elasticities and counterfactuals of a linear model on the log scale.

Means and covariances are aggregated by Spark in one pass, per fold; they hold everything
that ridge and its cross-validation need.  What reaches the driver is a row per fold of
about p*p/2 numbers, whatever the number of rows, and the penalty is chosen from those.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.functions.classes import sign_word
from quillpanel.functions.numeric import ratio, shift_log
from quillpanel.models.solve import gathered, solved
from quillpanel.session import stage


@dataclass(frozen=True)
class Moments:
    """Row count, means and population covariances of the features and, last, the label."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        mean = self.mean + gap * other.n / n
        cov = (self.n * self.cov + other.n * other.cov + np.outer(gap, gap) * self.n * other.n / n) / n
        return Moments(n, mean, cov)


def fold_moments(df: DataFrame, columns: list[str], fold: str) -> list[Moments]:
    """Moments per fold from one grouped aggregate of the complete rows."""
    index = range(len(columns))
    pairs = list(combinations_with_replacement(index, 2))
    name = lambda i: F.col(columns[i]).cast("double")
    rows = (
        df.na.drop(subset=columns)
        .groupBy(fold)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(name(i)) for i in index]).alias("mean"),
            F.array(*[F.covar_pop(name(i), name(j)) for i, j in pairs]).alias("cov"),
        )
        .orderBy(fold)
        .collect()  # one row per fold
    )
    moments = []
    for r in rows:
        cov = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["cov"]):
            cov[i, j] = cov[j, i] = v
        moments.append(Moments(float(r["n"]), np.array(r["mean"]), cov))
    return moments


def _pooled(parts: list[Moments]) -> Moments:
    pooled = parts[0]
    for m in parts[1:]:
        pooled = pooled.plus(m)
    return pooled


def _solve(m: Moments, scale: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights for features divided by ``scale``, intercept not penalised."""
    gram = m.cov[:-1, :-1] / np.outer(scale, scale) * m.n
    target = m.cov[:-1, -1] / scale * m.n
    return np.linalg.solve(gram + alpha * np.eye(len(scale)), target)


def _held_out_r2(train: Moments, test: Moments, scale: np.ndarray, alpha: float) -> float:
    w = _solve(train, scale, alpha) / scale
    bias = (test.mean[-1] - train.mean[-1]) - (test.mean[:-1] - train.mean[:-1]) @ w
    spread = test.cov[-1, -1] - 2 * w @ test.cov[:-1, -1] + w @ test.cov[:-1, :-1] @ w
    return 1.0 - (spread + bias**2) / test.cov[-1, -1]


@dataclass(frozen=True)
class LinearModel:
    """Fitted coefficients in raw units, and as for features scaled to deviation 1."""

    features: list[str]
    raw: list[float]
    standardised: list[float]
    intercept: float
    alpha: float
    cv: list[tuple[float, float]]

    def predict(self, changed: dict[str, Column] | None = None) -> Column:
        """The prediction as one expression; ``changed`` replaces features by other columns."""
        changed = changed or {}
        terms = [changed.get(f, F.col(f)) * F.lit(float(b)) for f, b in zip(self.features, self.raw)]
        return sum(terms, F.lit(float(self.intercept)))

    def coefficient(self, feature: str) -> float:
        return self.raw[self.features.index(feature)]

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(s), float(r)) for f, s, r in zip(self.features, self.standardised, self.raw)]
        return spark.createDataFrame(rows, "feature string, coef_standardised double, elasticity double")

    def cv_scores(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(float(a), float(r)) for a, r in self.cv], "alpha double, mean_r2 double")


def ridge_cv(
    df: DataFrame, features: list[str], label: str, fold: str, alphas: list[float] | None = None
) -> LinearModel:
    """Ridge on standardised features with the penalty of the highest mean held-out R2, refitted on all rows."""
    parts = fold_moments(df, [*features, label], fold)
    everything = _pooled(parts)
    scale = np.sqrt(np.diag(everything.cov)[:-1])
    scores = []
    for alpha in alphas or V.RIDGE_ALPHAS:
        held_out = [
            _held_out_r2(_pooled([p for p in parts if p is not test]), test, scale, alpha) for test in parts
        ]
        scores.append((float(alpha), float(np.mean(held_out))))
    best = max(scores, key=lambda s: s[1])[0]
    w = _solve(everything, scale, best)
    raw = w / scale
    intercept = everything.mean[-1] - everything.mean[:-1] @ raw
    return LinearModel(list(features), raw.tolist(), w.tolist(), float(intercept), best, scores)


def moment_cells(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """fold, n, i, j, mean_i, mean_j, cov: a row for each fold and pair of ``columns``, from one grouped aggregate."""
    at = {p: k for k, p in enumerate(combinations_with_replacement(range(len(columns)), 2))}
    name = lambda i: F.col(columns[i]).cast("double")
    found = df.na.drop(subset=columns).groupBy(F.col(fold).cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(name(i)) for i in range(len(columns))]).alias("mean"),
        F.array(*[F.covar_pop(name(i), name(j)) for i, j in at]).alias("cov"),
    )
    cell = lambda i, j: F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("mean")[i].alias("mean_i"), F.col("mean")[j].alias("mean_j"),
        F.col("cov")[at[min(i, j), max(i, j)]].alias("cov"),
    )
    cells = [cell(i, j) for i in range(len(columns)) for j in range(len(columns))]
    return found.select("fold", F.col("n").cast("double").alias("n"), F.explode(F.array(*cells)).alias("c")).select("fold", "n", "c.*")


#: Stands for "no fold is held out".
NO_FOLD = -1


def _pooled_cells(cells: DataFrame) -> DataFrame:
    """test, n, i, j, mean_i, mean_j, cov of all folds but ``test``; folds are centred first, so nothing cancels."""
    folds = F.array_union(cells.agg(F.collect_set("fold")).scalar(), F.array(F.lit(NO_FOLD)))
    every = W.partitionBy("i", "j")  # a row per fold
    centre = lambda m: F.sum(F.col("n") * F.col(m)).over(every) / F.sum("n").over(every)
    rows = cells.withColumns({"centre_i": centre("mean_i"), "centre_j": centre("mean_j")})
    rows = rows.withColumn("test", F.explode(folds)).where("fold <> test")
    gap_i, gap_j, n = F.col("mean_i") - F.col("centre_i"), F.col("mean_j") - F.col("centre_j"), F.col("n")
    sums = rows.groupBy("test", "i", "j").agg(
        F.sum("n").alias("n"), F.max("centre_i").alias("centre_i"), F.max("centre_j").alias("centre_j"),
        F.sum(n * gap_i).alias("a"), F.sum(n * gap_j).alias("b"), F.sum(n * (F.col("cov") + gap_i * gap_j)).alias("s"),
    )
    a, b = F.col("a") / n, F.col("b") / n
    return sums.select("test", "n", "i", "j", (F.col("centre_i") + a).alias("mean_i"), (F.col("centre_j") + b).alias("mean_j"), (F.col("s") / n - a * b).alias("cov"))


def ridge_path(df: DataFrame, features: list[str], label: str, fold: str, alphas: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ridge on standardised features for every penalty, solved inside the plan.

    Returns the coefficients fitted on all rows (alpha, feature, coef_standardised, coef, intercept) and
    the scores (alpha, mean_r2) over held-out folds.  One aggregate reads the rows; what follows works on
    the square of the number of columns, times folds and penalties, in long tables of cells.
    """
    y = len(features)
    cells = stage(moment_cells(df, [*features, label], fold), "moments")
    pooled = stage(_pooled_cells(cells), "pooled")
    scale = pooled.where((F.col("test") == NO_FOLD) & (F.col("i") == F.col("j"))).select(F.col("i").alias("at"), F.sqrt("cov").alias("scale"))
    scale_of = lambda c: scale.withColumnRenamed("at", c).withColumnRenamed("scale", f"scale_{c}")
    # every table from here on has at most folds x penalties x columns^2 rows
    scaled = pooled.where(F.col("i") < y).join(F.broadcast(scale_of("i")), "i").join(F.broadcast(scale_of("j")), "j")
    scaled = scaled.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas or V.RIDGE_ALPHAS])))
    cell = F.col("n") * F.col("cov") / F.col("scale_i") / F.when(F.col("j") < y, F.col("scale_j")).otherwise(1.0)
    scaled = scaled.withColumn("cell", cell + F.when(F.col("i") == F.col("j"), F.col("alpha")).otherwise(0.0))
    systems = gathered(scaled, ["test", "alpha"], "i", "j", "cell")
    weights = systems.select("test", "alpha", F.posexplode(solved(F.col("matrix"), y)).alias("i", "w"))
    weights = weights.join(F.broadcast(scale_of("i")), "i").select("test", "alpha", "i", "w", (F.col("w") / F.col("scale_i")).alias("b"))
    weights = stage(weights, "weights")

    # with -1 as the label's own coefficient, a prediction's error is the sum of b times the columns
    of_label = weights.select("test", "alpha", F.lit(y).alias("i"), F.lit(None).cast("double").alias("w"), F.lit(-1.0).alias("b")).distinct()
    b = weights.union(of_label)
    own = cells.withColumnRenamed("fold", "test")
    left = b.select("test", "alpha", "i", F.col("b").alias("b_i"))
    right = b.select("test", "alpha", F.col("i").alias("j"), F.col("b").alias("b_j"))
    spread = own.join(left, ["test", "i"]).join(right, ["test", "alpha", "j"]).groupBy("test", "alpha").agg(
        F.sum(F.col("b_i") * F.col("b_j") * F.col("cov")).alias("spread"), F.max(F.when((F.col("i") == y) & (F.col("j") == y), F.col("cov"))).alias("of")
    )
    means = lambda d: d.where("i = j").select("test", "i", "mean_i")
    gaps = means(own).join(means(pooled).withColumnRenamed("mean_i", "fitted"), ["test", "i"]).join(left, ["test", "i"])
    bias = gaps.groupBy("test", "alpha").agg(F.sum(F.col("b_i") * (F.col("mean_i") - F.col("fitted"))).alias("bias"))
    r2 = 1 - (F.col("spread") + F.col("bias") * F.col("bias")) / F.col("of")
    scores = spread.join(bias, ["test", "alpha"]).groupBy("alpha").agg(F.avg(r2).alias("mean_r2"))

    final = weights.where(F.col("test") == NO_FOLD)
    mean = pooled.where((F.col("test") == NO_FOLD) & (F.col("i") == F.col("j"))).select("i", "mean_i")
    label_mean = mean.where(F.col("i") == y).agg(F.max("mean_i")).scalar()
    base = final.join(mean, "i").groupBy("alpha").agg(F.sum(F.col("b") * F.col("mean_i")).alias("at_mean"))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("i"))
    coefficients = final.join(base, "alpha").select(
        "alpha", name.alias("feature"), F.col("w").alias("coef_standardised"), F.col("b").alias("coef"), (label_mean - F.col("at_mean")).alias("intercept")
    )
    return coefficients, scores


def best_ridge(coefficients: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of the penalty with the highest mean held-out R2, the smaller one of equals."""
    best = scores.agg(F.max_by("alpha", F.struct("mean_r2", -F.col("alpha")))).scalar()
    return coefficients.where(F.col("alpha") == best)


def fit_ridge_pipeline(df: DataFrame, features: list[str], label: str, alpha: float) -> PipelineModel:
    """The same ridge as an ML pipeline on unscaled features.

    The estimator divides its squared loss by n and the label's deviation, so the penalty
    is alpha * stddev_pop(label) / n.
    """
    size = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    estimator = LinearRegression(
        labelCol=label, regParam=alpha * size["s"] / size["n"], elasticNetParam=0.0, solver="normal"
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator]).fit(df)


def ridge_two(df: DataFrame, x1: Column, x2: Column, y: Column, alpha: float) -> DataFrame:
    """Ridge of y on two standardised features, solved inside the aggregate: one pass, one row."""
    v = df.select(x1.alias("a"), x2.alias("b"), y.alias("y"))
    m = v.agg(
        F.count("y").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in "aby"],
        F.stddev_pop("a").alias("s_a"),
        F.stddev_pop("b").alias("s_b"),
        F.covar_pop("a", "b").alias("c_ab"),
        F.covar_pop("a", "y").alias("c_ay"),
        F.covar_pop("b", "y").alias("c_by"),
    )
    n, s_a, s_b = F.col("n"), F.col("s_a"), F.col("s_b")
    d = n + F.lit(float(alpha))  # scaled features have variance 1
    r, p, q = n * F.col("c_ab") / (s_a * s_b), n * F.col("c_ay") / s_a, n * F.col("c_by") / s_b
    det = d * d - r * r
    w1, w2 = ratio(d * p - r * q, det), ratio(d * q - r * p, det)
    out = m.select("n", w1.alias("w1"), w2.alias("w2"), "s_a", "s_b", "m_a", "m_b", "m_y")
    b1, b2 = ratio(F.col("w1"), F.col("s_a")), ratio(F.col("w2"), F.col("s_b"))
    return out.select(
        "n",
        F.col("w1").alias("coef1_standardised"),
        F.col("w2").alias("coef2_standardised"),
        b1.alias("coef1"),
        b2.alias("coef2"),
        (F.col("m_y") - b1 * F.col("m_a") - b2 * F.col("m_b")).alias("intercept"),
    )


def log_slope(df: DataFrame, y: str, x: str, by: str | None = None) -> DataFrame:
    """Elasticity of y on x: least-squares slope of the log1p values, with its standardised form."""
    ly, lx = F.log1p(F.col(y).cast("double")), F.log1p(F.col(x).cast("double"))
    logs = df.select(*([by] if by else []), ly.alias("ly"), lx.alias("lx")).where("ly IS NOT NULL AND lx IS NOT NULL")
    return logs.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        (F.regr_slope("ly", "lx") * F.stddev_pop("lx")).alias("coef_standardised"),
    )


def line_model(slope: DataFrame, feature: str) -> LinearModel:
    """The one-feature model of an ungrouped :func:`log_slope`, whose single row comes to the driver."""
    fit = slope.first()
    return LinearModel([feature], [fit["slope"]], [fit["coef_standardised"]], fit["intercept"], 0.0, [])


def shock_response(beta: Column, factor: Column) -> dict[str, Column]:
    """Closed form for a relative shock: multiplier, % change, the linear approximation and its error."""
    exact = (F.pow(factor, beta) - 1) * 100
    linear = beta * (factor - 1) * 100
    return {
        "multiplier": F.pow(factor, beta),
        "change_pct": exact,
        "linear_pct": linear,
        "linear_error": F.abs(exact - linear),
        "response": sign_word(beta),
    }


def counterfactual(df: DataFrame, model: LinearModel, feature: str, factor: float = V.SHOCK) -> DataFrame:
    """Prediction before and after one log-scale feature's level is multiplied, and the % change.

    Rows need all features; the frame is empty, not an error, where none has them.
    """
    if feature not in model.features:
        raise ValueError(f"{feature} is not a feature of the model")
    shifted = {feature: shift_log(F.col(feature), factor)}
    return (
        df.na.drop(subset=model.features)
        .withColumn("baseline", F.expm1(model.predict()))
        .withColumn("changed", F.expm1(model.predict(shifted)))
        .withColumn("change_pct", ratio(F.col("changed") - F.col("baseline"), F.col("baseline")) * 100)
    )


def interpret(coefficients: DataFrame, log_features: dict[str, str]) -> DataFrame:
    """Coefficients by size with a reading by the kind of feature.

    ``log_features`` maps the log-scale features to the word for their level.
    """
    number = F.format_string("%.3f", F.col("coef_standardised"))
    name = F.col("feature")
    reading = F.when(
        name.contains("pct") | name.contains("growth"), F.concat(F.lit("1 pp increase -> "), number, F.lit(" change in the log"))
    ).otherwise(F.concat(F.lit("1 unit increase -> "), number, F.lit(" change in the log")))
    for feature, word in log_features.items():
        text = F.concat(F.lit(f"1% {word} increase -> "), number, F.lit("% change"))
        reading = F.when(name == feature, text).otherwise(reading)
    return coefficients.withColumn("reading", reading).orderBy(F.abs("coef_standardised").desc(), "feature")


def with_category(coefficients: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Adds the named category of each feature."""
    rows = [(f, c) for c, members in categories.items() for f in members]
    table = coefficients.sparkSession.createDataFrame(rows, "feature string, category string")
    return coefficients.join(F.broadcast(table), "feature", "left")  # a short fixed list


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation, both taken from ``fit_on``; NULL for a constant column.

    With a ``suffix`` the standardised columns are added beside the originals.
    """
    fitted = (df if fit_on is None else fit_on).agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("f")
    ).scalar()
    return (
        df.withColumn("_fit", fitted)
        .withColumns({c + suffix: ratio(F.col(c) - F.col("_fit")[c]["m"], F.col("_fit")[c]["s"]) for c in columns})
        .drop("_fit")
    )
