"""Ridge against NumPy, exact splits, metrics against definitions, and invariants of the fitted models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from quillpanel import fixed_values as V
from quillpanel.models import linear, logistic, metrics, splits, trees
from quillpanel.models.solve import solved

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 503
    x = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1] + [0.0, 100.0, -5.0]
    x[:, 1] += 5 * x[:, 0]
    y = 2 + 0.6 * x[:, 0] - 0.02 * x[:, 1] + 3 * x[:, 2] + rng.normal(scale=0.5, size=n)
    return pd.DataFrame({"e": np.arange(n) // 7, "t": np.arange(n) % 7, **{f: x[:, i] for i, f in enumerate(FEATURES)}, "y": y})


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data.sample(frac=1, random_state=0)).repartition(5)


def brute_force(data, alphas):
    """Scaled features, contiguous folds in row order, mean held-out R2 per penalty, refit."""
    x = data[FEATURES].to_numpy()
    xs, y = (x - x.mean(0)) / x.std(0), data["y"].to_numpy()

    def fit(x, y, alpha):
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
        return w, y.mean() - x.mean(0) @ w

    scores = []
    for alpha in alphas:
        r2 = []
        for test in np.array_split(np.arange(len(y)), 5):
            train = np.setdiff1d(np.arange(len(y)), test)
            w, b = fit(xs[train], y[train], alpha)
            e = y[test] - xs[test] @ w - b
            r2.append(1 - (e**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    best = alphas[int(np.argmax(scores))]
    return scores, best, fit(xs, y, best)[0], x.std(0)


def test_ridge_cv_matches_numpy(spark, frame, data):
    folded = splits.contiguous_folds(frame, ["e", "t"], 5)
    model = linear.ridge_cv(folded, FEATURES, "y", "fold")
    scores, best, w, s = brute_force(data, V.RIDGE_ALPHAS)
    np.testing.assert_allclose([r for _, r in model.cv], scores, atol=1e-10)
    assert model.alpha == best
    np.testing.assert_allclose(model.standardised, w, atol=1e-10)
    np.testing.assert_allclose(model.raw, w / s, atol=1e-10)
    assert model.cv_scores(spark).count() == len(V.RIDGE_ALPHAS)


def test_ridge_pipeline_gives_the_same_line(frame, data):
    folded = splits.contiguous_folds(frame, ["e", "t"], 5)
    model = linear.ridge_cv(folded, FEATURES, "y", "fold", alphas=[10.0])
    fitted = linear.fit_ridge_pipeline(frame, FEATURES, "y", 10.0)
    np.testing.assert_allclose(fitted.stages[-1].coefficients.toArray(), model.raw, atol=1e-8)
    gap = fitted.transform(frame).select(F.max(F.abs(F.col("prediction") - model.predict()))).first()[0]
    assert gap < 1e-8


def test_ridge_on_two_features_matches(frame):
    folded = splits.contiguous_folds(frame, ["e", "t"], 5)
    model = linear.ridge_cv(folded, ["a", "b"], "y", "fold", alphas=[7.0])
    row = linear.ridge_two(frame, F.col("a"), F.col("b"), F.col("y"), 7.0).first()
    assert [row["coef1"], row["coef2"], row["intercept"]] == pytest.approx([*model.raw, model.intercept], abs=1e-9)


def test_contiguous_folds_are_those_of_the_sorted_rows(frame, data):
    got = splits.contiguous_folds(frame, ["e", "t"], 5).toPandas().sort_values(["e", "t"])["fold"].tolist()
    assert got == [i for i, part in enumerate(np.array_split(np.arange(len(data)), 5)) for _ in part]


def test_shock_goldens(spark):
    df = spark.createDataFrame([(0.6719, 1.10)], "beta double, factor double")
    row = df.select(*[c.alias(k) for k, c in linear.shock_response(F.col("beta"), F.col("factor")).items()]).first()
    assert row["multiplier"] == pytest.approx(1.0661, abs=5e-5) and row["change_pct"] == pytest.approx(6.61, abs=0.005)
    assert row["linear_pct"] == pytest.approx(6.719) and row["response"] == "inelastic"


def test_counterfactual(spark):
    model = linear.LinearModel(["log_base", "z"], [0.5, 1.0], [0.5, 1.0], 1.0, 0.0, [])
    df = spark.createDataFrame([(1, 2.0, 0.5), (2, 3.0, None)], "e int, log_base double, z double")
    row = linear.counterfactual(df, model, "log_base", 1.10).collect()
    before = np.exp(1 + 1 + 0.5) - 1
    after = np.exp(1 + 0.5 * (2 + np.log(1.1)) + 0.5) - 1
    assert len(row) == 1 and row[0]["change_pct"] == pytest.approx((after - before) / before * 100)
    assert linear.counterfactual(df.where("e = 2"), model, "log_base").count() == 0
    with pytest.raises(ValueError):
        linear.counterfactual(df, model, "absent")


@pytest.fixture(scope="module")
def classes(spark):
    """Two separable classes, one in six rows positive."""
    rng = np.random.default_rng(5)
    n = 300
    label = (np.arange(n) % 6 == 0).astype(int)
    pdf = pd.DataFrame({"k": np.arange(n), "label": label, "x": rng.normal(size=n) + 2.5 * label, "z": rng.normal(size=n)})
    return spark.createDataFrame(pdf).withColumn("label", F.col("label").cast("int")).repartition(4)


def test_split_has_exact_quotas_whatever_the_partitions(classes):
    train, test = splits.stratified_split(classes, "k", "label")
    again = splits.stratified_split(classes.repartition(9), "k", "label")[1]
    sizes = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert sizes in ({0: 62, 1: 13}, {0: 63, 1: 12}) and train.count() == 225
    assert {r["k"] for r in test.collect()} == {r["k"] for r in again.collect()}
    assert train.join(test, "k").count() == 0


def test_quotas_give_remainders_to_the_largest_fractions():
    assert splits.test_quotas({0: 160, 1: 38}, 0.25) == {0: 40, 1: 10}
    assert sum(splits.test_quotas({0: 11, 1: 7}, 0.25).values()) == 5


def test_stratified_folds_keep_class_shares(classes):
    rows = splits.stratified_folds(classes, "k", "label", 5).groupBy("fold", "label").count().collect()
    assert {(r["label"], r["count"]) for r in rows} == {(0, 50), (1, 10)} and len(rows) == 10


def test_balanced_weights(classes):
    got = {r["label"]: r["w"] for r in splits.balanced_weights(classes, "label").groupBy("label").agg(F.first("weight").alias("w")).collect()}
    assert got == {0: pytest.approx(300 / 500), 1: pytest.approx(300 / 100)}


@pytest.mark.parametrize(
    "tp, fp, fn, expected",
    [(3, 1, 6, (0.860, 0.750, 0.333, 0.462)), (3, 2, 6, (0.840, 0.600, 0.333, 0.429)), (6, 3, 3, (0.880, 0.667, 0.667, 0.667))],
)
def test_metrics_of_known_counts(spark, tp, fp, fn, expected):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * (50 - tp - fp - fn)
    df = spark.createDataFrame(rows, "label int, prediction int")
    row = metrics.binary_metrics(df).first()
    assert tuple(row[m] for m in ("accuracy", "precision", "recall", "f1")) == pytest.approx(expected, abs=5e-4)
    table = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in metrics.confusion(df).collect()}
    assert table == {1: (fn, tp), 0: (50 - tp - fp - fn, fp)}


def test_undefined_metrics_are_zero(spark):
    row = metrics.binary_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert metrics.auc(spark.createDataFrame([(0, 0.3)], "label int, score double")).first()["auc"] == 0.5


def test_auc_and_roc(classes):
    scored = classes.select("label", F.round("x", 1).alias("score"))
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scored)
    assert metrics.auc(scored).first()["auc"] == pytest.approx(expected, abs=1e-9)
    points = metrics.roc_points(scored).orderBy("fpr", "tpr").toPandas()
    assert (points[["fpr", "tpr"]].iloc[0] == 0).all() and (points[["fpr", "tpr"]].iloc[-1] == 1).all()
    assert np.trapezoid(points["tpr"], points["fpr"]) == pytest.approx(expected, abs=1e-9)


def test_best_model_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(0, "A", 0.5), (1, "B", 0.7), (2, "C", 0.7)], "model_no int, model string, f1 double")
    assert metrics.best_model(df).first()["model"] == "B"


@pytest.mark.parametrize("name", trees.CLASSIFIERS)
def test_classifiers_on_separable_classes(classes, name):
    weighted = splits.balanced_weights(classes, "label")
    train, test = splits.stratified_split(weighted, "k", "label")
    small = {"Random Forest": {"numTrees": 20}, "Gradient Boosting": {"maxIter": 5}}.get(name, {})
    model = trees.classifier(name, ["x", "z"], "label", "weight", 225, **small).fit(train)
    row = trees.evaluate(model, train, test, "label").first()
    assert row["auc"] > 0.8 and 0 <= row["f1"] <= 1 and row["train_accuracy"] > 0.8
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 75
    ranked = trees.importance(model, ["x", "z"]).collect()
    assert ranked[0]["feature"] == "x"
    if name != "Logistic Regression":
        assert sum(r["importance"] for r in ranked) == pytest.approx(1.0)


def test_logistic_penalty_matches_newton(classes):
    pdf = splits.balanced_weights(classes, "label").toPandas()
    x = pdf[["x", "z"]].to_numpy()
    xs = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    y, w, beta = pdf["label"].to_numpy(), pdf["weight"].to_numpy(), np.zeros(3)
    penalty = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xs @ beta))
        beta -= np.linalg.solve((xs.T * (w * p * (1 - p))) @ xs + penalty, xs.T @ (w * (p - y)) + penalty @ beta)
    scaled = linear.standardise(splits.balanced_weights(classes, "label"), ["x", "z"])
    model = trees.classifier("Logistic Regression", ["x", "z"], "label", "weight", len(y)).fit(scaled)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), beta[1:], atol=1e-4)


def test_cross_validated_f1(classes):
    folded = splits.stratified_folds(splits.balanced_weights(classes, "label"), "k", "label", 3)
    pipeline = trees.classifier("Logistic Regression", ["x", "z"], "label", "weight", 300)
    mean, deviation = trees.cross_validated_f1(pipeline, folded, "label", "fold", 3)
    assert 0.5 < mean <= 1 and 0 <= deviation < 0.5


def test_forest_regression_beats_the_mean(frame):
    model = trees.fit_forest_regression(frame, FEATURES, "y", numTrees=10, maxDepth=6)
    assert metrics.regression_metrics(model.transform(frame), "y").first()["r2"] > 0.5


def test_regression_metrics_definitions(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mape"] == pytest.approx(np.mean(np.abs((y - p) / y)) * 100)
    assert row["mae_original"] == pytest.approx(np.abs(np.expm1(y) - np.expm1(p)).mean())


def test_systems_are_solved_in_the_plan(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for i in range(20):
        a = rng.normal(size=(5, 5))
        a, b = a @ a.T + np.eye(5), rng.normal(size=5)
        rows.append((i, np.column_stack([a, b]).tolist()))
        want.append(np.linalg.solve(a, b))
    rows.append((20, [[0.0] * 6] * 5))
    df = spark.createDataFrame(rows, "k int, m array<array<double>>").select("k", solved(F.col("m"), 5).alias("x"))
    got = {r["k"]: r["x"] for r in df.collect()}
    np.testing.assert_allclose([got[i] for i in range(20)], want, rtol=1e-8)
    assert got[20] == [None] * 5


def test_ridge_in_the_plan_equals_the_driver_form(frame):
    folded = splits.contiguous_folds(frame, ["e", "t"], 5)
    model = linear.ridge_cv(folded, FEATURES, "y", "fold")
    coefficients, scores = linear.ridge_path(folded, FEATURES, "y", "fold")
    found = {r["alpha"]: r["mean_r2"] for r in scores.collect()}
    assert found == {a: pytest.approx(s, abs=1e-10) for a, s in model.cv}
    best = {r["feature"]: r for r in linear.best_ridge(coefficients, scores).collect()}
    for f, standardised, raw in zip(FEATURES, model.standardised, model.raw, strict=True):
        assert best[f]["coef_standardised"] == pytest.approx(standardised, rel=1e-9)
        assert best[f]["coef"] == pytest.approx(raw, rel=1e-9) and best[f]["alpha"] == model.alpha
        assert best[f]["intercept"] == pytest.approx(model.intercept, rel=1e-9)
    assert coefficients.count() == len(FEATURES) * len(V.RIDGE_ALPHAS)


def test_reweighted_least_squares_equals_the_estimator(classes):
    """Within 1e-6 of the ML estimator on standardised, class-weighted rows, whatever the partitions."""
    weighted = splits.balanced_weights(classes, "label")
    scaled = linear.standardise(weighted, ["x", "z"], suffix="_z")
    names = ["x_z", "z_z"]
    own = logistic.fit_logistic(scaled, names, "label", "weight")
    model = trees.classifier("Logistic Regression", names, "label", "weight", scaled.count(), tol=1e-12).fit(scaled).stages[-1]
    np.testing.assert_allclose(own.coefficients, model.coefficients.toArray(), atol=1e-6)
    assert own.intercept == pytest.approx(model.intercept, abs=1e-6) and 2 < own.rounds < 15
    again = logistic.fit_logistic(scaled.repartition(11), names, "label", "weight")
    np.testing.assert_allclose(own.coefficients, again.coefficients, rtol=1e-12)
    scored = own.score(scaled, "label")
    assert scored.where((F.col("score") > 0.5) != (F.col("prediction") == 1)).count() == 0


def test_logistic_without_two_classes(classes):
    one = classes.where("label = 1")
    assert logistic.fit_logistic(one, ["x"], "label").intercept == float("inf")
    assert logistic.fit_logistic(one.where("k < 0"), ["x"], "label").coefficients == [0.0]


def test_portable_hash(spark):
    import hashlib

    got = spark.createDataFrame([(5,), (None,)], "k long").select(splits.portable_hash(F.col("k"), 42).alias("h")).collect()
    assert [r["h"] for r in got] == [int(hashlib.md5(b"42:5").hexdigest()[:15], 16), None]
