"""Trees grown over blocks against the ML estimator and themselves."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillpanel.models import grow, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 3)).astype(float)
    p = 1 / (1 + np.exp(-(x[:, 0] - 6 + 0.3 * x[:, 1] * (x[:, 2] > 5))))
    y = (rng.random(600) < p).astype(int)
    values = [(i, *map(float, v), int(c), i % 3) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(values, "k long, a double, b double, c double, label int, fold int")


def test_boosted_folds_equal_the_estimator(rows):
    """Fold models grown side by side are those the ML estimator fits to each fold's rows."""
    settings = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.1, "seed": 1}  # more than KEPT_ROUNDS
    models = trees.classifier("Gradient Boosting", ["a", "b", "c"], "label", "w", 600, **settings).fit_folds(rows, "fold", 3)
    for g in (0, 2):
        estimator = GBTClassifier(labelCol="label", **settings)
        want = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), estimator]).fit(rows.where(F.col("fold") != g))
        expected = {r.k: r.probability[1] for r in want.transform(rows).collect()}
        got = {r.k: r.probability[1] for r in models[g].transform(rows).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
        np.testing.assert_allclose(models[g].importances, want.stages[-1].featureImportances.toArray(), atol=1e-9)


def test_small_nodes_in_groups_grow_as_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1] + rng.normal(scale=0.1, size=3000)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").repartition(4)
    found = []
    for level_bytes, local in ((1 << 20, 0), (0, 700)):  # all by passes; groups below 700 rows
        monkeypatch.setattr(grow, "LEVEL_BYTES", level_bytes)
        monkeypatch.setattr(grow, "LOCAL_ROWS", local)
        model = trees.fit_forest_regression(df, ["a", "b"], "y", numTrees=5, maxDepth=7)
        found.append(model)
    assert (found[0].trees.feature == found[1].trees.feature).all() and (found[0].trees.cut == found[1].trees.cut).all()
    np.testing.assert_allclose(found[0].trees.value, found[1].trees.value, atol=1e-9)


def test_cuts_are_exact_quantiles(spark):
    x = np.random.default_rng(2).normal(size=5000).round(3) * 10
    df = spark.createDataFrame([(float(v), 0.0) for v in x], "x double, y double").repartition(3)
    [[got]] = grow.cuts(grow.packed(df, ["x"], "y", None, None), 1, 1)
    ordered, values = np.sort(x), np.unique(x)
    low = np.unique([ordered[-(-j * 5000 // 32) - 1] for j in range(1, 32)])
    np.testing.assert_allclose(got, [(v + values[np.searchsorted(values, v) + 1]) / 2 for v in low])


def test_shallow_trees_take_no_gather_per_level(monkeypatch):
    """Values by masks are those at the nodes that rows come to one by one, also below early leaves."""
    rng = np.random.default_rng(7)
    model, x = grow.Trees.empty(6, 4), rng.integers(0, 9, (3, 500)).astype(np.uint8)
    for t in range(6):
        model.value[t] = rng.normal(size=31)
        for node in range(15):  # a leaf's children stay leaves
            if (node == 0 and t) or (node and model.feature[t, (node - 1) // 2] >= 0 and rng.random() < 0.7):
                model.feature[t, node], model.cut[t, node] = rng.integers(0, 3), rng.integers(0, 8)
    by_node = [model.value[t][model.places(t, x, 5)] for t in range(6)]
    inner = [(model.feature[t][model.places(t, x, 3)] >= 0, model.places(t, x, 3) - 7) for t in range(6)]
    monkeypatch.setattr(grow.Trees, "places", None)
    for t in range(6):
        assert (model.values(t, x) == by_node[t]).all()
        assert (model.reached(t, x, 3)[inner[t][0]] == inner[t][1][inner[t][0]]).all()


def test_deep_trees_take_few_gathers(monkeypatch):
    """Masks and the gathers below them give the nodes that rows come to one by one; only levels below the masks gather."""
    rng = np.random.default_rng(8)
    model, x = grow.Trees.empty(8, 8), rng.integers(0, 9, (3, 700)).astype(np.uint8)
    for t in range(8):
        model.value[t] = rng.normal(size=511)
        for node in range(255):
            if (node == 0 and t) or (node and model.feature[t, (node - 1) // 2] >= 0 and rng.random() < 0.9):
                model.feature[t, node], model.cut[t, node] = rng.integers(0, 3), rng.integers(0, 8)

    def walked(t, row, levels):
        node = 0
        for _ in range(levels):
            if model.feature[t, node] >= 0:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
        return node

    gathers, where = [], np.where
    monkeypatch.setattr(np, "where", lambda *a: (gathers.append(1) if a[0].shape == (700,) else None, where(*a))[1])
    for t in range(8):
        for levels in (0, 1, 5, 6, 8, 9):
            gathers.clear()
            got = model.places(t, x, levels)
            assert len(gathers) <= max(0, levels - grow.MASK_DEPTH)
            assert got.tolist() == [walked(t, row, levels) for row in x.T]
        assert (model.values(t, x) == model.value[t][got]).all()


def test_draws_are_those_of_the_generator():
    """Rows outside the fold, as often as the tree's generator draws them."""
    rng = np.random.default_rng(9)
    n, fold = 4001, rng.integers(0, 3, 4001).astype(np.int32)
    row = {"block": 6, "n": n, "x": bytes(n), "y": bytes(8 * n), "w": bytes(8 * n), "fold": fold.tobytes(), "margin": b""}
    block = grow._Block(row, 1, 1)
    random = np.random.Generator(np.random.Philox(key=np.array([3 * 1_000_003 + 11, 6], np.uint64)))
    count = [int(grow.DRAWS[v]) if f != 1 else 0 for v, f in zip(random.integers(0, 1 << 16, n, np.uint16), fold, strict=True)]
    rows, often = block.drawn(3, 11, 1, True)
    assert rows.tolist() == [i for i, c in enumerate(count) if c] and often.tolist() == [c for c in count if c]
