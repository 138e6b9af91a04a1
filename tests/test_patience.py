import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidemark.config import ModelConfig
from tidemark.operators import explain, models

SMALL = ModelConfig(trees=8, depth=3, learning_rate=0.3, patience=3)


def rows_of(spark, kind, seed=1, validation=150):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(500, 2))
    label = x[:, 0] + x[:, 1] if kind == "regression" else (x[:, 0] * x[:, 1] > rng.normal(size=500) * 0.3).astype(float)
    roles = ["train"] * (500 - validation) + ["validation"] * validation
    return spark.createDataFrame([(float(a), float(b), float(c), r) for (a, b), c, r in zip(x, label, roles)], "a double, b double, label double, role string")


def test_a_rise_within_the_patience_does_not_end_boosting():
    errors = [1.0, 1.1, 0.9, 1.0, 1.0, 0.5]
    assert models.best_count(errors, ModelConfig(patience=2)) == (3, True)
    assert models.best_count(errors, ModelConfig(patience=3)) == (6, False)
    assert models.best_count([1.0, 1.0], ModelConfig(patience=1)) == (1, True)


@pytest.mark.parametrize("kind", ["binary", "regression"])
def test_rounds_give_the_trees_of_one_fit(spark, kind):
    rows = rows_of(spark, kind, validation=0)
    model = models.boosted_trees(rows, ["a", "b"], kind, SMALL)
    stage = model.stages[-1]
    assert stage.getNumTrees == SMALL.trees and list(stage.treeWeights) == [1.0] + [0.3] * 7
    assembled = models.dealt(model.stages[0].transform(models._fit_rows(models.weighted(rows, SMALL) if kind == "binary" else rows.withColumn("weight", F.lit(1.0)))))
    whole = (GBTClassifier if kind == "binary" else GBTRegressor)(**models._settings(SMALL)).fit(assembled)
    assert [t.numNodes for t in whole.trees] == [t.numNodes for t in stage.trees]
    for a, b in zip(whole.trees, stage.trees):
        a_out, b_out = ([r[-1] for r in t.transform(assembled).collect()] for t in (a, b))
        np.testing.assert_allclose(a_out, b_out, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kind", ["binary", "regression"])
def test_the_stop_is_the_one_of_all_errors(spark, tmp_path, kind):
    rows = rows_of(spark, kind)
    config = ModelConfig(trees=14, depth=5, learning_rate=0.5, patience=3)
    model = models.boosted_trees(rows, ["a", "b"], kind, config)
    every = models.boosted_trees(rows, ["a", "b"], kind, ModelConfig(trees=14, depth=5, learning_rate=0.5, patience=14)).stages[-1]
    check = models.weighted(rows, config) if kind == "binary" else rows.withColumn("weight", F.lit(1.0))
    check = model.stages[0].transform(check.filter("role = 'validation'"))
    # a model cut at its lowest error ends there
    whole = (GBTClassifier if kind == "binary" else GBTRegressor)(**models._settings(config)).fit(models.dealt(model.stages[0].transform(models._fit_rows(models.weighted(rows, config) if kind == "binary" else rows.withColumn("weight", F.lit(1.0))))).filter("not is_validation"))
    errors = list(whole.evaluateEachIteration(check) if kind == "binary" else whole.evaluateEachIteration(check, "squared"))
    assert model.stages[-1].getNumTrees == models.best_count(errors, config)[0]
    assert every.getNumTrees == int(np.argmin(errors)) + 1
    shown = models.predict(model, rows, ["a", "b"]).toPandas()
    model.write().save(str(tmp_path / "model"))
    again = models.predict(type(model).load(str(tmp_path / "model")), rows, ["a", "b"]).toPandas()
    np.testing.assert_allclose(shown.prediction, again.prediction)
    assert len(models.importance(model, ["a", "b", "never_asked"]).collect()) == 3
    assert {leaf["value"] for leaf in explain.leaf_table(model.stages[-1], spark)}
