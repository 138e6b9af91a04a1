import numpy as np
from pyspark.sql import functions as F

from tidemark.config import ModelConfig
from tidemark.operators import metrics, models


def test_three_classes_get_probabilities_and_an_auc(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 2))
    label = np.where(x[:, 0] > 0.5, 1.0, np.where(x[:, 0] < -0.5, -1.0, 0.0))
    roles = ["train"] * 600 + ["validation"] * 150 + ["test"] * 150
    data = [(float(a), float(b), float(c), r) for (a, b), c, r in zip(x, label, roles)]
    rows = spark.createDataFrame(data, "a double, b double, label double, role string")
    model = models.boosted_trees(rows, ["a", "b"], "multiclass", ModelConfig(trees=10, depth=3))
    assert sorted(models.class_columns(model)) == [-1.0, 0.0, 1.0]
    out = models.predict(model, rows.filter("role = 'test'"), ["a", "b"]).cache()
    got = out.toPandas()
    p = np.vstack(got.probabilities)
    np.testing.assert_allclose(p.sum(1), 1)
    assert (got.prediction == np.array([-1.0, 0.0, 1.0])[p.argmax(1)]).all() and (got.prediction == got.label).mean() > 0.9
    assert not [c for c in out.columns if c.startswith(("class_", "_raw", "_is"))]
    assert metrics.one_vs_rest_auc(out, 3, classes=[-1.0, 0.0, 1.0]).first()[0] > 0.95
    assert {r.feature for r in models.importance(model, ["a", "b"]).collect()} == {"a", "b"}
    assert models.predict(model, rows.filter(F.lit(False)), ["a", "b"]).count() == 0
