import pytest
from pyspark.sql import functions as F

from checks import model_queries
from tidemark.operators import folds

NAMES = ["a", "b", "c"]


def rows_of(spark):
    days = spark.range(2400).withColumn("ts", F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(int(id))"))
    return days.select(
        F.lit("X").alias("symbol"), "ts", *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(NAMES)],
        (F.col("id") % 2).cast("double").alias("label"), F.lit("train").alias("role"),
    )


def test_each_fold_has_the_rows_of_the_copies(spark):
    rows = rows_of(spark).drop("role").cache()
    seen = []

    def train(a, b):
        seen.append([a.count(), b.count()])

    def predict(_, part):
        seen[-1].append(part.count())
        return part

    folds.cross_validate(rows, train, predict, lambda part: part.agg(F.count("*").alias("value")).withColumn("metric", F.lit("rows")), at_once=1)
    want = {(r.fold, r.role): r.rows for r in folds.fold_summary(folds.fold_rows(rows)).collect()}
    assert len(seen) == 3 == len(want) / 3
    for fold, (train_rows, val_rows, *scored) in enumerate(seen):
        parts = [want[fold, role] for role in folds.ROLES]
        assert [train_rows, val_rows] == parts[:2] and scored == parts


def test_the_query_uses_all_features_and_the_default_model(spark, monkeypatch):
    rows, asked = rows_of(spark).cache(), []
    monkeypatch.setattr(model_queries, "training", lambda s, d: {"rows": rows, "names": NAMES})
    monkeypatch.setattr(model_queries.M, "boosted_trees", lambda part, names, kind, config: asked.append((part.columns, names, kind, config)))
    monkeypatch.setattr(model_queries.M, "predict", lambda model, part, names: part.withColumn("prediction", F.col("label")))
    out = {(r.role, r.metric): r["mean"] for r in model_queries.QUERIES["cross_validation"](spark, "x").collect()}
    assert len(out) == 12 and set(out.values()) == {1.0}
    assert len(asked) == 3 and all(names == NAMES and kind == "binary" and config == model_queries.QUERY.models for _, names, kind, config in asked)
    assert all({*NAMES, "label", "role"} <= set(columns) for columns, *_ in asked)


def test_a_failing_fold_is_named(spark):
    rows = rows_of(spark).drop("role").cache()

    def train(a, b):
        if a.agg(F.min("ts")).first()[0].year == 1995 and a.agg(F.min("ts")).first()[0].month > 1:
            raise ArithmeticError("no")

    with pytest.raises(ArithmeticError) as found:
        folds.cross_validate(rows, train, lambda _, part: part, lambda part: part.agg(F.count("*").alias("value")).withColumn("metric", F.lit("rows")))
    assert any("item 1" in note for note in found.value.__notes__)
