"""Training sets, boosted trees, predictions and sequence windows on MLlib."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from tidemark.config import ModelConfig
from tidemark.functions.exprs import back
from tidemark.operators.frame import SIZE, core_rows, grouped_quantile, with_halo
from tidemark.session import cut, side_by_side

CLASS = "class_"  # how the probability columns of one class against the rest begin
PART_ROWS = 1024
CUT = 10  # rounds of boosting between two writes of the margins


def cut_date(df: DataFrame, share: float):
    """The time before which the first ``share`` of all rows lies.

    With one row per time this is the row at position floor(rows * share). The cut is by
    date, so all symbols are split at the same moment.
    """
    rows = df.withColumn("_all", F.lit(0)).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    found = grouped_quantile(rows, ["_all"], "_t", share, "_cut", by_count=True).first()
    return None if found is None else found["_cut"]


def training_set(
    features: DataFrame, labels: DataFrame, target: str, names: list[str], config: ModelConfig = ModelConfig()
) -> DataFrame:
    """Feature columns, ``label``, ``role`` (train, validation, test), in order of time.

    Rows without a label are dropped and missing features become 0. Training stops early on
    the last part of the training time, never on the test rows.
    """
    joined = features.join(labels.select("symbol", "ts", F.col(target).cast("double").alias("label")), ["symbol", "ts"])
    rows = cut(joined.filter("label IS NOT NULL"))  # read three times below
    return split(rows.select("symbol", "ts", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], "label"), config)


def split(rows: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    test = cut_date(rows, config.train_share)
    check = cut_date(rows, config.train_share * (1 - config.validation_share))
    return rows.withColumn("role", F.when(t >= test, "test").when(t >= check, "validation").otherwise("train"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.collect_list(F.struct("label", "n")).alias("c"), F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    return every.select("_total", "_classes", F.inline("c")).select(
        "label", (F.col("_total") / (F.col("_classes") * F.col("n"))).alias("weight")
    )


def weighted(rows: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    if not config.class_weights:
        return rows.withColumn("weight", F.lit(1.0))
    weights = class_weights(rows.filter("role = 'train'"))
    return rows.join(weights, "label", "left").fillna(1.0, ["weight"])


def _assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")


def _fit_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("role <> 'test'").withColumn("is_validation", F.col("role") == "validation")


def boosted_trees(rows: DataFrame, names: list[str], kind: str = "binary", config: ModelConfig = ModelConfig()) -> PipelineModel:
    """Gradient-boosted trees for ``binary``, ``regression`` or ``multiclass`` labels.

    The trees are fitted on the training rows and kept up to the smallest validation error (:func:`boost`).
    """
    if kind == "regression":
        stage, fit_rows = GBTRegressor(**_settings(config)), _fit_rows(rows).withColumn("weight", F.lit(1.0))
    elif kind == "binary":
        stage, fit_rows = GBTClassifier(**_settings(config)), _fit_rows(weighted(rows, config))
    elif kind == "multiclass":
        return _one_vs_rest(rows, names, config)
    else:
        raise ValueError(f"unknown kind {kind}")
    assembler = _assembler(names)
    return PipelineModel([assembler, boost(stage, dealt(assembler.transform(fit_rows)), config)])


def _settings(config: ModelConfig) -> dict[str, object]:
    return {
        "featuresCol": "features", "labelCol": "label", "maxDepth": config.depth, "stepSize": config.learning_rate, "seed": config.seed,
        "maxIter": config.trees, "weightCol": "weight",
    }


def best_count(errors: list[float], config: ModelConfig = ModelConfig()) -> tuple[int, bool]:
    """The number of trees with the smallest error before ``patience`` trees in a row do not lower it by the
    tolerance's share, and whether the patience has run out."""
    best = 0
    for i, error in enumerate(errors):
        if errors[best] - error > config.validation_tolerance * max(error, 0.01):
            best = i
        elif i - best >= config.patience:
            return best + 1, True
    return best + 1, False


def dealt(rows: DataFrame) -> DataFrame:
    """Rows to fit on, stored: dealt and sorted by their content, so that reruns agree, in parts of about ``PART_ROWS`` rows, at most as many as shuffles have.

    A round of boosting is some twenty short stages, so on a small table the tasks themselves are the cost.
    """
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS))
    narrow = rows.select("features", "label", "weight", "is_validation").withColumn("_h", F.xxhash64(vector_to_array("features"), "label"))
    return cut(narrow.repartition(parts, "_h").sortWithinPartitions("_h").drop("_h"))


def boost(stage, rows: DataFrame, config: ModelConfig = ModelConfig()):
    """The boosted model ``stage`` asks for, grown one tree a round on stored margins, with the stop inside the loop.

    Each round fits a regression tree to the loss's steepest descent at the margins so far, adds it to the margins and
    keeps the validation loss, all in one pass over the rows. It ends when ``patience`` rounds in a row have not lowered that loss,
    and keeps the trees up to the lowest; without validation rows all trees are grown. These are the trees of one MLlib fit of
    that length (its first tree counts whole, later ones by the learning rate). Margins are written out every ``CUT`` rounds.
    """
    binary = isinstance(stage, GBTClassifier)
    label = F.col("label") * 2 - 1 if binary else F.col("label")
    state = rows.select("features", "weight", "is_validation", label.alias("y"), F.lit(0.0).alias("margin")).persist()
    y, margin = F.col("y"), F.col("margin")
    slope = y * 4 / (F.exp(y * margin * 2) + 1) if binary else (y - margin) * 2
    # log(1 + exp(z)) without overflow
    z = y * margin * -2
    loss = (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) * 2 if binary else (y - margin) * (y - margin)
    tree_fit = DecisionTreeRegressor(featuresCol="features", labelCol="goal", weightCol="weight", predictionCol="step", maxDepth=config.depth)
    checked = not rows.filter("is_validation").isEmpty()
    trees, errors = [], []
    while len(trees) < config.trees:
        train = state.filter("not is_validation").withColumn("goal", slope if trees else y)
        tree = tree_fit.copy({tree_fit.seed: config.seed + len(trees)}).fit(train)
        share = config.learning_rate if trees else 1.0
        trees.append(tree)
        moved = tree.transform(state).withColumn("margin", margin + F.col("step") * share).drop("step")
        after = (cut(moved) if len(trees) % CUT == 0 else moved).persist()
        held = F.when(F.col("is_validation"), F.col("weight"))
        error = after.agg(F.sum(held * loss) / F.sum(held)).first()[0]
        state.unpersist()
        state = after
        if checked:
            errors.append(error)
            if best_count(errors, config)[1]:
                break
    state.unpersist()
    return _ensemble(stage, trees[:best_count(errors, config)[0]] if checked else trees, config)


def _ensemble(stage, trees: list, config: ModelConfig):
    """A model of MLlib's own kind from fitted trees, by its public constructor."""
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    members = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], shares[i] = tree._java_obj, config.learning_rate if i else 1.0
    if isinstance(stage, GBTClassifier):
        model = GBTClassificationModel(ml.classification.GBTClassificationModel(stage.uid, members, shares))
        model.setRawPredictionCol(stage.getRawPredictionCol()).setProbabilityCol(stage.getProbabilityCol())
    else:
        model = GBTRegressionModel(ml.regression.GBTRegressionModel(stage.uid, members, shares))
    return model.setFeaturesCol(stage.getFeaturesCol()).setPredictionCol(stage.getPredictionCol())


def _one_vs_rest(rows: DataFrame, names: list[str], config: ModelConfig) -> PipelineModel:
    """One boosted model per class, each with its own early stop, grown side by side; a list of class labels is all the driver sees."""
    assembler = _assembler(names)
    fit_rows = dealt(assembler.transform(_fit_rows(weighted(rows, config))))
    classes = sorted(r[0] for r in fit_rows.filter("not is_validation").select("label").distinct().collect())

    def grown(c: float):
        tag = repr(float(c)).replace(".", "p")
        stage = GBTClassifier(**_settings(config), predictionCol=f"_is_{tag}").setProbabilityCol(f"{CLASS}{tag}").setRawPredictionCol(f"_raw_{tag}")
        return boost(stage, fit_rows.withColumn("label", (F.col("label") == c).cast("double")), config)

    return PipelineModel([assembler, *side_by_side(rows.sparkSession, grown, classes)])


def class_columns(model: PipelineModel) -> dict[float, str]:
    """Columns of a one-versus-rest model's probabilities by class label; empty for other models."""
    names = [m.getProbabilityCol() for m in model.stages if m.hasParam("probabilityCol")]
    return {float(c.removeprefix(CLASS).replace("p", ".")): c for c in names if c.startswith(CLASS)}


def predict(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``prediction`` and, for two classes, ``score`` (probability of class 1).

    More classes: ``probabilities``, one per class in order of the labels, adding up to 1; the smaller label wins ties.
    """
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    out = model.transform(filled)
    classes = class_columns(model)
    if classes:
        order = sorted(classes)
        each = F.array(*[F.get(vector_to_array(classes[c]), F.lit(1)) for c in order])
        total = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x)
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        out = out.withColumn("_each", each).withColumn("probabilities", F.transform("_each", lambda x: x / total))
        out = out.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in order]), best.cast("int")))
        parts = [c.removeprefix(CLASS) for c in classes.values()]
        return out.drop("_each", *[f"{start}{tag}" for tag in parts for start in (CLASS, "_raw_", "_is_")])
    if "probability" in out.columns:
        out = out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("rawPrediction", "probability")


def importance(model: PipelineModel, names: list[str]) -> DataFrame:
    """Gain importance per feature, largest first; the mean over the classes where each has its own trees."""
    from pyspark.sql import SparkSession

    values = [0.0] * len(names)
    for m in model.stages[1:]:
        for i, v in enumerate(m.featureImportances.toArray()):  # ends at the last feature that a tree asks
            values[i] += float(v) / len(model.stages[1:])
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def sequences(framed_source: DataFrame, names: list[str], length: int = 20, size: int = SIZE) -> DataFrame:
    """Windows of ``length`` feature rows ending at each row, as an array of arrays."""
    framed = with_halo(framed_source, before=length - 1, size=size)
    step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    out = core_rows(framed.withColumn("_step", step).withColumn("sequence", F.collect_list("_step").over(back(length))))
    return out.filter(F.size("sequence") == length).drop("_step")


def sequence_network(windows: DataFrame, length: int, width: int, classes: int = 2, hidden: int = 16, seed: int = 42, rounds: int = 50):
    """Perceptron on flattened windows; ``windows`` has ``sequence`` and ``label``."""
    flat = windows.withColumn("features", array_to_vector(F.flatten("sequence")))
    net = MultilayerPerceptronClassifier(layers=[length * width, hidden, classes], seed=seed, maxIter=rounds, featuresCol="features", labelCol="label")
    return net.fit(flat), flat
