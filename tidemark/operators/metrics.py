"""Classification and regression metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators.frame import prefix
from tidemark.session import cut


def confusion(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def classification(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 of ``label`` and ``prediction``.

    Two true classes: scores of class 1. Otherwise the plain mean over all classes seen. A
    zero divisor counts as 0. Works on the confusion counts, so only classes are joined.
    """
    ks = list(keys)
    counts = confusion(df, keys)
    sides = counts.select(
        *ks, F.col("count"), F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
            )
        ).alias("s"), (F.col("label") == F.col("prediction")).alias("_hit"),
    )
    n = F.col("count")
    per = sides.groupBy(*ks, F.col("s.class").alias("class")).agg(
        F.sum(n * F.col("s.t")).alias("true"),
        F.sum(n * F.col("s.p")).alias("predicted"),
        F.sum(F.when(F.col("_hit") & (F.col("s.t") == 1), n).otherwise(0)).alias("hits"),
    )

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    per = per.withColumns(
        {
            "precision": safe(F.col("hits"), F.col("predicted")),
            "recall": safe(F.col("hits"), F.col("true")),
            "f1": safe(2 * F.col("hits"), F.col("true") + F.col("predicted")),
        }
    )
    binary = F.sum((F.col("true") > 0).cast("int")) == 2

    def pick(c: str) -> Column:
        one = F.coalesce(F.max(F.when(F.col("class") == 1, F.col(c))), F.lit(0.0))
        return F.when(binary, one).otherwise(F.avg(c)).alias(c)

    return per.groupBy(*ks).agg(
        F.sum("true").alias("rows"),
        safe(F.sum("hits"), F.sum("true")).alias("accuracy"),
        pick("precision"), pick("recall"), pick("f1"),
    )


def ranking(df: DataFrame, keys: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """ROC-AUC (ties averaged) and average precision of a 0/1 ``label`` and a ``score``.

    Rows are first reduced to distinct scores. These are range-partitioned and every range
    block is chained with :func:`prefix`, so no single task orders all scores.
    """
    ks = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    per = base.groupBy(*ks, "score").agg(
        F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg")
    )
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(per.repartitionByRange(n, "score").withColumn("_blk", F.spark_partition_id()))
    totals = blocks.groupBy(*ks, "_blk").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    carried = prefix(totals, ks, "_blk", {"_pos": "sum", "_neg": "sum"}, grand=True)
    below = Window.partitionBy(*ks, "_blk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumns(
        {
            "_lp": F.coalesce(F.sum("pos").over(below), F.lit(0.0)),
            "_ln": F.coalesce(F.sum("neg").over(below), F.lit(0.0)),
        }
    ).join(carried, [*ks, "_blk"])
    pos_below, neg_below = F.col("_pos") + F.col("_lp"), F.col("_neg") + F.col("_ln")
    pos_here = F.col("_pos_all") - pos_below
    all_here = pos_here + F.col("_neg_all") - neg_below
    out = rows.groupBy(*ks).agg(
        ratio(
            F.sum(F.col("pos") * (neg_below + F.col("neg") / 2)), F.max("_pos_all") * F.max("_neg_all")
        ).alias("auc_roc"),
        ratio(F.sum(F.col("pos") * ratio(pos_here, all_here)), F.max("_pos_all")).alias("avg_precision"),
    )
    return out if keys else out.drop("_all")


def one_vs_rest_auc(df: DataFrame, n_classes: int, keys: tuple[str, ...] = (), classes: list[float] | None = None) -> DataFrame:
    """Mean over classes of each class's AUC; ``probabilities`` is an array per row, one place per class (labels 0, 1, ... unless named)."""
    per_class = df.select(*keys, "label", F.posexplode("probabilities").alias("class", "score")).filter(
        F.col("class") < n_classes
    )
    label = F.get(F.array(*[F.lit(float(c)) for c in classes]), F.col("class")) if classes else F.col("class")
    each = ranking(per_class.withColumn("label", (F.col("label") == label).cast("int")), (*keys, "class"))
    return each.groupBy(*keys).agg(F.avg("auc_roc").alias("auc_roc"))


def regression(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return df.groupBy(*keys).agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - ratio(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("directional_accuracy"),
    )


def focal_loss(df: DataFrame, alpha: float = 0.25, gamma: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean focal loss of 0/1 ``label`` and raw ``margin``, stable for large margins."""
    x, y = F.col("margin"), F.col("label")
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    loss = alpha * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce
    return df.groupBy(*keys).agg(F.avg(loss).alias("focal_loss"))


def tall(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(metric, value) rows of a one-row metrics table."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.inline(pairs))
