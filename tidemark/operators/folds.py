"""Walk-forward folds and cross-validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark.config import EvaluationConfig
from tidemark.session import side_by_side

ROLES = ("train", "val", "test")


def fold_rows(df: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Each row once per (fold, role) it belongs to, with the part's half-open bounds.

    Fold f starts f steps after the first day, so membership is arithmetic on the row's age:
    no join of rows with folds is needed. Folds with an empty part are left out.
    """
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        raise ValueError("no rows to split")
    day = 86400
    train = config.train_years * 365 * day
    val, test = config.validation_months * 30 * day, config.test_months * 30 * day
    step = config.step_months * 30 * day
    spare = int((last - first).total_seconds()) - train - val - test
    folds = max(0, spare // step + 1) if spare >= 0 else 0
    start = F.lit(first).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", start, F.col("ts"))
    offsets = {"train": (0, train), "val": (train, train + val), "test": (train + val, train + val + test)}

    def members(a: int, b: int):
        low = F.greatest(F.lit(0), F.floor((age - b) / step) + 1)
        high = F.least(F.lit(folds - 1), F.floor((age - a) / step))
        return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))

    def at(seconds):
        return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    def part(role: str):
        a, b = offsets[role]
        return F.transform(
            members(a, b),
            lambda f: F.struct(
                f.alias("fold"), F.lit(role).alias("role"),
                at(f * step + a).alias("part_start"), at(f * step + b).alias("part_end"),
            ),
        )

    parts = F.flatten(F.array(*[part(role) for role in ROLES]))
    rows = df.withColumn("_part", F.explode(parts)).select("*", "_part.*").drop("_part")
    full = rows.groupBy("fold").agg(F.count_distinct("role").alias("_roles")).filter("_roles = 3").select("fold")
    return rows.join(full, "fold", "left_semi")


def fold_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.first("part_start").alias("part_start"), F.first("part_end").alias("part_end")
    )


def aggregate_metrics(fold_metrics: DataFrame, by: tuple[str, ...] = ("role", "metric")) -> DataFrame:
    """Mean and population deviation over folds of a tall (fold, role, metric, value) table."""
    return fold_metrics.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fold_parts(df: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> list[tuple[int, str, str, str]]:
    """(fold, role, start, end) of :func:`fold_rows`, with half-open bounds as text, in order of the folds."""
    bounds = fold_rows(df.select("ts"), config).select(
        "fold", "role", F.col("part_start").cast("string").alias("a"), F.col("part_end").cast("string").alias("b")
    )
    return sorted((r["fold"], r["role"], r["a"], r["b"]) for r in bounds.distinct().collect())


def cross_validate(
    rows: DataFrame,
    train: Callable[[DataFrame, DataFrame], object],
    predict: Callable[[object, DataFrame], DataFrame],
    metrics: Callable[[DataFrame], DataFrame],
    config: EvaluationConfig = EvaluationConfig(),
    at_once: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Train per fold and score its three parts, each a range of dates of ``rows``.

    ``train`` gets the training and validation rows, ``predict`` a model and rows, ``metrics``
    scored rows and returns (metric, value). The handful of folds are concurrent jobs (a scheduler pool each), ``at_once`` of them,
    and no row is copied; the error of a failing fold names it. Returns the tall fold metrics and their aggregate.
    """
    found: dict[int, dict[str, DataFrame]] = {}
    for fold, role, a, b in fold_parts(rows, config):
        low, high = (F.lit(x).cast("timestamp_ntz") for x in (a, b))
        found.setdefault(fold, {})[role] = rows.filter((F.col("ts") >= low) & (F.col("ts") < high))

    def scored(fold: int) -> list[DataFrame]:
        of = found[fold]
        model = train(of["train"], of["val"])
        return [metrics(predict(model, of[role])).select(F.lit(fold).alias("fold"), F.lit(role).alias("role"), "metric", "value") for role in ROLES]

    parts = [part for fold in side_by_side(rows.sparkSession, scored, list(found), at_once) for part in fold]
    if not parts:
        raise ValueError("the date range is too short for one fold")
    tall = parts[0]
    for part in parts[1:]:
        tall = tall.unionByName(part)
    return tall, aggregate_metrics(tall)
