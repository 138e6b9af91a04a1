"""Tables out. All writers are Spark writers; nothing passes through the driver."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_importance_csv(importance: DataFrame, path: str) -> None:
    importance.write.mode("overwrite").option("header", True).csv(path)


def write_json(table: DataFrame, path: str) -> None:
    """Pattern library or cycle tables; arrays stay arrays."""
    table.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
