"""Trained pipelines and result tables kept by name in a shared folder."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_artifacts(folder: str, artifacts: dict) -> dict[str, str]:
    """Write each table as Parquet and each fitted model in Spark's model format."""
    paths = {}
    for name, value in artifacts.items():
        path = f"{folder.rstrip('/')}/{name}"
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(path)
        elif hasattr(value, "write"):
            value.write().overwrite().save(path)
        else:
            raise TypeError(f"artifact {name!r} is neither a table nor a fitted Spark model")
        paths[name] = path
    return paths


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def load_model(folder: str, name: str, cls=PipelineModel):
    return cls.load(f"{folder.rstrip('/')}/{name}")
