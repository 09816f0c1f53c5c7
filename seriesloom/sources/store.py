"""Sinks: result tables, small artefacts and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    *,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a result table.

    With ``partition_by`` the rows of one folder are brought together so that
    few files are written; the rebalance hint lets Spark split a folder that
    holds a large share of the rows over several tasks.
    """
    writer_df = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    writer = writer_df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_model(model: Transformer, path: str, *, features: Sequence[str], params: dict, spark: SparkSession) -> None:
    """Persist a fitted model with its feature list and parameters beside it."""
    fitted = model if isinstance(model, PipelineModel) else PipelineModel([model])
    fitted.write().overwrite().save(f"{path}/model")
    rows = [("feature", str(i), f) for i, f in enumerate(features)]
    rows += [("param", str(k), str(v)) for k, v in params.items()]
    meta = spark.createDataFrame(rows, "kind string, name string, value string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")

