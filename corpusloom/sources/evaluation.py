"""Evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_METRICS = "exact_match double, f1 double, count bigint"
_PREDICTIONS = "qid string, text string"


def write_predictions(predictions: DataFrame, path: str) -> DataFrame:
    """Replace the ``predictions`` table below ``path``; returns it, so that scoring does not decode again."""
    predictions.select("qid", "text").write.mode("overwrite").parquet(f"{path}/predictions")
    return predictions.sparkSession.read.schema(_PREDICTIONS).parquet(f"{path}/predictions")


def write_metrics(metrics: DataFrame, path: str) -> DataFrame:
    """Replace the ``metrics`` table below ``path``; returns it."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    return metrics.sparkSession.read.schema(_METRICS).parquet(f"{path}/metrics")


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The ``metrics`` and ``predictions`` tables."""
    return (
        spark.read.schema(_METRICS).parquet(f"{path}/metrics"),
        spark.read.schema(_PREDICTIONS).parquet(f"{path}/predictions"),
    )


def evaluation_lines(metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    """The evaluation as JSON lines (``value``): one line ``{"metrics": ...}``, and one line per prediction. No row is moved."""
    scores = metrics.select(F.to_json(F.struct(F.struct("exact_match", "f1", "count").alias("metrics"))).alias("value"))
    return scores.unionByName(predictions.select(F.to_json(F.struct("qid", "text")).alias("value")))


def evaluation_event(metrics: DataFrame, run: str) -> DataFrame:
    """The log record of an evaluation outside training: epoch -1 of the split ``dev``."""
    return metrics.select(F.lit(run).alias("run"), F.lit("epoch").alias("event"), F.lit(-1).alias("epoch"), F.lit("dev").alias("split"), "exact_match", "f1", "count")
