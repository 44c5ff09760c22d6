"""Incremental forms of the corpus build and of the training dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import SEED, TEST_RATIO, adjacent_pairs, route_split
from ..session import is_folder
from .improvements import FLAGS, latest_flags, streamed_improvements

__all__ = [
    "FLAGS", "append_closed", "append_flags", "dashboard", "latest_flags", "publish", "step_rate", "stream_documents",
    "stream_pairs", "stream_table", "streamed_improvements",
]


def stream_documents(
    spark: SparkSession, directory: str, source: str, schema: T.StructType, id_column: str = "doc_id", glob: str = "*.parquet"
) -> DataFrame:
    """Documents of Parquet files as they arrive in a directory."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(directory)
    return files.select(
        F.lit(source).alias("source"),
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def stream_table(
    spark: SparkSession, directory: str, name: str, source: str, schema: T.StructType, id_column: str = "doc_id"
) -> DataFrame:
    """Documents of the table ``name`` in a directory: all files of a folder of that name, or the one file. A stream lists the
    files of one folder, so a table that is a folder is streamed from itself and a single file from the folder it lies in."""
    path = f"{directory}/{name}"
    if is_folder(spark, path):
        return stream_documents(spark, path, source, schema, id_column, "*")
    return stream_documents(spark, directory, source, schema, id_column, name)


def stream_pairs(
    docs: DataFrame, path: str, checkpoint: str, test_ratio: float = TEST_RATIO, seed: int = SEED
) -> StreamingQuery:
    """Append the pairs of new documents to the pair table, each exactly once.

    Pairs are built inside their document's row, so the stream keeps no state and runs the very plan of the batch build.
    """
    pairs = route_split(adjacent_pairs(docs), test_ratio, seed)
    writer = pairs.writeStream.format("parquet").outputMode("append").partitionBy("split")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dashboard(events: DataFrame) -> DataFrame:
    """Latest and best loss per run and split; state is one row per run and split."""
    chosen = events.filter(F.col("event") == "epoch")
    return chosen.groupBy("run", "split").agg(
        F.max("epoch").alias("last_epoch"),
        F.max_by("avg_loss", "epoch").alias("last_loss"),
        F.min("avg_loss").alias("best_loss"),
        F.count("*").alias("n_epochs"),
    )


def step_rate(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Logged steps and their mean loss per tumbling window; windows older than the watermark leave the state."""
    timed = events.filter(F.col("event") == "step").withColumn("ts", F.to_timestamp("_ts"))
    windows = timed.withWatermark("ts", lateness).groupBy(F.window("ts", width), "run")
    return windows.agg(F.count("*").alias("n_steps"), F.avg("batch_loss").alias("mean_loss")).select(
        "run", F.col("window.start").alias("window_start"), "n_steps", "mean_loss"
    )


def publish(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace a small table with the whole result at every trigger."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = table.writeStream.outputMode("complete").foreachBatch(replace)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_closed(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append windows once the watermark has passed them."""
    writer = table.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_flags(flags: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the flags of every trigger; a micro-batch that is run again repeats its rows, which count once."""

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    writer = flags.writeStream.outputMode("update").foreachBatch(append)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
