"""The training event log: one JSON record per line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import exists

# The fields of a record.
METRIC_SCHEMA = """
    run string, event string, epoch int, step bigint, split string, lr double,
    batch_loss double, batch_nsp_loss double, batch_mlm_loss double,
    running_loss double, running_mlm_acc double, running_nsp_acc double,
    avg_loss double, avg_mlm_loss double, avg_nsp_loss double, mlm_acc double, nsp_acc double,
    exact_match double, f1 double, count bigint, _ts string
"""


def append_metrics(events: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append records; a record without a time is stamped. Null fields are left out of the JSON.

    Every call writes a folder of its own. With a name for the ``batch`` a call that is repeated, by a caller that doesn't
    know whether it came through, writes nothing if the first one did, and starts anew if that one broke off. Returns
    whether records were written.
    """
    target = f"{path}/batch={batch if batch is not None else uuid.uuid4().hex}"
    if batch is not None and exists(events.sparkSession, f"{target}/_SUCCESS"):
        return False
    if "_ts" not in events.columns:
        events = events.withColumn("_ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    events.write.mode("overwrite").json(target)
    return True


def append_metric_stream(events: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Append a stream of records exactly once: a micro-batch that is run again after a failure has the name of the first run."""
    writer = events.writeStream.foreachBatch(lambda rows, number: append_metrics(rows, path, f"{name}-{number}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{METRIC_SCHEMA}, batch string").json(path).drop("batch")


def stream_metrics(spark: SparkSession, path: str, again_within: str | None = None) -> DataFrame:
    """Records as they arrive. A batch that broke off and was written anew can be seen twice by a reader that was too fast:
    ``again_within``, such as ``1 hour``, drops equal records of a batch that come so long after each other by their time."""
    rows = spark.readStream.schema(f"{METRIC_SCHEMA}, batch string").json(path)
    if again_within is None:
        return rows.drop("batch")
    timed = rows.withColumn("_at", F.to_timestamp("_ts")).withWatermark("_at", again_within)
    return timed.dropDuplicatesWithinWatermark(rows.columns).drop("batch", "_at")
