"""Selection by counting, appends that are repeated, and flags that late epochs correct."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import streaming
from corpusloom.operators import run_metrics
from corpusloom.session import exists
from corpusloom.sources import documents
from corpusloom.sources.metrics import append_metric_stream, append_metrics, read_metrics, stream_metrics

STEPS = "run string, event string, epoch int, step bigint, batch_loss double, _ts string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize("n", [1, 5, 6, 7, 49, 299, 300, 301, 1000])
def test_first_documents_by_counting(spark, monkeypatch, n):
    monkeypatch.setattr(documents, "SMALL", 0)
    monkeypatch.setattr(documents, "BUCKETS", 7)
    draw = random.Random(2)
    ids = [None] * 5 + [draw.choice([-(2**63), 2**63 - 1, draw.randrange(-(10**15), 10**15), draw.randrange(40)]) for _ in range(295)]
    draw.shuffle(ids)
    docs = spark.createDataFrame([("s", i, f"t{k}") for k, i in enumerate(ids)], "source string, doc_id bigint, text string").repartition(4)
    got = [r["doc_id"] for r in documents.take_documents(docs, n).collect()]
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(got, key=lambda i: (i is not None, i or 0)) == order[:n]


def test_no_text_is_moved(spark):
    docs = spark.range(5000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    made = documents.take_documents(docs, 3000)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 3000


def test_a_batch_that_is_appended_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda k: spark.createDataFrame([("r", "step", 0, k, 1.0, "2024-01-01T00:00:00")] * 2, STEPS)
    assert append_metrics(rows(1), path, "a") and not append_metrics(rows(1), path, "a") and append_metrics(rows(2), path, "b")
    assert append_metrics(rows(3), path) and append_metrics(rows(3), path)  # without a name every call counts
    assert sorted(r["step"] for r in read_metrics(spark, path).collect()) == [1, 1, 2, 2, 3, 3, 3, 3]
    (tmp_path / "log" / "batch=a" / "_SUCCESS").unlink()  # as if the first one had broken off
    assert append_metrics(rows(1), path, "a") and exists(spark, f"{path}/batch=a/_SUCCESS")
    assert read_metrics(spark, path).count() == 8


def test_a_stream_is_appended_once_and_read_without_repeats(spark, tmp_path):
    log, copy = str(tmp_path / "log"), str(tmp_path / "copy")
    for k in range(3):
        append_metrics(spark.createDataFrame([("r", "step", 0, 10 * k + i, 1.0, "2024-01-01T00:00:00") for i in range(5)], STEPS), log, str(k))
    append_metric_stream(stream_metrics(spark, log), copy, str(tmp_path / "c1"), "s").awaitTermination()
    append_metric_stream(stream_metrics(spark, log), copy, str(tmp_path / "c2"), "s").awaitTermination()  # all of it again
    assert read_metrics(spark, copy).count() == 15
    # A reader that sees a batch before and after it was written anew.
    seen = stream_metrics(spark, log, again_within="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "seen"))
    seen.option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    (tmp_path / "log" / "batch=1" / "_SUCCESS").unlink()
    append_metrics(read_metrics(spark, log).where("step between 10 and 14"), str(tmp_path / "again"), "1")
    append_metrics(spark.read.json(str(tmp_path / "again" / "batch=1")), log, "1")
    seen = stream_metrics(spark, log, again_within="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "seen"))
    seen.option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 15


def test_late_epochs_correct_flags(spark, tmp_path):
    draw = random.Random(4)
    rows = [(run, epoch, draw.randrange(20) / 4) for run in "ab" for epoch in range(12)]
    shuffled = draw.sample(rows, len(rows))
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run string, epoch int, loss double"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        for k in range(3):
            part = shuffled[8 * k : 8 * k + 8] + ([(None, 1, 1.0), ("a", None, 1.0), ("a", 1, None)] if k == 1 else [])
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(arriving)
            stream = spark.readStream.schema(schema).json(arriving)
            streaming.append_flags(streaming.streamed_improvements(stream, "loss"), out, state).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    flags = spark.read.schema(streaming.FLAGS).parquet(out)
    got = {(r["run"], r["epoch"]): r["is_best"] for r in streaming.latest_flags(flags).collect()}
    batch = run_metrics.improvements(spark.createDataFrame(rows, schema), "loss").collect()
    assert got == {(r["run"], r["epoch"]): r["is_best"] for r in batch}
    assert flags.count() > len(rows)  # some were given again
