from pyspark.sql import functions as F

from corpusloom import streaming
from corpusloom.operators.corpus import adjacent_pairs, route_split
from corpusloom.sources.metrics import append_metrics, read_metrics, stream_metrics


def test_streamed_pairs_equal_the_batch_and_come_once(spark, tmp_path):
    sentences = " ".join(f"Sentence number {i} is long enough." for i in range(5))
    docs = spark.createDataFrame([(i, sentences) for i in range(20)], "doc_id bigint, text string")
    arriving = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in (docs.filter("doc_id < 8"), docs.filter("doc_id >= 8")):
        part.write.mode("append").parquet(arriving)
        stream = streaming.stream_documents(spark, arriving, "wiki", docs.schema)
        streaming.stream_pairs(stream, out, state, 0.4).awaitTermination()
    batch = route_split(adjacent_pairs(docs.withColumn("source", F.lit("wiki"))), 0.4)
    stored = spark.read.schema(batch.schema).parquet(out)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, batch.collect()))


def test_dashboard_and_step_rate(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "run string, event string, epoch int, split string, avg_loss double, _ts string"
    append_metrics(spark.createDataFrame([("r", "epoch", e, "test", abs(2.5 - e), "2024-01-01T00:00:00") for e in range(5)], schema), path)
    steps = [("r", "step", 0, i, float(i), f"2024-01-01T0{i}:10:00") for i in range(6)]
    append_metrics(spark.createDataFrame(steps, "run string, event string, epoch int, step bigint, batch_loss double, _ts string"), path)

    out = str(tmp_path / "dash")
    streaming.publish(streaming.dashboard(stream_metrics(spark, path)), out, str(tmp_path / "s1")).awaitTermination()
    want = streaming.dashboard(read_metrics(spark, path)).collect()
    assert spark.read.parquet(out).collect() == want and tuple(want[0]) == ("r", "test", 4, 1.5, 0.5, 5)

    out = str(tmp_path / "rate")
    streaming.append_closed(streaming.step_rate(stream_metrics(spark, path)), out, str(tmp_path / "s2")).awaitTermination()
    hours = sorted(r["window_start"].hour for r in spark.read.parquet(out).collect())
    assert hours == [0, 1, 2, 3]


def test_a_table_streams_whole_as_a_folder_or_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(next((tmp_path / "written").glob("part-*")).read_bytes())
    for kind in ("folder", "file"):
        stream = streaming.stream_table(spark, str(tmp_path / kind), "documents.parquet", "wiki", docs.schema)
        out = str(tmp_path / f"{kind}-out")
        streaming.append_closed(stream, out, str(tmp_path / f"{kind}-state")).awaitTermination()
        assert spark.read.schema(stream.schema).parquet(out).count() == 20
