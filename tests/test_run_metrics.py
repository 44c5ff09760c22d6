import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import run_metrics as G
from corpusloom.sources.metrics import append_metrics, read_metrics


def test_running_means_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    draw = random.Random(1)
    rows = [(0 if i % 3 else i % 5, i, draw.randrange(100) / 4) for i in range(900)]
    events = spark.createDataFrame([("r", *r) for r in rows], "run string, epoch int, step bigint, batch_loss double").repartition(5)
    got = {(r["epoch"], r["step"]): (r["i"], r["running_loss"]) for r in G.running_means(events).collect()}
    seen = {}
    for epoch, step, loss in rows:
        total, n = seen.get(epoch, (0.0, 0))
        seen[epoch] = (total + loss, n + 1)
        assert got[(epoch, step)] == (n, pytest.approx((total + loss) / (n + 1)))


def test_running_accuracy(spark):
    events = spark.createDataFrame([("r", 0, 0, 0, 0), ("r", 0, 1, 1, 2), ("r", 0, 2, 2, 2)], "run string, epoch int, step bigint, c bigint, t bigint")
    got = [r["acc"] for r in G.running_accuracy(events, "c", "t", "acc").orderBy("step").collect()]
    assert got == [0.0, 50.0, 75.0]


def test_losses_with_an_unmasked_batch(spark):
    nsp = spark.createDataFrame([(0, [0.0, 0.0], 0), (0, [0.0, 0.0], 1), (1, [3.0, 0.0], 0)], "batch_id int, logits array<float>, is_next int")
    mlm = spark.createDataFrame([(0, [0.0] * 4, 2)], "batch_id int, logits array<float>, label int")
    got = {r["batch_id"]: r for r in G.batch_losses(nsp, mlm).collect()}
    assert got[0]["nsp_loss"] == pytest.approx(math.log(2)) and got[0]["mlm_loss"] == pytest.approx(math.log(4))
    assert got[1]["mlm_loss"] == 0.0 and got[1]["loss"] == pytest.approx(math.log(1 + math.exp(-3)))


def test_cross_entropy_does_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 999.0], 0)], "x array<float>, y int")
    assert df.select(G.cross_entropy(F.col("x"), F.col("y"))).first()[0] == pytest.approx(math.log(1 + math.exp(-1)))


def test_qa_losses(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], [0.0] * 4, 0, 1)],
                               "batch_id int, start_logits array<float>, end_logits array<float>, start_position int, end_position int")
    assert G.qa_batch_losses(df).first()["loss"] == pytest.approx((math.log(2) + math.log(4)) / 2)


def test_accuracies(spark):
    nsp = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 0), ([1.0, 1.0], 0)], "logits array<float>, is_next int")
    assert G.nsp_accuracy(nsp).first()["nsp_acc"] == pytest.approx(200 / 3)
    labelled = spark.createDataFrame([(0, 7), (1, 8)], "k int, label int")
    predicted = spark.createDataFrame([(0, 7), (1, 9)], "k int, prediction int")
    assert tuple(G.mlm_accuracy(labelled, predicted, ["k"]).first()) == (50.0, 2)
    assert tuple(G.mlm_accuracy(labelled.limit(0), predicted, ["k"]).first()) == (0.0, 0)


def test_epoch_summary_weighs_batches_alike_and_elements_alike(spark):
    rows = [("r", 0, 1.0, 4.0, 2.0, 1, 2, 8, 8), ("r", 0, 3.0, 0.0, 2.0, 0, 0, 0, 2)]
    names = "run string, epoch int, loss double, mlm_loss double, nsp_loss double, mlm_correct int, mlm_total int, nsp_correct int, nsp_total int"
    row = G.epoch_summary(spark.createDataFrame(rows, names)).first()
    assert (row["avg_loss"], row["avg_mlm_loss"], row["mlm_acc"], row["nsp_acc"]) == (2.0, 2.0, 50.0, 80.0)


def test_runs_with_equal_steps_stay_apart(spark):
    rows = [(run, 0, step, loss) for run, loss in (("a", 1.0), ("b", 100.0)) for step in range(4)]
    events = spark.createDataFrame(rows, "run string, epoch int, step bigint, batch_loss double")
    means = G.running_means(events)
    got = {(r["run"], r["step"]): (r["i"], r["running_loss"], r["is_last"]) for r in means.collect()}
    assert got == {(run, s): (s, loss, s == 3) for run, _, s, loss in rows}
    assert sorted((r["run"], r["i"]) for r in G.logged_steps(means, 2).collect()) == [(x, i) for x in "ab" for i in (0, 2, 3)]
    batches = events.selectExpr("run", "epoch", "batch_loss as loss", "batch_loss as mlm_loss", "batch_loss as nsp_loss", "1 as mlm_correct", "1 as mlm_total", "1 as nsp_correct", "1 as nsp_total")
    assert {r["run"]: r["avg_loss"] for r in G.epoch_summary(batches).collect()} == {"a": 1.0, "b": 100.0}


def test_improvements(spark):
    df = spark.createDataFrame([("r", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 1.0])], "run string, epoch int, v double")
    low = G.improvements(df, "v")
    assert [r["is_best"] for r in low.orderBy("epoch").collect()] == [True, True, False, True]
    assert G.best_epoch(low).first()["epoch"] == 3
    high = G.improvements(df.withColumn("v", F.col("v") - 3.5), "v", lower_is_better=False, start=-1.0)
    assert [r["is_best"] for r in high.orderBy("epoch").collect()] == [True, False, False, False]


def test_logged_steps(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 3)
    events = spark.createDataFrame([("r", e, 10 * e + s, 1.0) for e in range(2) for s in range(8)], "run string, epoch int, step bigint, batch_loss double")
    logged = G.logged_steps(G.running_means(events), 3)
    assert sorted((r["epoch"], r["i"]) for r in logged.collect()) == [(e, i) for e in range(2) for i in (0, 3, 6, 7)]


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    steps = spark.createDataFrame([("r", "step", 0, 1, 0.5)], "run string, event string, epoch int, step bigint, batch_loss double")
    epochs = spark.createDataFrame([("r", "epoch", e, "test", 3.0 - e) for e in range(3)],
                                   "run string, event string, epoch int, split string, avg_loss double")
    append_metrics(steps, path)
    append_metrics(epochs, path)
    events = read_metrics(spark, path)
    assert events.count() == 4 and events.filter("_ts is null").count() == 0
    assert tuple(G.final_metrics(events, "test", ["avg_loss"]).first()) == ("r", 2, 1.0)
    assert [r["avg_loss"] for r in G.epoch_curve(events, ["avg_loss"]).collect()] == [3.0, 2.0, 1.0]
