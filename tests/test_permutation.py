import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.catalog import derived as D
from corpusloom.functions.permutation import Permutation
from corpusloom.operators import samples


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 103, 1009, 4096])
def test_every_number_has_its_own_place(spark, n):
    made = Permutation(n, ("t", 3))
    rows = spark.range(n).select("id", made.of(F.col("id")).alias("to"), made.at(made.of(F.col("id"))).alias("back"), made.next(F.col("id")).alias("next"))
    told = rows.collect()
    assert sorted(r["to"] for r in told) == sorted(r["next"] for r in told) == list(range(n))
    assert all(r["back"] == r["id"] for r in told)
    assert n < 2 or all(r["next"] != r["id"] for r in told)
    at, seen = 0, 0
    following = {r["id"]: r["next"] for r in told}
    while n and (seen == 0 or at != 0):  # one circle holds them all
        at, seen = following[at], seen + 1
    assert seen == n


def test_numbers_that_land_outside_are_followed(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.functions.permutation.SIDES", 1)
    made = Permutation(111, ("t", 5))
    assert made.grid == (11, 11) and made.passes > 1
    told = spark.range(111).select("id", made.of(F.col("id")).alias("to"), made.at(made.of(F.col("id"))).alias("back")).collect()
    assert sorted(r["to"] for r in told) == list(range(111)) and all(r["back"] == r["id"] for r in told)


def test_keys_differ_and_places_are_spread(spark):
    one, two = ([r[0] for r in spark.range(1000).select(Permutation(1000, ("s", k)).of(F.col("id"))).collect()] for k in (0, 1))
    assert sum(a == b for a, b in zip(one, two)) < 15
    assert sum(a < b for a, b in zip(one, one[1:])) in range(440, 560)
    assert 480_000 < sum(abs(a - b) for a, b in zip(one, one[1:])) / 999 * 1500 < 520_000
    assert sum(p < 500 for p in one[:500]) in range(210, 290)


def test_batches_are_made_without_a_shuffle(spark):
    pairs = D.indexed_pairs(spark, SMALL)
    train = pairs.rows.filter("split = 'train'").select("idx")
    made = samples.epoch_batches(train, pairs.counts["train"], 32, 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_no_sentence_is_drawn_twice(spark):
    pairs = D.indexed_pairs(spark, SMALL)
    drawn = samples.sample_second_sentences(pairs, 5, repeat=False).join(pairs.rows.select("split", "idx", F.col("s2").alias("own")), ["split", "idx"])
    negatives = drawn.filter("is_next = 0")
    rows = pairs.rows.select("split", "s2").groupBy("split", "s2").agg(F.count("*").alias("most"))
    used = negatives.groupBy("split", "s2").agg(F.count("*").alias("n")).join(rows, ["split", "s2"], "left")
    assert negatives.count() > 100 and used.filter("most is null or n > most").count() == 0
