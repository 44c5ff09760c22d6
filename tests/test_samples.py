import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import samples
from corpusloom.operators.indexing import Indexed, dense_index
from corpusloom.operators.vocabulary import byte_vocabulary

V = 1000


def indexed(spark, n, parts=2):
    rows = spark.range(n).select(
        F.lit("train").alias("split"), F.concat(F.lit("first sentence "), "id").alias("s1"),
        F.concat(F.lit("second sentence "), "id").alias("s2"), F.col("id").alias("idx"),
    )
    return Indexed(rows.repartition(parts), {"train": n})


def test_second_sentences(spark):
    rows = samples.sample_second_sentences(indexed(spark, 4000), 3).collect()
    assert sorted(r["idx"] for r in rows) == list(range(4000))
    own = {r["idx"]: r["s2"] == f"second sentence {r['idx']}" for r in rows}
    assert all(own[r["idx"]] == (r["is_next"] == 1) for r in rows)
    assert 0.45 < sum(r["is_next"] for r in rows) / 4000 < 0.55
    again = samples.sample_second_sentences(indexed(spark, 4000, 5), 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = samples.sample_second_sentences(indexed(spark, 4000), 3, epoch=1).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, rows))


def test_a_lone_pair_keeps_its_sentence(spark):
    seen = set()
    for seed in range(8):
        (row,) = samples.sample_second_sentences(indexed(spark, 1), seed).collect()
        assert row["s2"] == "second sentence 0"
        seen.add(row["is_next"])
    assert seen == {0, 1}


def test_splits_draw_from_themselves(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.col("id").alias("k"),
        F.lit("a").alias("s1"), F.concat_ws("-", F.when(F.col("id") % 3 == 0, "test").otherwise("train"), "id").alias("s2"),
    )
    made = samples.sample_second_sentences(dense_index(rows, ("k",), group="split"), 1).collect()
    assert len(made) == 600 and all(r["s2"].startswith(r["split"]) for r in made)


def masked(spark, ids, *key):
    df = spark.createDataFrame([(i, row) for i, row in enumerate(ids)], "i int, ids array<int>")
    codes = samples.mask_codes(F.col("ids"), V, *key, F.col("i"))
    made = df.withColumn("c", codes).select(
        "i", "ids", samples.masked_input(F.col("ids"), F.col("c")).alias("x"), samples.masked_label(F.col("ids"), F.col("c")).alias("y")
    )
    return made.orderBy("i").collect()


def test_masking_rates(spark):
    draw = random.Random(0)
    rows = masked(spark, [[draw.randrange(5, V) for _ in range(200)] for _ in range(500)], "m", 1)
    flat = [(t, x, y) for r in rows for t, x, y in zip(r["ids"], r["x"], r["y"])]
    chosen = [(t, x) for t, x, y in flat if y]
    assert all(y in (0, t) for t, _, y in flat) and all(x == t for t, x, y in flat if not y)
    assert abs(len(chosen) / len(flat) - 0.15) < 0.005
    shares = {"mask": sum(x == 4 for _, x in chosen), "kept": sum(x == t for t, x in chosen)}
    assert abs(shares["mask"] / len(chosen) - 0.8) < 0.015 and abs(shares["kept"] / len(chosen) - 0.1) < 0.012
    replaced = [x for t, x in chosen if x not in (4, t)]
    assert min(replaced) >= 5 and max(replaced) < V and len(set(replaced)) > 600


def test_neighbouring_draws_are_independent(spark):
    rows = masked(spark, [list(range(5, 205)) for _ in range(800)], "m", 2)
    both = sum(bool(a) and bool(b) for r in rows for a, b in zip(r["y"], r["y"][1:]))
    assert abs(both / (800 * 199) - 0.15**2) < 0.002


def test_reserved_tokens_are_never_selected(spark):
    rows = masked(spark, [[0, 1, 2, 3, 4] * 40] * 20 + [[]], "m")
    assert all(r["x"] == r["ids"] and not any(r["y"]) for r in rows)


def popped(n1, n2, budget):
    while n1 + n2 > budget:
        if n1 >= n2:
            n1 -= 1
        else:
            n2 -= 1
    return n1, n2


def test_truncation_is_that_of_popping(spark):
    cases = [(a, b, s) for s in (3, 4, 5, 12, 17, 30) for a in range(0, 36, 1) for b in range(0, 36, 3)]
    for s in {c[2] for c in cases}:
        df = spark.createDataFrame([c[:2] for c in cases if c[2] == s], "a int, b int")
        n1, n2 = samples.pair_lengths(F.col("a"), F.col("b"), s)
        for r in df.select("a", "b", n1.alias("x"), n2.alias("y")).collect():
            assert (r["x"], r["y"]) == popped(r["a"], r["b"], s - 3)


@pytest.mark.parametrize("a,b,want", [(10, 3, (6, 3)), (3, 10, (3, 6)), (9, 9, (4, 5)), (8, 9, (4, 5))])
def test_truncation_examples(spark, a, b, want):
    n1, n2 = samples.pair_lengths(F.lit(a), F.lit(b), 12)
    assert tuple(spark.range(1).select(n1, n2).first()) == want


def test_samples_have_one_length_and_cutting_first_changes_nothing(spark):
    v = byte_vocabulary()
    pairs = indexed(spark, 50)
    short = samples.pretraining_samples(pairs, v, 16, seed=5).collect()
    long = {r["idx"]: r for r in samples.pretraining_samples(pairs, v, 64, seed=5).collect()}
    assert len(short) == 50
    for r in short:
        assert len(r["bert_input"]) == len(r["bert_label"]) == len(r["segment_label"]) == 16
        assert r["bert_input"][0] == 3 and r["bert_input"][-1] == 2 and r["segment_label"] == [1] * 8 + [2] * 8
        full = long[r["idx"]]
        assert full["bert_input"][1:7] == r["bert_input"][1:7] and full["bert_label"][1:7] == r["bert_label"][1:7]
    one = samples.pretraining_samples(indexed(spark, 50, 1), v, 16, seed=5).collect()
    assert sorted(map(str, one)) == sorted(map(str, short))


def test_assembled_sample(spark):
    df = spark.createDataFrame([("train", 0, 1, [10, 11], [12])], "split string, idx int, is_next int, i1 array<int>, i2 array<int>")
    coded = df.withColumns({"codes1": F.array(F.lit(0), F.lit(4)), "codes2": F.array(F.lit(12))})
    row = samples.assemble(coded, 8).first()
    assert row["bert_input"] == [3, 10, 4, 2, 12, 2, 0, 0]
    assert row["bert_label"] == [0, 0, 11, 0, 12, 0, 0, 0]
    assert row["segment_label"] == [1, 1, 1, 1, 2, 2, 0, 0]
    positions = samples.masked_positions(samples.assemble(coded, 8), "idx").orderBy("position").collect()
    assert [(r["position"], r["label"]) for r in positions] == [(2, 11), (4, 12)]


def test_batches(spark):
    rows = spark.range(103).withColumnRenamed("id", "idx").repartition(5)
    full = samples.epoch_batches(rows, 103, 10, seed=1).collect()
    assert len(full) == 100 and {(r["batch_id"], r["in_batch"]) for r in full} == {(b, i) for b in range(10) for i in range(10)}
    assert {r["idx"] for r in full} != {r["idx"] for r in samples.epoch_batches(rows, 103, 10, seed=1, epoch=1).collect()} or (
        sorted((r["idx"], r["batch_id"]) for r in full)
        != sorted((r["idx"], r["batch_id"]) for r in samples.epoch_batches(rows, 103, 10, seed=1, epoch=1).collect())
    )
    kept = samples.epoch_batches(rows, 103, 10, shuffle=False, drop_last=False)
    assert all(r["batch_id"] == r["idx"] // 10 for r in kept.collect()) and kept.count() == 103


def test_step_plan(spark):
    kept = samples.epoch_batches(spark.range(103).withColumnRenamed("id", "idx"), 103, 10, shuffle=False, drop_last=False)
    plan = samples.step_plan(spark, 103, 10, accumulation=4, epochs=2, drop_last=False).first()
    assert tuple(plan) == (11, 3, 6, 40)
    flags = {r["batch_id"]: (r["n"], r["is_boundary"], r["step"]) for r in samples.step_boundaries(kept, samples.batch_count(103, 10, drop_last=False), 4).collect()}
    assert [b for b, f in flags.items() if f[1]] and sorted(b for b, f in flags.items() if f[1]) == [3, 7, 10]
    assert flags[10] == (3, True, 3)
    assert tuple(samples.step_plan(spark, 9, 10, 4, 2).first()) == (0, 0, 0, 40)
    assert tuple(samples.step_plan(spark, 9, 10, 4, 2, at_least=1).first()) == (1, 1, 2, 40)


def test_ordered_batches_of_keys_with_gaps(spark):
    rows = spark.createDataFrame([(k,) for k in (40, 3, 7, 90, 12)], "feature bigint")
    got = samples.epoch_batches(rows, 5, 2, shuffle=False, drop_last=False, key="feature", dense=False).collect()
    assert sorted((r["feature"], r["batch_id"], r["in_batch"]) for r in got) == [(3, 0, 0), (7, 0, 1), (12, 1, 0), (40, 1, 1), (90, 2, 0)]
