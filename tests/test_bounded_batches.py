import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import merging
from corpusloom.operators import encoding, qa_features, samples
from corpusloom.operators.vocabulary import byte_vocabulary

# Folding moves characters of some of them, reserved tokens cut others, and some have no piece.
ODD = ["", None, "plain words here", "été a là <mask> carte", "한국어 <eos><eos>x", "  two  spaces", "日本 \U0001f600"]


@pytest.fixture
def vocabularies():
    plain = byte_vocabulary()
    a, b = plain.tokens.index("a"), plain.tokens.index("r")
    merged = type(plain)((*plain.tokens, "ar"), ((a, b, len(plain.tokens)),))
    return plain, merged


def test_rows_are_cut_into_slices_by_their_bytes(monkeypatch):
    monkeypatch.setattr(merging, "SLICE_BYTES", 10)
    pieces = pa.array([["abcd", "ef"], None, ["gh"], ["i" * 50], [], ["é" * 4], ["j", "k"], ["l"]], pa.list_(pa.string()))
    assert list(merging.row_slices(pieces)) == [(0, 3), (3, 1), (4, 3), (7, 1)]
    assert list(merging.row_slices(pieces.slice(2, 3))) == [(0, 1), (1, 1), (2, 1)]
    assert list(merging.row_slices(pieces.slice(0, 0))) == []
    assert sum(n for _, n in merging.row_slices(pieces)) == len(pieces)


def test_one_batch_of_many_texts_is_encoded_in_bounded_parts(spark, monkeypatch):
    texts = spark.createDataFrame([(i, ODD[i % 7] and ODD[i % 7] + f" {i}" * (i % 5)) for i in range(300)], "i int, text string").coalesce(1)
    vocabulary = byte_vocabulary()

    def encoded():
        e = encoding.encode_with_offsets(F.col("text"), vocabulary)
        return sorted(map(str, texts.select("i", encoding.encode(F.col("text"), vocabulary).alias("ids"), e.alias("e")).collect()))

    whole = encoded()
    monkeypatch.setattr(merging, "SLICE_BYTES", 64)
    assert encoded() == whole and len(whole) == 300


def test_no_work_array_is_as_long_as_a_batch(monkeypatch):
    monkeypatch.setattr(merging, "SLICE_BYTES", 1000)
    seen, encode = [], merging.encode_batch
    monkeypatch.setattr(merging, "encode_batch", lambda pieces, *a: seen.append(len(pieces)) or encode(pieces, *a))
    run = merging.ids_function((), list(range(256)), {"<pad>": 0}).func
    batch = pa.array([["word", " and"] * 10] * 500, pa.list_(pa.string()))
    made = pa.concat_arrays(list(run(iter([batch]))))
    assert len(made) == 500 and sum(seen) == 500 and max(seen) * 80 <= 1000
    assert np.array_equal(made[499].as_py(), [*b"word and" * 10])


def test_work_on_a_full_batch_of_contexts_stays_small():
    context = [f" word{i}" for i in range(100)]
    pieces = pa.array([context] * 10_000, pa.list_(pa.string()))
    nothing = pa.nulls(len(pieces), pa.list_(pa.int32()))
    columns = (pieces, nothing.cast(pa.list_(pa.bool_())), nothing, pa.array([sum(map(len, context)) - 1] * len(pieces)))
    for run, batch in ((merging.ids_function, pieces), (merging.spans_function, columns)):
        tracemalloc.start()
        rows = sum(len(part) for part in run((), list(range(256)), {"<pad>": 0}).func(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 10_000 and peak < 48 << 20


def test_texts_that_need_no_cutting_give_the_ids_of_their_pieces(spark):
    texts = spark.createDataFrame([(x,) for x in [*ODD, "<", " <eos> a", "a\x1c b\u3000c", "\u0301 x", "x" * 300]], "text string")
    broken = texts.limit(1).select(F.unhex(F.lit("61e962ff20f09f98")).cast("string").alias("text"))
    texts = texts.unionByName(broken)
    for lowercase in (True, False):
        one = encoding.ids_function((), encoding.byte_ids(), encoding._SPECIAL_IDS)
        cut = one(encoding.pieces_for_encoding(F.col("text"), lowercase))
        uncut = one(encoding.uncut_for_encoding(F.col("text"), lowercase))
        rows = texts.select(cut.alias("cut"), uncut.alias("uncut")).collect()
        assert len(rows) == 13 and [r["cut"] for r in rows] == [r["uncut"] for r in rows]


def test_two_texts_of_a_row_are_encoded_by_one_worker(spark, vocabularies):
    texts = spark.createDataFrame([(a, b) for a in ODD for b in ODD], "s1 string, s2 string")
    for vocabulary in vocabularies:
        ids = samples.pair_ids(texts, vocabulary, "s1", "s2")
        plan = ids._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and ("regexp_extract_all" in plan) == bool(vocabulary.merges)
        one_by_one = ids.select("i1", "i2", encoding.encode(F.col("s1"), vocabulary).alias("e1"), encoding.encode(F.col("s2"), vocabulary).alias("e2"))
        rows = one_by_one.collect()
        assert len(rows) == 49 and all(r["i1"] == r["e1"] and r["i2"] == r["e2"] for r in rows)


def test_slices_of_a_full_batch_are_found_without_arrays_of_its_pieces():
    pieces = pa.array([[f" word{i}" for i in range(100)]] * 10_000, pa.list_(pa.string()))
    tracemalloc.start()
    slices = list(merging.row_slices(pieces, pieces.cast(pa.list_(pa.large_string()))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in slices) == 10_000 and len(slices) > 40 and peak < 1 << 20
    assert merging.bytes_before(pieces.slice(3, 2)).tolist() == [0, 690, 1380]


def test_question_and_context_are_encoded_by_one_worker(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(merging, "SLICE_BYTES", 64)
    examples = spark.createDataFrame([(a, b) for a in ODD for b in ODD], "question string, context string").coalesce(1)
    for vocabulary in vocabularies:
        made = qa_features.encode_examples(examples, vocabulary)
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        apart = made.select(
            "q_ids", "c_ids", "c_offsets",
            encoding.encode(F.col("question"), vocabulary).alias("q"), encoding.encode_with_offsets(F.col("context"), vocabulary).alias("c"),
        )
        rows = apart.collect()
        assert len(rows) == 49 and all(r["q_ids"] == r["q"] and r["c_ids"] == r["c"]["ids"] and r["c_offsets"] == r["c"]["offsets"] for r in rows)


def test_indexes_of_evaluation_features_need_no_context(spark, vocabularies):
    examples = spark.createDataFrame([(i, "q" * n, "some context") for i, n in enumerate((0, 3, 9, 10, 60))], "ex_idx long, question string, context string")
    for vocabulary in vocabularies:
        judged = qa_features.judged_features(qa_features.encode_examples(examples, vocabulary), False, 12, 64)
        whole = sorted(r[0] for r in qa_features.eval_features(judged, 12).select("feature_index").collect())
        alone = qa_features.eval_feature_indexes(examples.drop("context"), vocabulary, 12, 64)
        assert sorted(r[0] for r in alone.collect()) == whole and 0 < len(whole) < 5
