import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.operators.indexing import dense_index, shuffled_rank
from corpusloom.sources.documents import concat_sources, take_documents
from corpusloom.sources.pair_corpus import (
    index_pair_corpus,
    index_pairs,
    read_pair_corpus,
    read_training_text,
    write_pair_text,
    write_pairs,
)

LONG = [f"This is the long sentence number {i}." for i in range(6)]


def docs(spark, *texts):
    return spark.createDataFrame([("wiki", i, t) for i, t in enumerate(texts)], "source string, doc_id bigint, text string")


def pairs(spark, *texts):
    rows = corpus.adjacent_pairs(docs(spark, *texts)).orderBy("doc_id", "para", "pos").collect()
    return [(r["doc_id"], r["para"], r["pos"], r["s1"], r["s2"]) for r in rows]


def test_no_pair_across_a_blank_line(spark):
    got = pairs(spark, f"{LONG[0]} {LONG[1]}\n\n{LONG[2]} {LONG[3]}")
    assert got == [(0, 0, 0, LONG[0], LONG[1]), (0, 1, 0, LONG[2], LONG[3])]


def test_a_dropped_sentence_does_not_separate_its_neighbours(spark):
    assert pairs(spark, f"{LONG[0]} Too short. {LONG[1]}") == [(0, 0, 0, LONG[0], LONG[1])]


def test_length_filter_needs_both_conditions(spark):
    given = ["abcd efgh ijklmn", "aa bb cc ddddd e", "aa bbbb cccc ddd", "aaa bbb ccc ddd"]
    rows = spark.createDataFrame([(s,) for s in given], "s string").select(corpus.long_enough(F.col("s")).alias("k"))
    assert [r["k"] for r in rows.collect()] == [False, True, True, False]


def test_white_space_is_collapsed(spark):
    text = "One\xa0two\x1cthree  four words here. \n Next one　is also long enough.\n"
    assert pairs(spark, text) == [(0, 0, 0, "One two three four words here.", "Next one is also long enough.")]


def test_empty_and_missing_text(spark):
    assert pairs(spark, "", "   \n\n  ") == []


def test_result_does_not_depend_on_partitions(spark):
    given = docs(spark, *[" ".join(LONG) + "\n\n" + " ".join(LONG[::-1]) for _ in range(40)])
    results = [
        sorted(map(tuple, corpus.route_split(corpus.adjacent_pairs(given.repartition(n)), 0.3).collect())) for n in (1, 3, 16)
    ]
    assert results[0] == results[1] == results[2]
    share = sum(r[-1] == "test" for r in results[0]) / len(results[0])
    assert 0.2 < share < 0.4


def test_pairs_need_no_shuffle(spark):
    plan = corpus.route_split(corpus.adjacent_pairs(docs(spark, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pair_counts_and_sinks(spark, tmp_path):
    routed = corpus.route_split(corpus.adjacent_pairs(docs(spark, *[" ".join(LONG)] * 20)), 0.5)
    counts = {(r["source"], r["split"]): r["n_pairs"] for r in corpus.pair_counts(routed).collect()}
    assert counts[(None, None)] == 100 == counts[("wiki", "train")] + counts[("wiki", "test")]
    for _ in range(2):
        by_split = {r["split"]: r["n_pairs"] for r in write_pairs(routed, str(tmp_path / "pairs")).collect()}
        assert by_split == {"train": counts[("wiki", "train")], "test": counts[("wiki", "test")]}
    write_pair_text(routed, str(tmp_path / "text"))
    assert read_pair_corpus(spark, str(tmp_path / "text")).count() == 100


def test_cap_and_concatenation(spark):
    given = docs(spark, *"abcdefgh").repartition(3)
    assert sorted(r["doc_id"] for r in take_documents(given, 3).collect()) == [0, 1, 2]
    assert take_documents(given, -1).count() == 8 and take_documents(given, 0).count() == 0
    assert take_documents(given, 50).count() == 8
    assert take_documents(given.unionByName(given), 3).count() == 3
    assert concat_sources(given, None).count() == 8
    with pytest.raises(ValueError):
        concat_sources(None, None)


def test_pair_lines(spark, tmp_path):
    lines = [b"a\t", b"\ta\tb", b"a\tb\tc", b"ab", b"", b"\xff\tz", b"c\rd\te", b" x \t\xc2\xa0y\x1c", b"\xc2\xa0\tq"]
    (tmp_path / "c.txt").write_bytes(b"\n".join(lines) + b"\n")
    got = [(r["s1"], r["s2"]) for r in read_pair_corpus(spark, str(tmp_path / "c.txt")).orderBy("line").collect()]
    assert got == [("a", "b"), ("a", "b"), ("c\rd", "e"), ("x", "y")]
    indexed = index_pair_corpus(spark, str(tmp_path / "c.txt"))
    assert [(r["idx"], r["s1"]) for r in indexed.rows.orderBy("idx").collect()] == [(0, "a"), (1, "a"), (2, "c\rd"), (3, "x")]


def test_training_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\tb\tc\nab\n")
    (tmp_path / "b.txt").write_bytes(b"a\t\n\nc\rd\te\n")
    got = read_training_text(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    assert sorted(r["text"] for r in got) == sorted(["a", "b\tc", "ab", "a", "c", "d", "e"])
    (tmp_path / "bad.txt").write_bytes(b"\xff\tz\n")
    with pytest.raises(Exception, match="not valid UTF-8"):
        read_training_text(spark, [str(tmp_path / "bad.txt")]).collect()


def test_empty_corpus_is_an_error(spark, tmp_path):
    (tmp_path / "e.txt").write_text("no tab here\n")
    with pytest.raises(ValueError, match="no valid sentence pairs"):
        index_pair_corpus(spark, str(tmp_path / "e.txt"))
    with pytest.raises(ValueError, match="no valid sentence pairs"):
        index_pairs(corpus.route_split(corpus.adjacent_pairs(docs(spark, ""))))


def test_dense_index_with_a_hot_key(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"),
        F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"),
    )
    made = dense_index(rows.repartition(7), ("k", "v"), group="split")
    assert made.counts == {"test": 500, "train": 4500}
    for split in ("test", "train"):
        got = [(r["k"], r["v"]) for r in made.rows.filter(F.col("split") == split).orderBy("idx").collect()]
        assert got == sorted(got)
        assert sorted(r["idx"] for r in made.rows.filter(F.col("split") == split).collect()) == list(range(made.counts[split]))


@pytest.mark.parametrize("pretended", [3000, 10_000_000])
def test_shuffled_rank_is_a_permutation(spark, pretended):
    """A larger row count only means more buckets."""
    ranked = shuffled_rank(spark.range(3000).withColumnRenamed("id", "idx"), pretended, "s", 1, F.col("idx")).collect()
    by_rank = [r["idx"] for r in sorted(ranked, key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in ranked) == list(range(3000)) and by_rank != sorted(by_rank)
    other = shuffled_rank(spark.range(3000).withColumnRenamed("id", "idx"), 3000, "s", 1, F.col("idx")).collect()
    assert by_rank == [r["idx"] for r in sorted(other, key=lambda r: r["rank"])]
