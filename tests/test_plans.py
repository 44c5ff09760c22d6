from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.operators.samples import encoded_pairs, epoch_samples, pretraining_samples
from corpusloom.sources.pair_corpus import index_pairs


def test_documents_to_batches(spark, tmp_path):
    out = str(tmp_path / "pairs")
    wiki, books = (f"{SMALL}/documents.parquet", "doc_id"), (f"{SMALL}/benchmark.parquet", "item_id")
    counts = plans.build_corpus(spark, out, wiki, books, max_articles=60, max_books=10, test_ratio=0.2)
    counts = {r["split"]: r["n_pairs"] for r in counts.collect()}
    pairs = spark.read.parquet(out)
    assert pairs.groupBy("source").agg(F.count_distinct("doc_id").alias("n")).filter("n > 60").count() == 0
    only = plans.build_corpus(spark, str(tmp_path / "books"), None, books, test_ratio=0.0)
    assert [r["split"] for r in only.collect()] == ["train"]

    vocabulary = plans.train_vocabulary(pairs, vocab_size=275)
    assert len(vocabulary) == 275
    train = plans.training_batches(pairs, vocabulary, seq_len=32, batch_size=16, seed=3)
    sizes = train.groupBy("batch_id").count().collect()
    assert len(sizes) == counts["train"] // 16 and {r["count"] for r in sizes} == {16}
    test = plans.test_batches(pairs, vocabulary, seq_len=32, batch_size=16)
    assert test.count() == counts["test"]

    indexed = index_pairs(pairs)
    once = pretraining_samples(indexed, vocabulary, 32, seed=3, epoch=2)
    again = epoch_samples(encoded_pairs(indexed, vocabulary), len(vocabulary), 32, seed=3, epoch=2)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.select(once.columns).collect()))
