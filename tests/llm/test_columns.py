"""Columns of the input that are called like those an operator adds, nulls in every column, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, dedup, divergence, fingerprints, language, line_crf, packing, pii, quality, toxicity, warc, whitening


@pytest.fixture(scope="module")
def clashing(spark):
    names = "score evidence cosines passage attention spans n_words n_hit hit_spans items n_items contaminated piece start length ids sequence_id offset closed part id label component sketch h idx c0 class_id _salt n docs lang_n leads deal term value rank x copies h1 h2 deviation kept content_share n_symbols".split()
    rows = [(1, "a b c 1.2.3.4", "x", None, 9), (2, None, None, "s", None), (None, "", "x", None, 0), (1, "a b c 1.2.3.4", "x", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.lit(7) for n in names})


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    benchmark = spark.createDataFrame([(1, "a b c", 3)], "item_id long, text string, n_words int")
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "*")
    return {
        "packing": lambda d: packing.pack(packing.token_pieces(d)),
        "near": dedup.near_documents,
        "passages": lambda d: dedup.repeated_passages(d, 1, 2),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "fingerprints": fingerprints.edited_likeness,
        "quality": lambda d: quality.score(d, quality.fit(d, labels)),
        "warc": lambda d: warc.archive_round_trip(pages(d)),
        "pii": pii.find,
        "decontamination": lambda d: decontamination.contamination(d, benchmark),
        "language": lambda d: language.identify(d, language.fit_profiles(d)),
        "divergence": divergence.audit,
        "whitening": lambda d: whitening.whiten(d.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.expr("array(1.5, 2, length(text))")), 1),
        "lines": lambda d: line_crf.judge(d, line_crf.fit(d)),
    }


@pytest.mark.parametrize("name", ["packing", "near", "passages", "toxicity", "fingerprints", "quality", "warc", "pii", "decontamination", "language", "divergence", "whitening", "lines"])
def test_clashing_columns_nulls_and_no_rows(spark, clashing, name):
    run = operators(spark)[name]
    rows = run(clashing).collect()
    assert len(rows) == {"divergence": 0, "whitening": 3}.get(name, 4) or name == "passages"
    assert run(clashing.limit(0)).collect() == []


def test_stages_on_no_rows(spark, documents, tmp_path):
    docs = documents([])
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
