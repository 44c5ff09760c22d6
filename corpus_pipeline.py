"""The corpus pipeline: from documents to packed sequences of tokens, each stage on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, dedup, packing, pii, toxicity
from corpusloom.llm.language import held_out
from corpusloom.session import written

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic; the rows held out for tests teach nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    examples = toxicity.fit(docs, labels)
    return toxicity.score(docs, examples).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once.

    Rows that repeat an id are judged by their own text; those with the same word runs are one document, of which the row
    that is smallest by its text and then by a hash of all columns stays. Rows without an id stay.
    """
    found = dedup.near_documents(docs.where("doc_id is not null")).where("kept and head")
    kept = found.groupBy("doc_id", F.coalesce("high", "text_hash")).agg(F.min("text_hash").alias("_text")).select("doc_id", "_text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    chosen = rows.join(kept.hint("merge"), ["doc_id", "_text"], "left_semi")
    of_text = chosen.groupBy("doc_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return of_text.select("_row.*").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is shared with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark, carry=list(docs.columns))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find(docs).withColumn("_redacted", pii.redact(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.char_length("_redacted").cast("bigint")).otherwise(F.col("n_chars"))
    columns = {"text": F.col("_redacted"), "n_chars": n_chars}
    return found.select(*[columns[c].alias(c) if c in columns else c for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in a sequence of at most 4096 tokens."""
    return packing.pack_texts(docs, carry=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Nearest neighbours, shingle hashes, learnt labelers and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
