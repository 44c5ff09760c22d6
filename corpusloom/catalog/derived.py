"""Inputs that the reference reads from files this repository does not have, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..operators import bpe, sentence_model
from ..operators.corpus import adjacent_pairs, route_split
from ..operators.indexing import Indexed
from ..operators.qa_features import encode_examples
from ..operators.vocabulary import Vocabulary, byte_vocabulary
from ..session import scratch_path, written
from ..sources.documents import concat_sources, scan_documents
from ..sources.pair_corpus import index_pairs
from ..sources.squad import read_qa_examples

# Only ASCII letters are shouted: engines differ on the capital of a sharp s.
_LOWER = "abcdefghijklmnopqrstuvwxyz"

TEST_RATIO = 0.05
# Size of the vocabulary that SQL trains as well, step by step: nine queries do, each in a few seconds.
VOCAB_SIZE = 400
SEQ_LEN = 128


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return scan_documents(spark, f"{sf}/documents.parquet", "wiki")


def books(spark: SparkSession, sf: str) -> DataFrame:
    return scan_documents(spark, f"{sf}/benchmark.parquet", "books", "item_id")


def all_documents(spark: SparkSession, sf: str) -> DataFrame:
    return concat_sources(documents(spark, sf), books(spark, sf))


def paragraph_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which every line is a paragraph."""
    return all_documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def routed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return route_split(adjacent_pairs(paragraph_documents(spark, sf)), TEST_RATIO)


def _once_per_session(build):
    """Build a written table or model once per Spark application and folder, as its users would."""

    made: dict[tuple[str, str], object] = {}

    def get(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf)
        if key not in made:
            made[key] = build(spark, sf)
        return made[key]

    return get


@_once_per_session
def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_model.word_pairs(paragraph_documents(spark, sf))


@_once_per_session
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return written(sentence_model.word_counts(word_pairs(spark, sf)), "word-counts")


@_once_per_session
def learnt_sentences(spark: SparkSession, sf: str) -> sentence_model.SentenceModel:
    return sentence_model.learn_from_pairs(word_pairs(spark, sf))


@_once_per_session
def indexed_pairs(spark: SparkSession, sf: str) -> Indexed:
    return index_pairs(routed_pairs(spark, sf))


@_once_per_session
def symbol_words(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct pieces of all documents as symbols, written once."""
    return written(bpe.symbol_words(bpe.piece_frequencies(all_documents(spark, sf))), "words")


@_once_per_session
def first_pair(spark: SparkSession, sf: str) -> tuple[int, int]:
    """Ids of the most frequent pair of symbols."""
    found = bpe.pair_ids(bpe.top_pairs(bpe.pair_counts(symbol_words(spark, sf)), 1)).first()
    return found[0], found[1]


@_once_per_session
def trained(spark: SparkSession, sf: str) -> bpe.Training:
    return bpe.train(bpe.piece_frequencies(all_documents(spark, sf)), VOCAB_SIZE)


def vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    return trained(spark, sf).vocabulary


def bytes_only() -> Vocabulary:
    """The vocabulary without merges, whose ids plain SQL can compute as well."""
    return byte_vocabulary()


@_once_per_session
def line_files(spark: SparkSession, sf: str) -> list[str]:
    """Two text files of tab-separated fields: the lines of both sources, cut at their commas."""
    paths = []
    for name, docs in (("documents", documents(spark, sf)), ("books", books(spark, sf))):
        path = scratch_path(spark, f"lines-{name}")
        lines = docs.select(F.explode_outer(F.split("text", "\n")).alias("line"))
        lines.select(F.replace("line", F.lit(", "), F.lit("\t"))).write.text(path)
        paths.append(path)
    return paths


def qa_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn as question and the next turn, of the assistant, as context. The answer is taken from the third word
    on, or from the end, or is missing, as a draw decides."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context")
    )
    words = F.split("context", " ")
    first = F.substring(digest("answer", F.col("conv_id"), F.col("turn")), 1, 1)
    joined = asked.join(replies, ["conv_id", "turn"]).withColumn("words", words).withColumn("draw", first)
    early = F.array_join(F.slice("words", 3, 3), " ")
    late = F.array_join(F.slice("words", F.greatest(F.size("words") - 2, F.lit(1)), F.lit(3)), " ")
    answer = F.when((F.col("draw") == "0") | (F.size("words") < 5), None).when(F.col("draw") == "1", late).otherwise(early)
    start = F.when(F.col("draw") == "1", F.length("context") - F.length(late)).otherwise(
        F.length(F.array_join(F.slice("words", 1, 2), " ")) + 1
    )
    return joined.select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("qid"),
        "question",
        "context",
        answer.alias("answer"),
        F.when(answer.isNotNull(), start).alias("answer_start"),
        F.when(F.col("draw") < "8", F.substring_index(answer, " ", 1)).alias("also"),
    )


def _golds():
    """The answer of a question and, for half of them, its first word as a second one."""
    gold = lambda c: F.struct(F.col(c).alias("text"), F.col("answer_start").alias("answer_start"))
    given = F.when(F.col("also").isNull(), F.array(gold("answer"))).otherwise(F.array(gold("answer"), gold("also")))
    return F.when(F.col("answer").isNotNull(), given)


@_once_per_session
def qa_examples(spark: SparkSession, sf: str) -> Indexed:
    """Question-answering JSON written from conversations, one article per line in order, and read back."""
    path = scratch_path(spark, "qa")
    answers = _golds()
    qa = F.struct(F.col("qid").alias("id"), "question", answers.alias("answers"))
    article = F.array(F.struct("context", F.array(qa).alias("qas")))
    turns = qa_turns(spark, sf).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    turns.select(article.alias("paragraphs")).write.json(path)
    return read_qa_examples(spark, path, articles_per_line=True)


@_once_per_session
def qa_object(spark: SparkSession, sf: str) -> str:
    """The same examples in the usual layout: one JSON object in one file."""
    path = scratch_path(spark, "qa-object")
    answers = _golds()
    qa = F.struct(F.col("qid").alias("id"), "question", answers.alias("answers"))
    article = F.struct(F.lit("}{ \" ").alias("title"), F.array(F.struct("context", F.array(qa).alias("qas"))).alias("paragraphs"))
    places = F.lit(1).alias("at"), "conv_id", "turn"
    rows = qa_turns(spark, sf).select(*places, F.concat(F.lit(", "), F.to_json(article)).alias("value"))
    frame = spark.createDataFrame([(0, '{"version": "1.1", "data": [{}'), (2, '], "about": {"n": 1}}')], "at int, value string")
    whole = rows.unionByName(frame, allowMissingColumns=True).repartition(1).sortWithinPartitions("at", "conv_id", "turn")
    whole.select("value").write.option("lineSep", " ").text(path)
    return path


def encoded_examples(spark: SparkSession, sf: str) -> DataFrame:
    return encode_examples(qa_examples(spark, sf).rows, bytes_only())


def logits(features: DataFrame, seq_len: int = 384) -> DataFrame:
    """Start and end scores per position, drawn per feature: multiples of 1/16, so that equal scores occur."""

    def drawn(kind: str):
        positions = F.sequence(F.lit(0), F.lit(seq_len - 1))
        return F.transform(
            positions,
            lambda p: (
                (F.conv(F.substring(digest(kind, F.col("feature_index"), p), 1, 2), 16, 10).cast("int") - 128) / 16
            ).cast("float"),
        )

    return features.select("feature_index", drawn("start").alias("start_logits"), drawn("end").alias("end_logits"))


def gold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The gold answer of each question in one of five forms: as it is, shouted, without its first word, empty, or absent."""
    examples = qa_examples(spark, sf).rows
    gold = F.coalesce(F.get("answers", F.lit(0)), F.lit("the"))
    draw = F.substring(digest("prediction", F.col("qid")), 1, 1)
    text = (
        F.when(draw < "6", gold)
        .when(draw < "9", F.concat(F.lit("The "), F.translate(gold, _LOWER, _LOWER.upper()), F.lit("!")))
        .when(draw < "c", F.regexp_replace(gold, "^[^ ]* ", ""))
        .when(draw < "e", F.lit(""))
    )
    return examples.select("qid", text.alias("text")).filter(F.col("text").isNotNull())


def metric_events(spark: SparkSession, sf: str) -> DataFrame:
    """Step records from ``events``: an epoch per day, a run per event type."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        F.lit("step").alias("event"),
        (F.dayofyear("ts") - 1).alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("value").cast("decimal(12,2)").alias("batch_loss"),
        "user_id",
        "ts",
    )


def epoch_events(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch records: the mean loss of each run's day, for both splits."""
    steps = metric_events(spark, sf)
    split = F.when(F.pmod("user_id", F.lit(2)) == 0, "test").otherwise("train").alias("split")
    means = steps.groupBy("run", "epoch", split).agg(
        (F.sum("batch_loss").cast("double") / F.count("*")).alias("avg_loss"), F.max("ts").alias("ts")
    )
    return means.select("run", F.lit("epoch").alias("event"), "epoch", "split", "avg_loss", "ts")


@_once_per_session
def metric_log(spark: SparkSession, sf: str) -> str:
    """The event log: step records and epoch records appended as JSON lines."""
    from ..sources.metrics import append_metrics

    path = scratch_path(spark, "metrics")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("_ts")
    steps = metric_events(spark, sf)
    append_metrics(steps.select("run", "event", "epoch", "step", F.col("batch_loss").cast("double"), stamp), path)
    append_metrics(epoch_events(spark, sf).select("run", "event", "epoch", "split", "avg_loss", stamp), path)
    return path


def batch_rows(spark: SparkSession, sf: str, batch_size: int = 16) -> DataFrame:
    """``batch_id, logits, label`` from ``embeddings``."""
    batch = F.floor(F.col("vec_id") / batch_size).cast("bigint").alias("batch_id")
    return table(spark, sf, "embeddings").select(batch, F.col("embedding").alias("logits"), F.col("label").alias("label"))


