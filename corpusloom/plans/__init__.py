"""The whole flows, composed from the operators: each stage reads tables and writes tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import bpe, qa_eval, qa_features
from ..operators.corpus import SEED, TEST_RATIO, adjacent_pairs, route_split
from ..operators.indexing import Indexed
from ..operators.samples import epoch_batches, pretraining_samples
from ..operators.vocabulary import Vocabulary
from ..sources.documents import concat_sources, scan_documents, take_documents
from ..sources.evaluation import write_metrics, write_predictions
from ..sources.pair_corpus import index_pairs, training_text, write_pairs
from ..sources.squad import first_examples, read_qa_examples


def build_corpus(
    spark: SparkSession,
    out: str,
    wiki: tuple[str, str] | None = None,
    books: tuple[str, str] | None = None,
    max_articles: int = -1,
    max_books: int = -1,
    test_ratio: float = TEST_RATIO,
    seed: int = SEED,
) -> DataFrame:
    """Documents to the pair table at ``out``. A source is ``(path, id column)`` or ``None`` to skip it."""

    def source(name: str, at: tuple[str, str] | None, cap: int) -> DataFrame | None:
        return take_documents(scan_documents(spark, at[0], name, at[1]), cap) if at else None

    docs = concat_sources(source("wiki", wiki, max_articles), source("books", books, max_books))
    return write_pairs(route_split(adjacent_pairs(docs), test_ratio, seed), out)


def train_vocabulary(
    pairs: DataFrame, vocab_size: int = bpe.VOCAB_SIZE, min_frequency: int = bpe.MIN_FREQUENCY, lowercase: bool = True
) -> Vocabulary:
    """Vocabulary learnt from both sentences of the given pairs."""
    frequencies = bpe.piece_frequencies(training_text(pairs), lowercase=lowercase)
    return bpe.train(frequencies, vocab_size, min_frequency, lowercase).vocabulary


def training_batches(
    pairs: DataFrame, vocabulary: Vocabulary, seq_len: int, batch_size: int, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Shuffled full batches of the training split for one epoch.

    Places in the epoch are drawn for the bare indices, so samples are made once, and shuffled once to meet their place.
    """
    train = index_pairs(pairs.filter("split = 'train'"))
    places = epoch_batches(train.rows.select("idx"), train.total, batch_size, seed, epoch)
    return pretraining_samples(train, vocabulary, seq_len, seed, epoch).join(places, "idx")


def test_batches(pairs: DataFrame, vocabulary: Vocabulary, seq_len: int, batch_size: int, seed: int = 0) -> DataFrame:
    """Batches of the test split in corpus order, the last one possibly short."""
    test = index_pairs(pairs.filter("split = 'test'"))
    samples = pretraining_samples(test, vocabulary, seq_len, seed)
    return epoch_batches(samples, test.total, batch_size, shuffle=False, drop_last=False)


def finetuning_features(
    spark: SparkSession,
    path: str,
    vocabulary: Vocabulary,
    is_training: bool,
    max_examples: int = -1,
    articles_per_line: bool = False,
    seq_len: int = qa_features.SEQ_LEN,
    max_query_len: int = qa_features.MAX_QUERY_LEN,
) -> tuple[DataFrame, Indexed]:
    """Features of a question-answering file, and its examples; an error if none can be trained on."""
    examples = read_qa_examples(spark, path, articles_per_line)
    chosen = first_examples(examples.rows, max_examples)
    features = qa_features.qa_features(chosen, vocabulary, is_training, seq_len, max_query_len)
    if is_training and features.isEmpty():
        raise ValueError("no example has an answer that fits: there is nothing to train on")
    return features, examples


def evaluate(features: DataFrame, logits: DataFrame, examples: DataFrame, out: str) -> DataFrame:
    """Answers and their metrics, written below ``out``; returns the metrics row."""
    predicted = write_predictions(qa_eval.predict(features, logits, examples), out)
    return write_metrics(qa_eval.qa_metrics(predicted, examples), out)
