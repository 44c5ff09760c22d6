"""Question-answering features of a fixed length.

Every step works inside the row of its example, so examples are read, encoded, cut and labelled without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EOS, PAD, SOS
from .encoding import encode, encode_example
from .vocabulary import Vocabulary

# Feature length and longest question, in tokens.
SEQ_LEN = 384
MAX_QUERY_LEN = 64

OVERFLOW = "overflow"
NO_ANSWER = "no_answer"


def encode_examples(examples: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``q_ids``, ``c_ids`` and ``c_offsets``."""
    encoded = examples.withColumn("_e", encode_example(F.col("question"), F.col("context"), vocabulary))
    columns = {"q_ids": F.col("_e.question"), "c_ids": F.col("_e.ids"), "c_offsets": F.col("_e.offsets")}
    return encoded.withColumns(columns).drop("_e")


def encode_questions(examples: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``q_ids`` only, for what does not look at contexts."""
    return examples.withColumn("q_ids", encode(F.col("question"), vocabulary))


def fit_question(encoded: DataFrame, seq_len: int = SEQ_LEN, max_query_len: int = MAX_QUERY_LEN) -> DataFrame:
    """Cuts the question; ``budget`` is the room left for the context, possibly none."""
    cut = encoded.withColumn("q_ids", F.slice("q_ids", 1, max_query_len))
    return cut.withColumn("budget", F.lit(seq_len - 3) - F.size("q_ids"))


def fit_to_length(encoded: DataFrame, seq_len: int = SEQ_LEN, max_query_len: int = MAX_QUERY_LEN) -> DataFrame:
    """Cuts the question, then the context to what is left; ``budget`` is the room for the context, possibly none."""
    kept = F.greatest(F.col("budget"), F.lit(0))
    return fit_question(encoded, seq_len, max_query_len).withColumns(
        {"c_ids": F.slice("c_ids", 1, kept), "c_offsets": F.slice("c_offsets", 1, kept)}
    )


def assemble_features(fitted: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds ``input_ids``, ``segment_ids`` and ``context_start``."""
    n_q, n_c = F.size("q_ids"), F.size("c_ids")
    room = F.lit(seq_len - 3) - n_q - n_c
    start, end = F.array(F.lit(SOS)), F.array(F.lit(EOS))
    ids = F.concat(start, "q_ids", end, "c_ids", end, F.array_repeat(F.lit(PAD), room))
    segments = F.concat(
        F.array_repeat(F.lit(1), n_q + 2), F.array_repeat(F.lit(2), n_c + 1), F.array_repeat(F.lit(PAD), room)
    )
    return fitted.withColumns({"input_ids": ids, "segment_ids": segments, "context_start": n_q + 2})


def _first_position(offsets: Column, holds) -> Column:
    """0-based position of the first span for which ``holds``, null if there is none."""
    at = F.array_position(F.transform(offsets, holds), True)
    return F.when(at > 0, (at - 1).cast("int"))


def answer_span(fitted: DataFrame) -> DataFrame:
    """Adds ``tok_start`` and ``tok_end`` of the first answer within the kept context, null where they are not found."""
    first = F.col("answer_start")
    end = first + F.length(F.get("answers", F.lit(0)))
    return fitted.withColumns(
        {
            "tok_start": _first_position(F.col("c_offsets"), lambda o: (o["s"] <= first) & (first < o["e"])),
            "tok_end": _first_position(F.col("c_offsets"), lambda o: (o["s"] < end) & (end <= o["e"])),
        }
    )


def drop_reason(is_training: bool) -> Column:
    """Why an example gives no feature, null if it does. A question that leaves no room comes before anything else."""
    no_room = F.col("budget") <= 0
    if not is_training:
        return F.when(no_room, OVERFLOW)
    unanswered = (F.size("answers") <= 0) | F.col("answer_start").isNull()
    lost = F.col("tok_start").isNull() | F.col("tok_end").isNull() | (F.col("tok_end") < F.col("tok_start"))
    return F.when(no_room, OVERFLOW).when(unanswered, NO_ANSWER).when(lost, OVERFLOW)


def judged_features(
    encoded: DataFrame, is_training: bool, seq_len: int = SEQ_LEN, max_query_len: int = MAX_QUERY_LEN
) -> DataFrame:
    """Fitted examples with their ``drop_reason``."""
    fitted = fit_to_length(encoded, seq_len, max_query_len)
    if is_training:
        fitted = answer_span(fitted)
    return fitted.withColumn("drop_reason", drop_reason(is_training))


def drop_counts(judged: DataFrame) -> DataFrame:
    """Examples per outcome; the outcome of a kept one is ``kept``."""
    outcome = F.coalesce("drop_reason", F.lit("kept"))
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def train_features(judged: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Training features with the token positions of the answer; offsets are not kept."""
    kept = assemble_features(judged.filter(F.col("drop_reason").isNull()), seq_len)
    return kept.select(
        F.col("ex_idx").alias("example_index"),
        "input_ids",
        "segment_ids",
        (F.col("context_start") + F.col("tok_start")).alias("start_position"),
        (F.col("context_start") + F.col("tok_end")).alias("end_position"),
        "context_start",
    )


def eval_features(judged: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Evaluation features with the raw-text span of each context token. Each example has one window, so the example's
    number also identifies the feature and keeps its order."""
    kept = assemble_features(judged.filter(F.col("drop_reason").isNull()), seq_len)
    return kept.select(
        F.col("ex_idx").alias("feature_index"),
        F.col("ex_idx").alias("example_index"),
        "input_ids",
        "segment_ids",
        "context_start",
        F.col("c_offsets").alias("context_token_offsets"),
    )


def eval_feature_indexes(
    examples: DataFrame, vocabulary: Vocabulary, seq_len: int = SEQ_LEN, max_query_len: int = MAX_QUERY_LEN
) -> DataFrame:
    """``feature_index`` of :func:`eval_features`, for which no context is encoded: only the question's length decides."""
    fitted = fit_question(encode_questions(examples, vocabulary), seq_len, max_query_len)
    return fitted.filter(drop_reason(False).isNull()).select(F.col("ex_idx").alias("feature_index"))


def qa_features(
    examples: DataFrame,
    vocabulary: Vocabulary,
    is_training: bool,
    seq_len: int = SEQ_LEN,
    max_query_len: int = MAX_QUERY_LEN,
) -> DataFrame:
    """Examples to features."""
    judged = judged_features(encode_examples(examples, vocabulary), is_training, seq_len, max_query_len)
    return train_features(judged, seq_len) if is_training else eval_features(judged, seq_len)
