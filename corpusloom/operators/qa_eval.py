"""From start and end scores to answers, and from answers to exact match and F1.

The search over start and end tokens looks at no more than 20 x 20 spans per feature and stays inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import answer_tokens, normalize_answer, strip

# Candidates per side, longest answer in tokens, and the score a span has to beat.
TOP_K = 20
MAX_ANSWER_TOKENS = 30
LEAST_SCORE = -1e30


def context_scores(features: DataFrame, logits: DataFrame) -> DataFrame:
    """Features with ``start_scores`` and ``end_scores`` of their context tokens."""
    joined = features.join(logits, "feature_index")
    n = F.size("context_token_offsets")
    region = {
        name: F.slice(column, F.col("context_start") + 1, n)
        for name, column in (("start_scores", "start_logits"), ("end_scores", "end_logits"))
    }
    return joined.withColumns(region).drop("start_logits", "end_logits")


def top_candidates(scores: Column, k: int = TOP_K) -> Column:
    """``array<struct(neg, at)>``: the ``k`` highest scores, the earlier of equal ones first. Scores are negated so that the
    natural order of the struct is the order of the candidates."""
    return F.slice(
        F.array_sort(F.transform(scores, lambda v, i: F.struct((-v.cast("double")).alias("neg"), i.alias("at")))), 1, k
    )


def best_span(starts: Column, ends: Column, max_answer_tokens: int = MAX_ANSWER_TOKENS) -> Column:
    """``struct(neg, s_rank, e_rank, s, e)`` of the legal span with the highest sum, null if none is legal.

    Among equal sums the one with the better ranked start, then end, wins.
    """
    ranked = F.transform(
        ends, lambda e, r: F.struct(e["neg"].alias("neg"), e["at"].alias("at"), r.alias("rank"))
    )

    def spans(both: Column) -> Column:
        def from_start(s: Column, s_rank: Column) -> Column:
            legal = F.filter(
                both["ends"],
                lambda e: (e["at"] >= s["at"])
                & (e["at"] - s["at"] + 1 <= max_answer_tokens)
                & (-(s["neg"] + e["neg"]) > LEAST_SCORE),
            )
            return F.array_min(
                F.transform(
                    legal,
                    lambda e: F.struct(
                        (s["neg"] + e["neg"]).alias("neg"),
                        s_rank.alias("s_rank"),
                        e["rank"].alias("e_rank"),
                        s["at"].alias("s"),
                        e["at"].alias("e"),
                    ),
                )
            )

        return F.array_min(F.transform(both["starts"], from_start))

    return let(F.struct(starts.alias("starts"), ranked.alias("ends")), spans)


def decode_spans(scored: DataFrame, max_answer_tokens: int = MAX_ANSWER_TOKENS, k: int = TOP_K) -> DataFrame:
    """Adds ``span`` to features with scores."""
    starts = top_candidates(F.col("start_scores"), k)
    ends = top_candidates(F.col("end_scores"), k)
    return scored.withColumn("span", best_span(starts, ends, max_answer_tokens))


def span_characters(decoded: DataFrame) -> DataFrame:
    """``feature_index, example_index, first, last``: the raw-text characters of the span, null without a legal span."""
    return decoded.select(
        "feature_index",
        "example_index",
        F.get("context_token_offsets", F.col("span.s"))["s"].alias("first"),
        F.get("context_token_offsets", F.col("span.e"))["e"].alias("last"),
    )


def span_text(characters: DataFrame, examples: DataFrame) -> DataFrame:
    """``feature_index, qid, text``: the stripped text of the span, empty without a legal span. Only four numbers per feature
    travel to the examples."""
    asked = examples.select(F.col("ex_idx").alias("example_index"), "qid", "context")
    length = F.greatest(F.col("last") - F.col("first"), F.lit(0))
    text = strip(F.substr("context", F.col("first") + 1, length))
    return characters.join(asked, "example_index").select(
        "feature_index", "qid", F.coalesce(text, F.lit("")).alias("text")
    )


def predictions(texts: DataFrame) -> DataFrame:
    """``qid, text``: the last feature of a question wins."""
    return texts.groupBy("qid").agg(F.max_by("text", "feature_index").alias("text"))


def predict(
    features: DataFrame, logits: DataFrame, examples: DataFrame, max_answer_tokens: int = MAX_ANSWER_TOKENS
) -> DataFrame:
    """Answers per question from evaluation features, logits and examples."""
    decoded = decode_spans(context_scores(features, logits), max_answer_tokens)
    return predictions(span_text(span_characters(decoded), examples))


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 where the normalised answers are equal, else 0.0."""
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def _f1_of_tokens(p: Column, g: Column) -> Column:
    def occurrences(tokens: Column, t: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == t))

    common = F.aggregate(
        F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(occurrences(p, t), occurrences(g, t))
    )
    empty = (F.size(p) == 0) | (F.size(g) == 0)

    def score(same: Column) -> Column:
        precision, recall = same / F.size(p), same / F.size(g)
        return F.when(same == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).otherwise(let(common, score))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the normalised answers' words, repeated words counted as often as both have them."""
    return let(
        F.struct(
            answer_tokens(normalize_answer(prediction)).alias("p"), answer_tokens(normalize_answer(gold)).alias("g")
        ),
        lambda t: _f1_of_tokens(t["p"], t["g"]),
    )


def question_scores(predicted: DataFrame, examples: DataFrame) -> DataFrame:
    """Best exact match and F1 over the gold answers of each predicted question."""
    golds = F.when(F.size("answers") > 0, F.col("answers")).otherwise(F.array(F.lit("")))
    joined = examples.select("qid", golds.alias("golds")).join(predicted.select("qid", "text"), "qid")
    return joined.select(
        "qid",
        F.array_max(F.transform("golds", lambda g: exact_match(F.col("text"), g))).alias("em"),
        F.array_max(F.transform("golds", lambda g: token_f1(F.col("text"), g))).alias("f1"),
    )


def qa_metrics(predicted: DataFrame, examples: DataFrame) -> DataFrame:
    """One row: ``exact_match`` and ``f1`` in percent and the number of predicted questions; zeros when there is none."""
    scores = question_scores(predicted, examples)
    return scores.agg(
        F.coalesce(F.avg("em") * 100, F.lit(0.0)).alias("exact_match"),
        F.coalesce(F.avg("f1") * 100, F.lit(0.0)).alias("f1"),
        F.count("*").alias("count"),
    )
