"""Documents to adjacent sentence pairs.

A pair never leaves its document, so paragraphs, sentences and pairs are built inside the row: no shuffle from the scan to
the pairs, no key that could be skewed, and the same plan runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import below, digest
from ..functions.text import collapse, strip
from .sentence_model import SentenceModel

# Shortest sentence that is kept, in characters and in words.
MIN_SENTENCE_CHARS = 16
MIN_SENTENCE_WORDS = 4
# Share of pairs held out for testing, and the seed of the draw.
TEST_RATIO = 0.005
SEED = 42

# A space after a full stop, exclamation or question mark ends a sentence. Applied after white space is collapsed; looking
# for the space first is what makes the search fast.
SENTENCE_BREAK = " (?<=[.!?] )"

PAIR_KEY = ("source", "doc_id", "para", "pos")


def _parts(docs: DataFrame) -> DataFrame:
    return docs.select("source", "doc_id", F.posexplode_outer(F.split("text", "\n\n")).alias("para", "paragraph"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per non-empty paragraph; ``para`` is its place among the blank-line separated parts."""
    stripped = _parts(docs).withColumn("paragraph", strip(F.col("paragraph")))
    return stripped.filter(F.col("paragraph") != "")


def sentence_array(paragraph: Column, pattern: str | SentenceModel = SENTENCE_BREAK) -> Column:
    """Sentences of a paragraph, white space collapsed; an empty paragraph is one empty sentence. They end where a pattern
    matches, or where a learnt model says."""
    if isinstance(pattern, SentenceModel):
        return pattern.sentence_array(paragraph)
    return F.split(collapse(paragraph), pattern)


def _cut(docs: DataFrame, pattern: str | SentenceModel) -> tuple[DataFrame, Column]:
    """Paragraphs of documents, and the column of their sentences; a model may have to join for it."""
    if isinstance(pattern, SentenceModel) and pattern.joins:
        return pattern.with_sentences(_parts(docs), "paragraph", "sentences"), F.col("sentences")
    return _parts(docs), sentence_array(F.col("paragraph"), pattern)


def long_enough(sentence: Column) -> Column:
    """Whether a collapsed sentence has enough characters and words."""
    spaces = F.length(sentence) - F.length(F.replace(sentence, F.lit(" "), F.lit("")))
    return (F.length(sentence) >= MIN_SENTENCE_CHARS) & (spaces >= MIN_SENTENCE_WORDS - 1)


def sentences(docs: DataFrame, pattern: str | SentenceModel = SENTENCE_BREAK, filtered: bool = True) -> DataFrame:
    """One row per sentence; ``pos`` counts the rows of its paragraph."""
    parts, cut = _cut(docs, pattern)
    found = F.filter(cut, long_enough if filtered else lambda s: s != "")
    rows = parts.select("source", "doc_id", "para", F.posexplode_outer(found).alias("pos", "sent"))
    return rows.filter(F.col("sent").isNotNull())


def adjacent_pairs(docs: DataFrame, pattern: str | SentenceModel = SENTENCE_BREAK) -> DataFrame:
    """Neighbouring kept sentences of a paragraph. A dropped sentence does not separate its neighbours."""
    parts, cut = _cut(docs, pattern)
    kept = parts.select("source", "doc_id", "para", F.filter(cut, long_enough).alias("kept"))
    n = F.greatest(F.size("kept") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("kept", 1, n).alias("s1"), F.slice("kept", 2, n).alias("s2"))
    # The outer form keeps the optimizer from evaluating the sentences a second time in an inferred filter.
    rows = kept.select("source", "doc_id", "para", F.posexplode_outer(pairs).alias("pos", "pair"))
    return rows.filter(F.col("pair").isNotNull()).select(*PAIR_KEY, "pair.s1", "pair.s2")


def route_split(pairs: DataFrame, test_ratio: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """Adds ``split``: a keyed draw sends each pair to ``test`` or ``train``."""
    draw = digest("split", seed, *[F.col(k) for k in PAIR_KEY])
    return pairs.withColumn("split", F.when(below(draw, test_ratio), "test").otherwise("train"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per source and split, per source, and in total (null marks the summed-over column). Rows are counted once;
    only the few counts are rolled up."""
    counts = pairs.groupBy("source", "split").agg(F.count("*").alias("n"))
    return counts.rollup("source", "split").agg(F.sum("n").alias("n_pairs"))
