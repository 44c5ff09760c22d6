"""Sentence ends after abbreviations, learnt from the corpus itself.

A full stop behind an abbreviation ends no sentence, unless what follows is known to start sentences. Which words are
abbreviations, which start sentences and which pairs belong together is told by log-likelihood ratios over counts of words, as
in the published method for unsupervised sentence boundaries. One aggregation over the text counts words and pairs of words at
sentence ends; the rest works on these counts. Lists become part of an expression, so splitting needs no join, no Python and no
shuffle, and the same plan streams. A list too long for that stays a whole table, which full stops of the text are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import collapse
from ..session import written

# How likely a full stop follows an abbreviation, and from which score on a word is one, starts sentences, or
# belongs to the word behind it.
STOP_SHARE, ABBREVIATION, STARTER, COLLOCATION = 0.99, 0.3, 30.0, 7.88
# What a word may be wrapped in.
OPENING, CLOSING = "\"'([{", "\"')]},;:!?"
# Occurrences with a full stop from which a word can be an abbreviation, and the most entries of a list in an expression.
LEAST, MOST = 5, 20_000

#: A list of words: in an expression, or the column ``known`` of a table, each once.
Known = tuple[str, ...] | DataFrame


@dataclass(frozen=True)
class SentenceModel:
    """Words whose full stop ends no sentence, words that start one nevertheless, and pairs that never part."""

    abbreviations: Known = ()
    starters: Known = ()
    collocations: Known = ()

    @property
    def joins(self) -> bool:
        """Whether a list is a table, so that paragraphs are cut by :meth:`with_sentences` only."""
        return any(isinstance(k, DataFrame) for k in (self.abbreviations, self.starters, self.collocations))

    def sentence_array(self, paragraph: Column) -> Column:
        """Sentences of a paragraph, white space collapsed; an empty paragraph is one empty sentence."""
        if self.joins:
            raise ValueError("a list of this model is a table: with_sentences joins it")
        words, following = _followed(paragraph)
        joined = F.array_join(F.zip_with(words, following, lambda a, b: F.when(self._ends(a, b), F.concat(a, F.lit("\n"))).otherwise(a)), " ")
        return F.split(joined, "\n ?(?!$)")

    def with_sentences(self, rows: DataFrame, paragraph: str, name: str) -> DataFrame:
        """Puts ``name``, its sentences, in place of the column ``paragraph``.

        With a list that is a table, paragraphs are parted at doubtful full stops, numbered and written, so no stream. These full
        stops are joined with the lists, and those that end no sentence come back to their paragraph by its number.
        """
        others = [c for c in rows.columns if c != paragraph]
        if not self.joins:
            return rows.select(*others, self.sentence_array(F.col(paragraph)).alias(name))
        pieces = self._pieces(F.col(paragraph)).alias("pieces")
        numbered = written(rows.select(*others, F.monotonically_increasing_id().alias("row"), pieces), "numbered_pieces")
        # Written, so that few of them are known to be few, and the text is not shuffled.
        kept = written(self._kept(numbered), "kept_stops")
        return numbered.join(kept, "row", "left").select(*others, _sentences(F.col("pieces"), F.col("kept")).alias(name))

    def _pieces(self, paragraph: Column) -> Column:
        """A paragraph parted at doubtful full stops, with a line feed at each other end of a sentence."""
        words, following = _followed(paragraph)

        def marked(word: Column, behind: Column) -> Column:
            # A table of abbreviations is not asked here: every full stop is doubtful.
            known = F.lit(True) if isinstance(self.abbreviations, DataFrame) else _among(_type(word), self.abbreviations)
            end = F.when(word.endswith(".") & known, F.lit("\r")).otherwise(F.lit("\n"))
            return F.when(_stopped(word) & (behind != ""), F.concat(word, end)).otherwise(word)

        return F.split(F.array_join(F.zip_with(words, following, marked), " "), "\r ")

    def _kept(self, numbered: DataFrame) -> DataFrame:
        """``row, kept``: which of the doubtful full stops of a paragraph end no sentence."""

        def around(piece: Column, behind: Column) -> Column:
            following = F.replace(F.substring_index(behind, " ", 1), F.lit("\n"), F.lit(""))
            return F.struct(F.substring_index(piece, " ", -1).alias("a"), following.alias("b"))

        n = F.size("pieces") - 1
        stops = F.zip_with(F.slice("pieces", 1, n), F.slice("pieces", 2, n), around)
        # The outer form keeps the optimizer from looking at the pieces a second time in an inferred filter.
        each = numbered.where(n > 0).select("row", F.posexplode_outer(stops).alias("place", "p")).select("row", "place", "p.a", "p.b")
        met = each.select("row", "place", _type(F.col("a")).alias("word"), _type(F.col("b")).alias("following"), _capital(F.col("b")).alias("capital"))
        met = _marked(met, "abbreviated", F.col("word"), self.abbreviations).where("abbreviated")
        met = _marked(met, "starting", F.col("following"), self.starters)
        met = _marked(met, "together", F.concat_ws(" ", "word", "following"), self.collocations)
        return met.where("NOT (starting AND capital) OR together").groupBy("row").agg(F.collect_list("place").alias("kept"))

    def _ends(self, word: Column, following: Column) -> Column:
        """Whether a sentence ends behind a word."""
        bare, behind = _type(word), _type(following)
        stays = ~(_among(behind, self.starters) & _capital(following))
        stays = stays | _among(F.concat(bare, F.lit(" "), behind), self.collocations)
        abbreviated = word.endswith(".") & _among(bare, self.abbreviations) & stays
        return _stopped(word) & (following != "") & ~abbreviated


def _followed(paragraph: Column) -> tuple[Column, Column]:
    """Words of a paragraph, and the word behind each; behind the last one an empty one."""
    words = F.split(collapse(paragraph), " ")
    return words, F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit("")))


def _stopped(word: Column) -> Column:
    """Whether a word, which has no white space, has a mark at its end that can end a sentence."""
    return word.endswith(".") | word.endswith("!") | word.endswith("?")


def _sentences(pieces: Column, kept: Column) -> Column:
    """Sentences of pieces between doubtful full stops, of which those at the places ``kept`` end none."""

    def joined(ends: Column) -> Column:
        after = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
        return F.zip_with(after, ends, lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a + 1), " "))

    parts = F.when(kept.isNull(), pieces).otherwise(let(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), kept), joined))
    return F.split(F.array_join(parts, "\n "), "\n ?(?!$)")


def _marked(rows: DataFrame, name: str, word: Column, known: Known) -> DataFrame:
    """Adds ``name``: whether a word is in a list."""
    if not isinstance(known, DataFrame):
        return rows.withColumn(name, _among(word, known))
    return rows.join(known, word == F.col("known"), "left").withColumn(name, F.col("known").isNotNull()).drop("known")


def _among(word: Column, known: tuple[str, ...]) -> Column:
    """Whether a word is in a list; Spark looks it up in a hash set."""
    return word.isin(*known) if known else F.lit(False)


def _core(word: Column) -> Column:
    return F.ltrim(word, F.lit(OPENING))


def _capital(word: Column) -> Column:
    """Whether a word begins with a capital."""
    first = F.left(_core(word), F.lit(1))
    return F.lower(first) != first


def _type(word: Column) -> Column:
    """A word in lower case, without what wraps it and without a full stop at its end."""
    core = _core(word)
    bare = F.when(core.endswith("."), F.left(core, F.length(core) - 1)).otherwise(F.rtrim(core, F.lit(CLOSING)))
    return F.lower(bare)


def word_pairs(docs: DataFrame) -> DataFrame:
    """``word, stop, ends, following, times``: the words of a paragraph's lines, whether they have a full stop, whether a sentence
    could end behind them, the word that then follows (null at the end, and where no sentence could end), and how often this occurs.

    Words are counted as they are written, so that the text is read once and whatever is told of a word is told of each distinct
    one. The counts are written: everything that is learnt comes from them.
    """
    parts = docs.select(F.explode_outer(F.split("text", "\n\n")).alias("paragraph"))
    words = parts.select(F.split(collapse(F.col("paragraph")), " ").alias("a"))
    each = words.select(F.explode_outer(F.arrays_zip("a", F.slice("a", 2, F.size("a")).alias("b"))).alias("p")).select("p.a", "p.b")
    ends = _stopped(F.col("a")).alias("ends")
    counted = each.groupBy("a", ends, F.when(ends, F.col("b")).alias("b")).agg(F.count("*").alias("times"))
    counted = written(counted, "counted_words")
    told = counted.select(_type(F.col("a")).alias("word"), _core(F.col("a")).endswith(".").alias("stop"), "ends", _type(F.col("b")).alias("following"), "times")
    return told.where(F.lower("word") != F.upper("word"))


def word_counts(pairs: DataFrame) -> DataFrame:
    """``word, n, stops``: occurrences, and those with a full stop."""
    stops = F.sum(F.when(F.col("stop"), F.col("times")).otherwise(0))
    return pairs.groupBy("word").agg(F.sum("times").alias("n"), stops.alias("stops"))


def abbreviation_scores(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """``word, n, stops, score`` of words with ``least`` full stops or more: how much likelier an almost certain full stop is than
    the share it has among all words, less for long words and for each time the word goes without."""
    total = counts.agg(F.sum("n").alias("total"), F.sum("stops").alias("total_stops"))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    free = F.col("n") - F.col("stops")
    share = F.col("total_stops") / F.col("total")
    plain = F.col("stops") * F.log(share) + F.when(free > 0, free * F.log(1 - share)).otherwise(0.0)
    sure = F.col("stops") * F.log(F.lit(STOP_SHARE)) + free * F.log(F.lit(1 - STOP_SHARE))
    score = -2 * (plain - sure) * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -free)
    chosen = counts.where((F.col("stops") >= least) & (letters > 0))
    return chosen.crossJoin(F.broadcast(total)).select("word", "n", "stops", score.alias("score"))


def _likelihood(together: Column, first: Column, second: Column, total: Column) -> Column:
    """Ratio of how likely it is that two words meet so often, if they depend on each other and if they don't."""

    def of(k: Column, n: Column, p: Column) -> Column:
        some = F.when(k > 0, k * F.log(p)).otherwise(0.0)
        return some + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    rest, others = second - together, total - first
    p, p1, p2 = second / total, together / first, rest / others
    return -2 * (of(together, first, p) + of(rest, others, p) - of(together, first, p1) - of(rest, others, p2))


def starter_scores(pairs: DataFrame, counts: DataFrame, abbreviations: Known) -> DataFrame:
    """``word, n, starts, score`` of words that follow a sure sentence end more often than others."""
    ends = _marked(pairs.where(F.col("ends") & F.col("following").isNotNull()), "abbreviated", F.col("word"), abbreviations)
    sure = ends.where(~(F.col("stop") & F.col("abbreviated")))
    starts = sure.groupBy(F.col("following").alias("word")).agg(F.sum("times").alias("starts"))
    sums = counts.agg(F.sum("n").alias("total")).crossJoin(starts.agg(F.sum("starts").alias("ends")))
    known = starts.join(counts, "word").crossJoin(F.broadcast(sums)).where("starts * total > n * ends and ends < total and starts <= n")
    return known.select("word", "n", "starts", _likelihood(*(F.col(c) for c in ("starts", "ends", "n", "total"))).alias("score"))


def collocation_scores(pairs: DataFrame, counts: DataFrame, abbreviations: Known) -> DataFrame:
    """``word, following, together, score`` of abbreviations and words that follow them more often than others."""
    stops = _marked(pairs.where(F.col("stop") & F.col("following").isNotNull()), "abbreviated", F.col("word"), abbreviations)
    met = stops.where("abbreviated").groupBy("word", "following").agg(F.sum("times").alias("together")).where("together > 1")
    total = counts.agg(F.sum("n").alias("total"))
    second = counts.select(F.col("word").alias("following"), F.col("n").alias("n_following"))
    known = met.join(counts, "word").join(second, "following").crossJoin(F.broadcast(total))
    known = known.where("together * total > stops * n_following and stops < total")
    return known.select("word", "following", "together", _likelihood(*(F.col(c) for c in ("together", "stops", "n_following", "total"))).alias("score"))


def _best(scores: DataFrame, least: float, most: int, *key: str) -> Known:
    """All words or pairs with a score of ``least`` or more; more than ``most`` stay a table."""
    known = written(scores.where(F.col("score") >= least).select(F.concat_ws(" ", *key).alias("known")), "known_words")
    rows = known.limit(most + 1).collect()
    return known if len(rows) > most else tuple(sorted(r["known"] for r in rows))


def learn_sentence_model(docs: DataFrame, least: int = LEAST, most: int = MOST) -> SentenceModel:
    """Abbreviations, sentence starters and collocations of all texts of ``docs``; a list of more than ``most`` is a table."""
    return learn_from_pairs(word_pairs(docs), least, most)


def learn_from_pairs(pairs: DataFrame, least: int = LEAST, most: int = MOST) -> SentenceModel:
    """:func:`learn_sentence_model` from the counts of :func:`word_pairs`."""
    counts = written(word_counts(pairs), "word_counts")
    abbreviations = _best(abbreviation_scores(counts, least), ABBREVIATION, most, "word")
    starters = _best(starter_scores(pairs, counts, abbreviations), STARTER, most, "word")
    if abbreviations == ():
        return SentenceModel((), starters)
    together = collocation_scores(pairs, counts, abbreviations)
    return SentenceModel(abbreviations, starters, _best(together, COLLOCATION, most, "word", "following"))
