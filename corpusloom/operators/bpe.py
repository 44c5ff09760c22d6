"""Training a byte-level sub-word vocabulary on a distributed word table.

Every symbol is one private character, so a word is a string of symbols and a merge is a text replacement of two characters
by one. The word table has one row per distinct piece of the corpus and never leaves the executors: the driver sees the most
frequent pairs, and words cut down to what these pairs can merge and added up, both of bounded size.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.heavy_hitters import summaries
from ..functions.merging import FIRST_SYMBOL, merging_function, segments_function
from ..functions.text import byte_ids, pieces
from ..session import written
from .vocabulary import Vocabulary, seed_tokens

# Symbols live in the supplementary planes: none of them is a surrogate, and all take four bytes.
_BASE = FIRST_SYMBOL
# Size of the vocabulary and least count of a merge, unless the caller says otherwise.
VOCAB_SIZE = 30_000
MIN_FREQUENCY = 2
# Active pairs of the first round, and the most of any round. A matter of effort, like the next value: no result depends on it.
FIRST_ACTIVE, CANDIDATES = 32, 4_000
# Symbols of the cut and added-up words of a round, which the driver holds.
SEGMENT_SYMBOLS = 400_000
# Rounds between two written states of the word table; the states in between are cached and can be derived again.
ROUNDS_PER_TABLE = 8

_LATIN1 = "".join(chr(b) for b in range(256))


def symbol(i: int) -> str:
    return chr(_BASE + i)


def word_ids(word: Column) -> Column:
    """Vocabulary ids of a word's symbols."""
    return F.transform(F.split(word, ""), lambda c: (F.ascii(c) - _BASE).cast("int"))


def piece_frequencies(text: DataFrame, column: str = "text", lowercase: bool = True) -> DataFrame:
    """``piece, freq`` over all texts; counted per task before the shuffle, so a hot piece is one row per task."""
    split = text.select(F.explode_outer(pieces(F.col(column), lowercase)).alias("piece"))
    return split.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.count("*").alias("freq"))


def frequent_pieces(text: DataFrame, one_in: int = 10_000, column: str = "text", lowercase: bool = True) -> DataFrame:
    """``piece, freq`` of the pieces that are at least one in so many of all, with exact counts.

    Every task keeps ``2 * one_in`` counters, whatever it reads; their sums bound each count from both sides, so no frequent
    piece is missed and at most ``2 * one_in`` rare ones are counted with them. A second pass counts these alone: the long
    tail of rare pieces is never shuffled.
    """
    split = text.select(pieces(F.col(column), lowercase).alias("p"))
    told = written(split.mapInArrow(summaries(2 * one_in), "kind string, value string, n bigint"), "summaries")
    sums = {r["kind"]: r["n"] for r in told.where("kind <> 'value'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    total, lost = sums.get("total", 0), sums.get("lost", 0)
    merged = told.where("kind = 'value'").groupBy(F.col("value").alias("piece")).agg(F.sum("n").alias("least"))
    candidates = merged.where((F.col("least") + lost) * one_in >= total).select("piece")
    counted = split.select(F.explode_outer("p").alias("piece")).join(F.broadcast(candidates), "piece")
    return counted.groupBy("piece").agg(F.count("*").alias("freq")).where(F.col("freq") * one_in >= total)


def symbol_words(frequencies: DataFrame) -> DataFrame:
    """``word, freq``: each piece as one symbol per byte."""
    to_symbols = "".join(symbol(i) for i in byte_ids())
    one_per_byte = F.decode(F.encode(F.col("piece"), "UTF-8"), "ISO-8859-1")
    return frequencies.select(F.translate(one_per_byte, _LATIN1, to_symbols).alias("word"), "freq")


def _pairs(word: Column) -> Column:
    def neighbours(t: Column) -> Column:
        return F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, b))

    return let(F.split(word, ""), neighbours)


def pair_counts(words: DataFrame) -> DataFrame:
    """``pair, n``: neighbouring symbols, weighted by the frequency of their word."""
    seen = words.select(F.explode_outer(_pairs(F.col("word"))).alias("pair"), "freq")
    return seen.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("freq").alias("n"))


def pair_ids(pairs: DataFrame) -> DataFrame:
    """``left, right, n`` with vocabulary ids."""
    code = [(F.ascii(F.substring("pair", i, 1)) - _BASE).cast("int") for i in (1, 2)]
    return pairs.select(code[0].alias("left"), code[1].alias("right"), "n")


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` next merge candidates: highest count first, lowest ids first among equals.

    Symbols order like their ids, because their UTF-8 bytes do.
    """
    return pairs.orderBy(F.desc("n"), "pair").limit(k)


def _states(merges: list[tuple[int, int, int]]) -> list[str]:
    """Columns ``w0, w1, ...``: the word before and after each of the merges, applied from left to right."""
    replaced = [
        f"replace(w{i}, '{symbol(a) + symbol(b)}', '{symbol(c)}') as w{i + 1}" for i, (a, b, c) in enumerate(merges)
    ]
    return ["word as w0", *replaced]


def merge_words(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Words with the merges applied one after the other."""
    return words.selectExpr("freq", *_states(merges)).selectExpr(f"w{len(merges)} as word", "freq")


@dataclass
class Training:
    """A trained vocabulary, the number of rounds it took, and how often a round was tried with fewer pairs."""

    vocabulary: Vocabulary
    rounds: int
    retries: int


@dataclass
class _Segments:
    """What is left of all words when they are cut between symbols that are no active pair: with exact counts of these."""

    words: list[list[int]]
    freq: list[int]
    counts: Counter = field(default_factory=Counter)
    places: dict[tuple[int, int], set[int]] = field(default_factory=lambda: defaultdict(set))
    queue: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        for k, word in enumerate(self.words):
            for pair in zip(word, word[1:]):
                self.counts[pair] += self.freq[k]
                self.places[pair].add(k)
        self.queue = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.queue)

    def best(self) -> tuple[int, int, int] | None:
        """The next pair as negative count and ids."""
        while self.queue:
            negative, *pair = self.queue[0]
            n = self.counts.get(tuple(pair), 0)
            if n == -negative and n > 0:
                return self.queue[0]
            heapq.heappop(self.queue)
        return None

    def merge(self, left: int, right: int, made: int) -> None:
        changed: Counter = Counter()
        for k in self.places.pop((left, right)):
            word, n = self.words[k], self.freq[k]
            new: list[int] = []
            at = 0
            while at < len(word):
                if at + 1 < len(word) and word[at] == left and word[at + 1] == right:
                    new.append(made)
                    at += 2
                else:
                    new.append(word[at])
                    at += 1
            for pair in zip(word, word[1:]):
                changed[pair] -= n
            for pair in zip(new, new[1:]):
                changed[pair] += n
                self.places[pair].add(k)
            self.words[k] = new
        for pair, n in changed.items():
            if n:
                self.counts[pair] += n
                heapq.heappush(self.queue, (-self.counts[pair], *pair))
        del self.counts[left, right]


def segments(words: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``segment, freq``: runs of two symbols or more whose neighbours are all among ``pairs``, added up over all words."""
    return words.mapInArrow(segments_function(pairs), "segment string, freq bigint").groupBy("segment").agg(F.sum("freq").alias("freq"))


def _next_merges(
    found: _Segments, last: tuple[int, int, int] | None, tokens: list[str], ids: dict[str, int], vocab_size: int, floor: int
) -> tuple[list[tuple[int, int, int]], bool]:
    """Merges that are certain to come next, in order, taken over in ``tokens`` and ``ids``; and whether none is left.

    ``last`` is the last active pair in merge order. A pair that stands at a cut comes after it, and merging only makes it
    rarer or its ids larger, so as long as the best pair of the segments doesn't come after ``last`` it is the best of all.
    A merge that spells a token which is there already adds to pairs beyond the cuts, so the round ends behind it.
    """
    merges: list[tuple[int, int, int]] = []
    while len(tokens) < vocab_size:
        best = found.best()
        if best is None or -best[0] < floor:
            return merges, last is None
        if last is not None and best > last:
            break
        _, left, right = best
        token = tokens[left] + tokens[right]
        again = token in ids
        if not again:
            ids[token] = len(tokens)
            tokens.append(token)
        merges.append((left, right, ids[token]))
        if again:
            break
        found.merge(left, right, ids[token])
    return merges, False


def train(
    frequencies: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    lowercase: bool = True,
    candidates: int = CANDIDATES,
    most_symbols: int = SEGMENT_SYMBOLS,
) -> Training:
    """Merge the most frequent pair until the vocabulary is full or no pair is frequent enough.

    A round counts all pairs and makes the ``candidates`` most frequent ones active. Between symbols that are no active pair
    nothing can be merged before all active pairs are, so words are cut there; what is left, added up over all words, is a
    small table, on which the driver finds hundreds of merges in their exact order. Should the table have more than
    ``most_symbols`` symbols, the round takes a quarter of the pairs. Then all words take over the merges of the round.
    """
    tokens = seed_tokens()
    ids = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int, int]] = []
    floor = max(1, min_frequency)
    words = written(symbol_words(frequencies), "words").filter(F.length("word") > 1).persist()
    kept = [words]
    rounds = retries = 0
    active = min(FIRST_ACTIVE, candidates)
    done = False
    while not done and len(tokens) < vocab_size:
        rounds += 1
        frequent = pair_counts(words).filter(F.col("n") >= floor)
        top = [(-r["n"], r["left"], r["right"]) for r in pair_ids(top_pairs(frequent, active)).collect()]
        if not top:
            break
        whole = len(top) < active
        while True:
            cut = segments(words, [(left, right) for _, left, right in top]).persist()
            size = cut.agg(F.sum(F.length("segment"))).first()[0] or 0
            if size <= most_symbols or len(top) == 1:
                break
            cut.unpersist()
            retries += 1
            top, whole = top[: max(1, len(top) // 4)], False
        rows = cut.select(word_ids(F.col("segment")).alias("ids"), "freq").collect()
        cut.unpersist()
        found = _Segments([list(r["ids"]) for r in rows], [r["freq"] for r in rows])
        batch, done = _next_merges(found, None if whole else top[-1], tokens, ids, vocab_size, floor)
        merges.extend(batch)
        active = min(candidates, 2 * active if 2 * size < most_symbols else max(1, len(top)))
        if done or len(tokens) >= vocab_size:
            break
        words = words.mapInArrow(merging_function(tuple(batch)), "word string, freq bigint").filter(F.length("word") > 1)
        if rounds % ROUNDS_PER_TABLE == 0:
            words = written(words, "words").persist()
            obsolete, kept = kept, [words]
        else:
            words.persist()
            obsolete, kept = kept[:-1], [kept[-1], words]
        for old in obsolete:
            old.unpersist()
    for old in kept:
        old.unpersist()
    return Training(Vocabulary(tuple(tokens), tuple(merges), lowercase), rounds, retries)
