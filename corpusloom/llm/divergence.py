"""Audit of how far the sources of a language differ in their words, by exact products of one-hot levels.

Every source of a language counts every kept term of it; how often is the term's *level* in that source. For a block of terms
the indicator columns (source, level), one row per term, are multiplied by their transpose: an entry of the product says how
many terms have level c in one source and d in the other. These joint tables are then priced: a pair of levels has a price
that is known without looking at a term. Entries are whole numbers below the size of a block, so products in single precision
are exact, and sums over blocks are whole numbers.

Blocks hold about ``BLOCK_TERMS`` terms, dealt by a hash, and the sources of a language are dealt to groups of about
``GROUP_SOURCES``, so that a tile (a block of terms, two groups of sources) is of bounded size whatever a language or a source
holds. A term that no source of a tile has is at level 0 in all of them; such terms are counted, not listed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import lookup, map_batches

#: Terms of a block and sources of a group, about: a tile has at most twice as many sources.
BLOCK_TERMS, GROUP_SOURCES = 512, 48
#: Columns of a matrix that is multiplied at once, unless one source alone has more levels.
_COLUMNS = 2048
#: Counts that a task holds before it passes them on, and bytes of a text that are cut into terms at once.
_HELD, _SLICE = 300_000, 1 << 20

_COUNTED = "lang string, source string, term string, n bigint, docs bigint"
_PRICED = "lang string, source string, part string, item string, value bigint"

#: Bytes as they count in terms: A-Z as a-z, other letters and all bytes beyond ASCII as they are, the rest as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size: runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        if end < len(text):  # not inside a term
            separator = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, end)
            end = separator.end() if separator else len(text)
        yield text[at:end].translate(_FOLD).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source and term occurrences and documents, added up per task; a source without terms has a row without a term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for first in range(0, max(1, len(terms)), 50_000):
                some = terms[first : first + 50_000]
                names = pa.array([*some, *([None] if first == 0 else [])], pa.binary()).cast(pa.string())
                values = [[*(c[t] for t in some), *([0] if first == 0 else [])] for c in (n, docs)]
                columns = [pa.array([lang] * len(names)), pa.array([source] * len(names)), names, *(pa.array(v, pa.int64()) for v in values)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(text.as_buffer().to_pybytes() if text.is_valid else b""):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > _HELD:
            yield from told()
    yield from told()


def term_counts(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """``lang, source, term, n, lang_n, leads`` of all kept terms, and for each source a row without a term.

    ``n`` counts a term in the source, ``lang_n`` in the language, which keeps it if it is in ``min_docs`` of its rows at least;
    ``leads`` marks one row of each term of a language. Null text, language and source are empty text. One shuffle: counts
    are dealt by language and term, so that a source that holds most of the rows is spread over all tasks.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = map_batches(docs.select(*columns), _count, _COUNTED)
    deal = F.xxhash64("lang", F.coalesce("term", "source"))
    sums = counted.withColumn("deal", deal).repartition("deal").groupBy("deal", "lang", "term", "source")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("deal", "lang", "term")
    told = sums.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(same).alias("docs"), F.sum("n").over(same).alias("lang_n"),
        (F.row_number().over(same.orderBy("source")) == 1).alias("leads"),
    )
    return told.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs")


def share(n: str, total: str, terms: str) -> Column:
    """Smoothed share of a count in billionths, rounded down, plus one; exact at any size, null without any term."""
    whole = "decimal(20,0)"
    return F.expr(f"1 + ((cast({n} as {whole}) + 5) * 1000000000) div nullif(cast({total} as {whole}) + 5 * cast({terms} as {whole}), 0)")


def _sources(counts: DataFrame) -> DataFrame:
    """Of each source its total and its number of terms, beside total, terms and sources of its language and how they are dealt."""
    told = F.col("term").isNotNull()
    sums = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count_if(told).alias("rows"), F.count_if(told & F.col("leads")).alias("leading")
    )
    sums = written(sums, "sources")
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leading").alias("terms"), F.count("*").alias("members"))
    known = lookup(sums.drop("leading"), langs, ["lang"], "members", sums.count())
    blocks, groups = (F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int") for c, size in (("terms", BLOCK_TERMS), ("members", GROUP_SOURCES)))
    dealt = {"blocks": blocks, "groups": groups, "side": F.pmod(F.xxhash64("source"), groups).cast("int")}
    return known.withColumns(dealt).drop("members")


def _tiles(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of every tile: the sources it has, without a term and at level 0, and their levels of its terms."""
    heads = sources.select(
        "*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("lang_n"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    levels = lookup(counts.where("term is not null").drop("leads"), sources, ["lang", "source"], "rows", counts.count())
    levels = levels.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    rows = levels.unionByName(heads).drop("rows")
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    price = {"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}
    return other.withColumns(price).select(
        "lang", "block", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "source", "term", "n", "lang_n", "p", "q", "terms",
    )


class _Levels:
    """Indicator columns of some sources: one column per source and level, level 0 first, and the price of each column."""

    def __init__(self, n_terms: int):
        self.n_terms, self.hot, self.price, self.first, self.names = n_terms, [], [], [], []
        self.columns = 0

    def add(self, name: int, term: np.ndarray, level: np.ndarray, price: np.ndarray, price_of_none: int) -> None:
        values, where, column = np.unique(level, return_index=True, return_inverse=True)
        at = np.zeros(self.n_terms, np.int64)
        at[term] = column + 1
        self.hot.append(at + self.columns)
        self.price.append(np.concatenate([[price_of_none], price[where]]))
        self.first.append(self.columns)
        self.names.append(name)
        self.columns += len(values) + 1

    def matrix(self) -> np.ndarray:
        made = np.zeros((self.n_terms, self.columns), np.float32)
        for at in self.hot:
            made[np.arange(self.n_terms), at] = 1
        return made


def _priced(x: _Levels, y: _Levels) -> np.ndarray:
    """Of each source of ``x`` with each of ``y`` the joint table of levels, priced and summed."""
    if not x.n_terms:
        return np.zeros((len(x.names), len(y.names)), np.int64)
    joint = (x.matrix().T @ y.matrix()).astype(np.int64)
    joint *= np.abs(np.concatenate(x.price)[:, None] - np.concatenate(y.price)[None, :])
    return np.add.reduceat(np.add.reduceat(joint, x.first, axis=0), y.first, axis=1)


def _leading_terms(own: _Levels, whole: _Levels, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each source the terms it has more often than its language, those of the ``most`` highest prices and ties, with
    prices. The joint table of a source's levels with the language's says which price the last of them has."""
    for k, name in enumerate(own.names):
        one = _Levels(own.n_terms)
        one.hot, one.price, one.first, one.names = [own.hot[k] - own.first[k]], [own.price[k]], [0], [name]
        one.columns = len(own.price[k])
        joint = (one.matrix().T @ whole.matrix()).astype(np.int64)
        price = one.price[0][:, None] - whole.price[0][None, :]
        taken = (joint > 0) & (price > 0)
        taken[0] = False
        if not taken.any():
            continue
        values, numbers = price[taken], joint[taken]
        order = np.argsort(-values, kind="stable")
        last = order[min(np.searchsorted(np.cumsum(numbers[order]), most), len(order) - 1)]
        of_term = price[one.hot[0], whole.hot[0]]
        chosen = np.flatnonzero((of_term >= values[last]) & (one.hot[0] > 0))
        yield name, chosen, of_term[chosen]


def _tile(table: pa.Table, most: int) -> pa.Table:
    lang, a, b = table["lang"][0].as_py(), table["a"][0].as_py(), table["b"][0].as_py()
    names = table["source"].combine_chunks().dictionary_encode()
    source, names = np.asarray(names.indices), names.dictionary.to_pylist()
    term = table["term"].combine_chunks().dictionary_encode()
    terms, term = term.dictionary.to_pylist(), np.asarray(pc.fill_null(term.indices, -1))
    head = term < 0
    block, side, n, p, q, lang_n, kept = (np.asarray(pc.fill_null(table[c], 0)) for c in ("block", "side", "n", "p", "q", "lang_n", "terms"))
    none = {int(s): (int(v), int(g)) for s, v, g in zip(source[head], p[head], side[head])}
    order = np.argsort(source[~head], kind="stable")
    s, t, level, price = (x[~head][order] for x in (source, term, n, p))
    cuts = np.searchsorted(s, np.arange(len(names) + 1))

    def chunks(of_side: int) -> list[_Levels]:
        made = [_Levels(len(terms))]
        for name, (price_of_none, group) in sorted(none.items()):
            if group == of_side:
                if made[-1].columns >= _COLUMNS:
                    made.append(_Levels(len(terms)))
                own = slice(cuts[name], cuts[name + 1])
                made[-1].add(name, t[own], level[own], price[own], price_of_none)
        return [m for m in made if m.names]

    out: list[tuple[str, str, str, int]] = []
    left = chunks(a)
    for x in left:
        for y in left if a == b else chunks(b):
            for (i, j), value in np.ndenumerate(_priced(x, y)):
                one, two = x.names[i], y.names[j]
                if one == two:
                    continue
                # Terms that the tile doesn't list are at level 0 in both: all are added once, the listed ones taken off.
                absent = abs(none[one][0] - none[two][0]) * ((int(kept[0]) if block[0] == 0 else 0) - len(terms))
                out.append((names[one], "pair", names[two], int(value) + absent))
                if a != b:
                    out.append((names[two], "pair", names[one], int(value) + absent))
    if a == b and terms:
        whole = _Levels(len(terms))
        first = np.unique(term[~head], return_index=True)[1]
        whole.add(-1, term[~head][first], lang_n[~head][first], q[~head][first], 0)
        for x in left:
            for name, chosen, values in _leading_terms(x, whole, most):
                out.extend((names[name], "term", terms[k], int(v)) for k, v in zip(chosen, values))
    columns = list(zip(*out)) or [(), (), (), ()]
    types = (pa.string(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array([lang] * len(out), pa.string()), *(pa.array(c, kind) for c, kind in zip(columns, types))]
    return pa.Table.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    ``docs`` has ``text, lang, source``; null counts as empty, other columns are ignored, repeated rows count as often as they
    occur. With p the smoothed share of a term in a source (:func:`share`), part ``pair`` has for each other source the sum of
    ``abs(p - q)`` over all kept terms, q the other's; part ``term`` has the ``top_terms`` terms by ``p - q``, of those that the
    source has and has more often than its language, q the language's. Ranks from 1 by falling value, ties by the bytes of the
    item. A source without terms has pairs, a language with one source has neither; an empty table has no rows.
    """
    counts = written(term_counts(docs, min_docs), "term_counts")
    tiles = _tiles(counts, written(_sources(counts), "sources_dealt"))
    priced = tiles.groupBy("lang", "block", "a", "b").applyInArrow(lambda table: _tile(table, top_terms), _PRICED)
    priced = written(priced, "priced")
    group = ["lang", "source", "part"]
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "item")).alias("rank")
    pairs = priced.where("part = 'pair'").groupBy(*group, "item").agg(F.sum("value").alias("value")).select("*", rank)
    terms = priced.where("part = 'term'").select("*", rank).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
