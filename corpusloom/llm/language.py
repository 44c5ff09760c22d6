"""Language of texts by rank-order profiles of their most frequent character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches

#: Most frequent n-grams of a profile and of a document that are compared, and their longest length.
TOP, LONGEST = 300, 4
#: Labelled documents per language from which profiles are learned (about; chosen by a hash of their id).
SAMPLE = 2000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Every code point's lower-case letter, 0 for what is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def gram_counts(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 32-bit hash and count of the character n-grams of up to 256 texts, sorted by text and hash.

    Letters are lower-cased, everything else between two words is one boundary; an n-gram lies in a word, with at
    most one of the boundaries before and behind it.
    """
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts) + 1), np.append(sizes, 1))[: len(codes)]
    c = _letter_table()[codes]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    keep[:1] = True
    c, text = c[keep], text[keep]
    word = c != 0
    found = []
    run = np.zeros(len(c), np.uint64)
    for n in range(1, longest + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint64(0x9E3779B97F4A7C15) + (c[n - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        if n == 1:
            good = word
        else:
            good = word[:m] | word[n - 1 :]
            for j in range(1, n - 1):
                good &= word[j : j + m]
            if n == 2:
                good &= word[:m] | word[1 : 1 + m]
        h = run[good]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        # a boundary belongs to the text whose letter it stands beside
        own = np.where(word[:m], text[:m], text[n - 1 :])[good].astype(np.uint64)
        found.append((own << np.uint64(32)) | (h >> np.uint64(32)))
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(32)).astype(np.int64), keys[first] & np.uint64(0xFFFFFFFF), counts


@dataclass(frozen=True)
class Profiles:
    """Of each language its most frequent n-grams (32-bit hashes, the most frequent first)."""

    languages: list[str]
    ranked: list[np.ndarray]
    top: int = TOP
    longest: int = LONGEST


def _counter(longest: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text, h, n = gram_counts(batch.column(1).to_pylist(), longest)
                langs = np.array(batch.column(0).to_pylist(), object)
                for lang in sorted(set(langs.tolist())):
                    own = (langs == lang)[text]
                    values, where = np.unique(h[own], return_inverse=True)
                    total = np.zeros(len(values), np.int64)
                    np.add.at(total, where, n[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(total)], names=["lang", "gram", "n"]
                    )

    return count


def fit_profiles(docs: DataFrame, top: int = TOP, longest: int = LONGEST, sample: int = SAMPLE) -> Profiles:
    """Learns a profile for each ``lang`` of ``docs`` (``doc_id, text, lang``) from about ``sample`` of its documents.

    Rows without text or language teach nothing. The sample is drawn by a hash of the id, so it does not depend on
    partitions; with fewer documents all are used. The driver receives ``top`` rows per language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles([], [], top, longest)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, sample / n)])[F.col("lang")]
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < share)
    counts = map_batches(drawn.select("lang", "text"), _counter(longest), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= top).collect()
    languages = sorted(sizes)
    ranked = [np.array([r["gram"] for r in sorted((r for r in best if r["lang"] == x), key=lambda r: r["rank"])], np.uint64) for x in languages]
    return Profiles(languages, ranked, top, longest)


def _judge(profiles) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Profiles = profiles.value
        orders = [np.argsort(r) for r in own.ranked]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = batch.num_rows
                text, h, count = gram_counts(pc.fill_null(batch.column(1), "").to_pylist(), own.longest)
                most = np.uint64((1 << 24) - 1)
                key = (text.astype(np.uint64) << np.uint64(56)) | ((most - np.minimum(count.astype(np.uint64), most)) << np.uint64(32)) | h
                key.sort()
                text = (key >> np.uint64(56)).astype(np.int64)
                rank = np.arange(len(key)) - np.searchsorted(text, np.arange(n))[text]
                near = rank < own.top
                text, rank, h = text[near], rank[near], (key & np.uint64(0xFFFFFFFF))[near]
                size = np.bincount(text, minlength=n)
                apart = np.ones((len(own.languages), n))
                for i, (ranked, order) in enumerate(zip(own.ranked, orders)):
                    if not len(ranked):
                        continue
                    slot = np.minimum(np.searchsorted(ranked, h, sorter=order), len(ranked) - 1)
                    place = order[slot]
                    out = np.where(ranked[place] == h, np.abs(place - rank), own.top)
                    apart[i] = np.bincount(text, weights=out, minlength=n) / np.maximum(1, size * own.top)
                if own.languages:
                    best = apart.argmin(0)
                    names = [own.languages[b] if s else UNKNOWN for b, s in zip(best, size)]
                    score = np.where(size > 0, 1 - apart.min(0), 0.0)
                else:
                    names, score = [UNKNOWN] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return judge


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Language of every text: ``doc_id, lang_pred, score``.

    The ``top`` most frequent n-grams of the whole text are compared with each profile: an n-gram costs the distance of its
    ranks, or ``top`` where the profile lacks it. The nearest profile wins, of equals the first by name; ``score`` is 1 minus
    its mean cost over ``top``. A null text and one without a letter give ``und`` and 0; rows may repeat; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _judge(shared), "doc_id long, lang_pred string, score double")


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id, as text, falls on ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
