"""Benchmark decontamination by winnowing: shared runs of words between documents and benchmark items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .common import map_batches
from .words import ALNUM, mix, words_of

#: Words of a window, and of the runs whose hashes are compared. Each window has ``WINDOW - GRAM + 1`` runs.
WINDOW, GRAM = 13, 5
#: Benchmark words held by a task at once (32 MB of hashes); a larger benchmark is taken in blocks, one pass over the texts each.
BLOCK_WORDS = 1 << 22
#: Places of benchmark runs that are compared with a text's at a time (about 40 MB), however many items share a phrase.
EXPANDED = 1 << 18
#: Items longer than this are cut into segments that overlap by a window less a word, so each window is in one segment.
SEGMENT_WORDS = 1 << 16
_ADDED = ("n_words", "n_hit", "hit_spans", "items", "n_items", "contaminated")


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on, across text ends too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(run + np.uint64(k))


def winnowed(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions of the minimal run (the first of equal ones) of every window that lies in one text."""
    span = WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 : WINDOW - 1 + n])
    picked = np.lib.stride_tricks.sliding_window_view(grams, span)[inside].argmin(1) + inside
    return np.unique(picked)


class Index:
    """Fingerprints of one block of the benchmark."""

    def __init__(self, names: list[str], segments: list[bytes]):
        words = [np.frombuffer(s, np.uint64) for s in segments]
        self.names = sorted(set(names))
        number = {name: i for i, name in enumerate(self.names)}
        self.item = np.array([number[n] for n in names], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.past = np.cumsum(sizes)
        self.first = self.past - sizes
        grams = gram_hashes(self.words, GRAM)
        at = winnowed(grams, self.owner)
        order = np.argsort(grams[at], kind="stable")
        self.at = at[order]
        self.keys, self.from_ = np.unique(grams[at][order], return_index=True)
        self.count = np.diff(np.append(self.from_, len(at)))
        self.short = {}
        for size in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]).tolist():
            which = np.flatnonzero(sizes == size)
            keys = np.array([gram_hashes(words[i], size)[0] for i in which], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.short[size] = (keys[order], which[order])

    def hits(self, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First and last-but-one word of each shared stretch and the item it is shared with."""
        grams = gram_hashes(hashes, GRAM)
        p = winnowed(grams, text)
        if len(p) and len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, grams[p]), len(self.keys) - 1)
            found = self.keys[slot] == grams[p]
            p, slot = p[found], slot[found]
            for start, k in _expanded(self.from_[slot], self.count[slot]):
                yield self._extended(hashes, text, p[start], self.at[k])
        for size, (keys, which) in self.short.items():
            grams = gram_hashes(hashes, size)
            if not len(grams):
                continue
            low = np.searchsorted(keys, grams, "left")
            count = np.searchsorted(keys, grams, "right") - low
            p = np.flatnonzero((count > 0) & (text[: len(grams)] == text[size - 1 :]))
            if len(p):
                for start, k in _expanded(low[p], count[p]):
                    yield p[start], p[start] + size, self.item[which[k]]

    def _extended(self, hashes, text, p, q):
        owner, doc = self.owner[q], text[p]
        same = np.ones(len(p), bool)
        for j in range(GRAM):
            same &= hashes[p + j] == self.words[q + j]
        p, q, owner, doc = p[same], q[same], owner[same], doc[same]
        reach = WINDOW - GRAM
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        going = np.ones(len(p), bool)
        for j in range(1, reach + 1):
            a, b = p - j, q - j
            going &= (a >= 0) & (b >= self.first[owner])
            a, b = np.maximum(a, 0), np.maximum(b, 0)
            going &= (text[a] == doc) & (hashes[a] == self.words[b])
            left += going
        going[:] = True
        for j in range(reach):
            a, b = p + GRAM + j, q + GRAM + j
            going &= (a < len(hashes)) & (b < self.past[owner])
            a, b = np.minimum(a, len(hashes) - 1), np.minimum(b, len(self.words) - 1)
            going &= (text[a] == doc) & (hashes[a] == self.words[b])
            right += going
        whole = left + GRAM + right >= WINDOW
        return (p - left)[whole], (p + GRAM + right)[whole], self.item[owner[whole]]


def _expanded(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows repeated by count, and the running number inside each from ``first`` on, ``EXPANDED`` of them at a time."""
    past = np.cumsum(count)
    for at in range(0, int(past[-1]) if len(past) else 0, EXPANDED):
        place = np.arange(at, min(at + EXPANDED, int(past[-1])))
        row = np.searchsorted(past, place, "right")
        yield row, place - (past - count)[row] + first[row]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, text, _, _ = words_of(batch.column(1), ALNUM)
        names, numbers, parts = [], [], []
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            own = hashes[cuts[i] : cuts[i + 1]]
            step = SEGMENT_WORDS - WINDOW + 1
            for n, at in enumerate(range(0, max(1, len(own) - WINDOW + 1), step)):
                names.append(batch.column(0)[i].as_py())
                numbers.append(n)
                parts.append(own[at : at + SEGMENT_WORDS].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["item", "segment", "words"])


def _finder(index, carried: int, schema: pa.Schema) -> Callable:
    """Task function: rows of (carried columns, text, n_words, hit_spans, items) with the hits of one block added."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = batch.num_rows
                hashes, text, _, _ = words_of(batch.column(carried), ALNUM)
                cuts = np.searchsorted(text, np.arange(n + 1))
                docs, waiting = [], 0
                edges = np.zeros(len(hashes) + 1, np.int64)
                for first, past, item in own.hits(hashes, text):
                    np.add.at(edges, first, 1)
                    np.add.at(edges, past, -1)
                    docs.append(np.unique(text[first] * len(own.names) + item))
                    waiting += len(docs[-1])
                    if waiting > 4 * EXPANDED:  # pairs of text and item repeat from part to part
                        docs = [np.unique(np.concatenate(docs))]
                        waiting = 0
                names: list[list[str]] = [x or [] for x in batch.column(carried + 3).to_pylist()]
                for i, spans in enumerate(batch.column(carried + 2).to_pylist()):
                    for s in spans or ():
                        edges[cuts[i] + s["first"]] += 1
                        edges[cuts[i] + s["past"]] -= 1
                if docs:
                    for pair in np.unique(np.concatenate(docs)).tolist():
                        names[pair // len(own.names)].append(own.names[pair % len(own.names)])
                spans = _spans(np.cumsum(edges)[:-1] > 0, text, cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in range(carried + 1)),
                        pa.array(np.diff(cuts)),
                        spans.cast(schema.field(carried + 2).type),
                        pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())).cast(schema.field(carried + 3).type),
                    ],
                    schema=schema,
                )

    return find


def _spans(hit: np.ndarray, text: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Maximal stretches of hit words by text, counted from the text's first word."""
    begin, stop = hit.copy(), hit.copy()
    if len(hit):
        change = text[1:] != text[:-1]
        begin[1:] &= ~hit[:-1] | change
        stop[:-1] &= ~hit[1:] | change
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    owner = text[first]
    offsets = np.searchsorted(owner, np.arange(len(cuts)))
    values = pa.StructArray.from_arrays(
        [pa.array((first - cuts[owner]).astype(np.int32)), pa.array((last + 1 - cuts[owner]).astype(np.int32))], names=["first", "past"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` (columns ``carry``, all but text by default) with the benchmark words found in it.

    Added: ``n_words``, ``hit_spans`` (stretches of hit words, by word number), ``n_hit``, ``items`` (sorted distinct ids, as
    strings), ``n_items``, ``contaminated`` (a twentieth of the words or more are hit). A word is hit if it lies in a window
    of 13 words that an item has too; an item of fewer words is one window. Every shared window is found: both sides keep
    the minimal hash of its runs of five words. Null and empty texts have no words; rows may repeat; items without words
    match nothing, and a null item id counts as ``null``; a column that is called like an added one gives way to it. The benchmark is sent to tasks in blocks of bounded size.
    """
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    carry = [c for c in carry if c not in _ADDED]
    kept = [c for c in carry if c != "text"]
    raw = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    parts = written(map_batches(raw, _segments, "item string, segment int, words binary").where("length(words) > 0"), "benchmark")
    total = parts.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    blocks = max(1, -int(-total // block_words))
    rows = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],
        F.col("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<first:int,past:int>>").alias("hit_spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item", "segment"), F.lit(blocks)) == block).select("item", "words").collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r["item"] for r in own], [bytes(r["words"]) for r in own]))
        rows = map_batches(rows, _finder(index, len(kept), to_arrow_schema(rows.schema)), rows.schema)
        if block < blocks - 1:
            rows = written(rows, "searched")
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["past"] - s["first"]))
    found = rows.select("*", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"))
    return found.select(
        *[F.col("text") if c == "text" else F.col(f"c{kept.index(c)}").alias(c) for c in carry],
        "n_words",
        "n_hit",
        "hit_spans",
        "items",
        "n_items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
