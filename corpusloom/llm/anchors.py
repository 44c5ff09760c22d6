"""Content-defined passages: runs of words that begin at the least hash of a window, and the equal words beside two copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .words import SPACED, data_of, runs_of, words_of

CONTEXTS = "hash long, doc_id long, at int, before binary, after binary"
_MARKS = "hash long, doc_id long, at int, paragraph int, last int, n_lines int"
PARAGRAPHS = "doc_id long, paragraph int, n_words int, lines array<int>, text string"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _over(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """Least or greatest value of every ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values = choose(values[:-size], values[size:])
        size *= 2
    return choose(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def least_of_windows(values: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are the least of a window of ``width``; ``whole`` says which windows count."""
    least = np.where(whole, _over(values, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_over(np.concatenate([edge, least, edge]), width, np.maximum) == values)


def _cut(n_words: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = n_words
        for batch in _slices(batches):
            hashes, text, start, _ = words_of(batch.column(1), SPACED)
            if len(hashes) < n_words + width - 1:
                continue
            runs = runs_of(hashes, n_words)
            whole = text[: len(runs) - width + 1] == text[n_words + width - 2 :]
            at = least_of_windows(runs, whole, width)
            data, offsets = data_of(batch.column(1))
            ends = np.flatnonzero(data == 10)
            owner = text[at]
            before = np.searchsorted(ends, offsets[owner])
            line = np.searchsorted(ends, start)
            rank = np.cumsum(np.diff(line, prepend=line[:1]) > 0)
            first, last = at, at + n_words - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs[at].view(np.int64)),
                    batch.column(0).take(pa.array(owner)),
                    pa.array((at - np.searchsorted(text, owner)).astype(np.int32)),
                    pa.array((line[first] - before).astype(np.int32)),
                    pa.array((line[last] - before).astype(np.int32)),
                    pa.array((rank[last] - rank[first] + 1).astype(np.int32)),
                ],
                names=["hash", "doc_id", "at", "paragraph", "last", "n_lines"],
            )

    return cut


def anchors(docs: DataFrame, n_words: int) -> DataFrame:
    """Anchored passages of ``docs`` (doc_id, text): ``hash, doc_id, at`` (number of the first word), ``paragraph, last``
    (first and last line), ``n_lines`` (lines with words).

    Of all passages of ``n_words`` words those with the least hash of ``n_words`` in a row. A run of ``2 * n_words - 1`` words has a
    window of its own, so equal runs have equal anchors, whatever stands around them; their passages leave no word between.
    """
    return map_batches(docs.select("doc_id", "text"), _cut(n_words), _MARKS)


def contexts(n_words: int) -> Callable:
    """Task function: (doc_id, text, places) to the passages there with the hashes of ``n_words`` words before each place, nearest first, and of those
    behind its passage; fewer where the document ends."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, text, _, _ = words_of(batch.column(1), SPACED)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            names, ids, places, before, after = [], [], [], [], []
            for k, (doc, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                words = hashes[bounds[k] : bounds[k + 1]]
                own = runs_of(words, n_words).view(np.int64) if len(words) >= n_words else words[:0]
                for at in found:
                    if at >= len(own):  # another text of the same id
                        continue
                    names.append(own[at])
                    ids.append(doc)
                    places.append(at)
                    before.append(words[max(0, at - n_words) : at][::-1].tobytes())
                    after.append(words[at + n_words : at + 2 * n_words].tobytes())
            arrays = [pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "doc_id", "at", "before", "after"])

    return beside


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows end to end, and where each row's begin, with the end."""
    raw = column.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if not len(raw) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    return np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64), (bounds - bounds[0]) // 8


def _equal(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Number of equal hashes up to the first difference, row by row."""
    (x, x_at), (y, y_at) = _hashes(one), _hashes(two)
    n = np.minimum(np.diff(x_at), np.diff(y_at))
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    other = np.flatnonzero(x[np.repeat(x_at[:-1], n) + place] != y[np.repeat(y_at[:-1], n) + place])
    row, first = np.unique(np.repeat(np.arange(len(n)), n)[other], return_index=True)
    n[row] = place[other[first]]
    return n


def lengthened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first_word`` and ``n_words`` moved over the words that equal those of the staying copy.

    ``before, after`` are the row's hashes, ``b, a`` those of the copy; they are dropped.
    """
    kept = [c for c in rows.columns if c not in ("before", "after", "b", "a")]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            # a copy that stays equals itself beside its passage, and stays as it is
            moves = column["removed"].to_numpy(zero_copy_only=False).astype(bool)
            left, right = (_equal(column[p], column[q]) * moves for p, q in (("before", "b"), ("after", "a")))
            column["first_word"] = pa.array(column["first_word"].to_numpy() - left, pa.int32())
            column["n_words"] = pa.array(column["n_words"].to_numpy() + left + right, pa.int32())
            yield pa.RecordBatch.from_arrays([column[c] for c in kept], names=kept)

    return map_batches(rows, move, rows.select(*kept).schema)


def _blocks(counts: list[int], ends: list[bool], min_words: int) -> Iterator[list[int]]:
    """Numbers of the lines with words of each joined paragraph, of lines with fewer than ``min_words`` words."""
    done: list[list[int]] = []
    lines: list[int] = []
    words = 0
    for i, n in enumerate([*counts, min_words]):
        long = n >= min_words
        if not long and n:
            lines.append(i)
            words += n
        if words >= min_words and (long or not n or ends[i]):
            done.append(lines)
            lines, words = [], 0
        if long:
            if done:
                done[-1].extend(lines)  # too few words are left for a paragraph of their own
            yield from done
            done, lines, words = [], [], 0


def _paragraphs(min_words: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(1)
            hashes, text, start, _ = words_of(texts, SPACED)
            data, offsets = data_of(texts)
            newlines = np.flatnonzero(data == 10)
            # lines of the batch: each document's first line, and one behind every line end
            before = np.searchsorted(newlines, offsets[:-1])
            base = before + np.arange(batch.num_rows)
            line = np.searchsorted(newlines, start) + text
            total = len(newlines) + batch.num_rows
            counts = np.bincount(line, minlength=total)
            marked = np.zeros(total, bool)
            last = np.flatnonzero(np.diff(line, append=total))
            marked[line[last]] = hashes[last] % np.uint64(4) == 0
            found = []
            for k in np.flatnonzero(np.bincount(text, minlength=batch.num_rows) >= min_words).tolist():
                at, end = int(base[k]), int(base[k + 1]) if k + 1 < batch.num_rows else total
                own = counts[at:end]
                blocks = [[i] for i in np.flatnonzero(own >= min_words).tolist()]
                if own[own < min_words].sum() >= min_words:
                    blocks.extend(_blocks(own.tolist(), marked[at:end].tolist(), min_words))
                if blocks:
                    doc, parts = batch.column(0)[k].as_py(), data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
                    found.extend((doc, lines[0], int(own[lines].sum()), lines, b"\n".join(parts[i] for i in lines)) for lines in blocks)
            columns = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.string())], names=["doc_id", "paragraph", "n_words", "lines", "text"])

    return cut


def paragraphs(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines with at least ``min_words`` words, and adjacent ones with fewer joined: ``doc_id, paragraph`` (number of the first
    line, from 0), ``n_words, lines`` (numbers of those with words), ``text``.

    A joined paragraph ends, once it has ``min_words`` words, at an empty line or behind a line whose last word's hash says so: copies
    are joined alike soon behind their start. What is left before a longer line belongs to the paragraph before; a few short
    lines between longer ones with fewer words in all are no paragraph. All are cut in one pass over the texts.
    """
    return map_batches(docs.select("doc_id", "text"), _paragraphs(min_words), PARAGRAPHS)
