"""Arrow functions that run in Python workers: merging the symbols of pieces, and nothing else.

They are sent to the workers by value, so a worker does not need this package installed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Merges = tuple[tuple[int, int, int], ...]

_NO_RULE = np.iinfo(np.int64).max
#: Bytes of pieces that are encoded at once. The work needs some hundred bytes for each, and a task may hold two workers.
SLICE_BYTES = 1 << 18


class Rules:
    """Merge rules as sorted arrays, so that all neighbouring symbols of a batch are looked up in one search."""

    def __init__(self, merges: Merges, first_ids: list[int], special: dict[str, int]):
        self.first_ids = np.array(first_ids, dtype=np.int64)
        self.special = pa.array(list(special), pa.string())
        self.special_ids = np.array(list(special.values()), dtype=np.int64)
        table = np.array(merges, dtype=np.int64).reshape(-1, 3)
        keys = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.merged, self.rank = keys[order], table[order, 2], order

    def lookup(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the rule for each symbol and the one after it, and what it gives."""
        if not len(self.keys):
            return np.full(len(ids), _NO_RULE), ids
        key = (ids[:-1] << 32) | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank = np.where(self.keys[at] == key, self.rank[at], _NO_RULE)
        return np.append(rank, _NO_RULE), np.append(self.merged[at], 0)


def merged_symbols(rules: Rules, ids, piece, first, last):
    """Merge the symbols of many pieces side by side, in each the best ranked rule first, until no rule applies.

    ``piece`` numbers the piece of each symbol, ``first`` and ``last`` its characters; all four come back in order.
    """
    done = []
    while len(ids):
        rank, made = rules.lookup(ids)
        rank[np.flatnonzero(piece[1:] != piece[:-1])] = _NO_RULE
        starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        sizes = np.diff(np.append(starts, len(piece)))
        best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        ended = best == _NO_RULE
        if ended.any():
            done.append([a[ended] for a in (piece, ids, first, last)])
            going = ~ended
            piece, ids, first, last, rank, made, best = (a[going] for a in (piece, ids, first, last, rank, made, best))
        at = np.flatnonzero(rank == best)
        if len(at):
            # Where places overlap, as in a run of one symbol, every other one is taken from the left.
            run_start = np.append(True, np.diff(at) != 1)
            in_run = at - np.maximum.accumulate(np.where(run_start, at, 0))
            at = at[in_run % 2 == 0]
            ids[at], last[at] = made[at], last[at + 1]
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            piece, ids, first, last = (a[kept] for a in (piece, ids, first, last))
    piece, ids, first, last = (np.concatenate([d[k] for d in done]) for k in range(4)) if done else (ids,) * 4
    order = np.argsort(piece, kind="stable")
    return piece[order], ids[order], first[order], last[order]


def content_of(raw: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Bytes of all pieces, end to end."""
    data = raw.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def encoded_pieces(rules: Rules, pieces: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many ids each piece gives, and the ids, first and last characters of all pieces end to end."""
    raw = pc.cast(pieces, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1, offset=8 * raw.offset)
    content = content_of(raw, offsets)
    sizes = np.diff(offsets)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    char = np.cumsum((content & 0xC0) != 0x80) - 1
    begins = (offsets[:-1] - offsets[0])[piece]
    first = char - char[begins] if len(char) else char
    ids, last = rules.first_ids[content], first.copy()
    found = pc.index_in(pieces, rules.special).fill_null(-1).to_numpy(zero_copy_only=False)
    if (found >= 0).any():
        reserved = found[piece] >= 0
        head = np.append(True, piece[1:] != piece[:-1])
        ids[reserved] = rules.special_ids[found[piece[reserved]]]
        last[reserved] = np.repeat(sizes, sizes)[reserved] - 1
        kept = ~reserved | head
        piece, ids, first, last = (a[kept] for a in (piece, ids, first, last))
    piece, ids, first, last = merged_symbols(rules, ids, piece, first, last)
    return np.bincount(piece, minlength=len(pieces)), [a.astype(np.int32) for a in (ids, first, last)]


def row_bounds(lists: pa.Array) -> np.ndarray:
    """Where each row begins and ends in ``lists.flatten()``; null rows are empty there."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(lengths)))


def encode_batch(pieces: pa.Array, rules: Rules, parts: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Encode the distinct pieces of a batch and gather them by position.

    Returns where each row's ids begin, how many ids each piece gave, and the first ``parts`` of ids, first and last
    characters. Ids alone, without merges and reserved tokens, are looked up byte by byte.
    """
    if parts == 1 and not len(rules.keys) and not pc.any(pc.is_in(pieces.flatten(), rules.special)).as_py():
        raw = pc.cast(pieces.flatten(), pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1, offset=8 * raw.offset)
        content, counts = content_of(raw, offsets), np.diff(offsets)
        return (offsets - offsets[0])[row_bounds(pieces)], counts, [rules.first_ids.astype(np.int32)[content]]
    coded = pieces.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, values = encoded_pieces(rules, coded.dictionary)
    starts = np.cumsum(lengths) - lengths
    counts = lengths[at]
    ends = np.cumsum(counts)
    take = np.repeat(starts[at] - (ends - counts), counts) + np.arange(int(counts.sum()))
    return np.concatenate(([0], ends))[row_bounds(pieces)], counts, [v[take] for v in values[:parts]]


def bytes_before(pieces: pa.Array) -> np.ndarray:
    """Bytes of all pieces before each row, and of all rows; read at the ends of the rows, not added up piece by piece."""
    texts = pieces.values
    if not len(pieces) or not len(texts):
        return np.zeros(len(pieces) + 1, dtype=np.int64)
    width = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    ends = np.frombuffer(texts.buffers()[1], dtype=width, count=len(texts) + 1, offset=width.itemsize * texts.offset)
    before = ends[pieces.offsets.to_numpy()].astype(np.int64)
    return before - before[0]


def row_slices(pieces: pa.Array, *more: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each part of a batch that is encoded at once; a longer row goes alone."""
    before = sum(bytes_before(p) for p in (pieces, *more))
    start = 0
    while start < len(pieces):
        stop = max(int(np.searchsorted(before, before[start] + SLICE_BYTES, side="right")) - 1, start + 1)
        yield start, stop - start
        start = stop


def ids_function(merges: Merges, first_ids: list[int], special: dict[str, int]):
    """Column function from ``array<string>`` of pieces to ``array<int>``."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = Rules(merges, first_ids, special)
        for batch in batches:
            for part in row_slices(batch):
                bounds, _, (ids,) = encode_batch(batch.slice(*part), rules, 1)
                yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    return ids_of


def id_pairs_function(merges: Merges, first_ids: list[int], special: dict[str, int]):
    """Column function from two ``array<string>`` of pieces to ``struct<first,second>`` of their ids, in one worker."""

    @F.arrow_udf("struct<first:array<int>,second:array<int>>")
    def ids_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules = Rules(merges, first_ids, special)
        for batch in batches:
            for part in row_slices(*batch):
                lists = []
                for pieces in batch:
                    bounds, _, (ids,) = encode_batch(pieces.slice(*part), rules, 1)
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.StructArray.from_arrays(lists, names=["first", "second"])

    return ids_of


def flat_values(lists: pa.Array, lengths: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Values of the rows end to end; a null row of ``lengths`` values takes them from ``default``."""
    given = lists.is_valid().to_numpy(zero_copy_only=False)
    out = default.copy()
    out[np.repeat(given, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def spans_batch(pieces: pa.Array, prefixed: pa.Array, origin: pa.Array, length: pa.Array, rules: Rules) -> pa.Array:
    """Ids and spans of some rows."""
    bounds, counts, (ids, first, last) = encode_batch(pieces, rules, 3)
    piece_bounds = row_bounds(pieces)
    per_row = np.diff(piece_bounds)
    widths = pc.utf8_length(pieces.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    row_widths = np.diff(np.concatenate(([0], np.cumsum(widths)))[piece_bounds])
    # Characters of each folded text; without a list of origins there are as many as in the raw text.
    moved = origin.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    raw_length = length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.where(moved >= 0, moved, raw_length)
    only_first = np.zeros(len(widths), dtype=np.int64)
    filled = per_row > 0
    only_first[piece_bounds[:-1][filled]] = (row_widths - chars)[filled]
    extra = flat_values(prefixed, per_row, only_first)
    # The folded texts of a batch lie end to end, and so do their origins.
    char_bounds = np.cumsum(chars) - chars
    raw = flat_values(origin, chars, np.arange(chars.sum()) - np.repeat(char_bounds, chars))
    widths -= extra
    base = np.repeat(np.cumsum(widths) - widths, counts)
    shift = np.repeat(extra, counts)
    start = raw[base + np.maximum(first - shift, 0)]
    end = raw[base + np.maximum(last - shift, 0)] + 1
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["s", "e"])
    at = pa.array(bounds, pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, spans)]
    return pa.StructArray.from_arrays(lists, names=["ids", "offsets"])


def spans_function(merges: Merges, first_ids: list[int], special: dict[str, int]):
    """Column function from pieces, their prefix flags, character origins and the raw length to ids and spans."""

    @F.arrow_udf("struct<ids:array<int>,offsets:array<struct<s:int,e:int>>>")
    def spans_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        rules = Rules(merges, first_ids, special)
        for batch in batches:
            for part in row_slices(batch[0]):
                yield spans_batch(*[column.slice(*part) for column in batch], rules)

    return spans_of


def examples_function(merges: Merges, first_ids: list[int], special: dict[str, int]):
    """Column function from a question's pieces and all that :func:`spans_function` takes of its context to ids of the
    question and ids and spans of the context, in one worker."""

    @F.arrow_udf("struct<question:array<int>,ids:array<int>,offsets:array<struct<s:int,e:int>>>")
    def both_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        rules = Rules(merges, first_ids, special)
        for question, *context in batches:
            for part in row_slices(question, context[0]):
                bounds, _, (ids,) = encode_batch(question.slice(*part), rules, 1)
                asked = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                spans = spans_batch(*[column.slice(*part) for column in context], rules)
                yield pa.StructArray.from_arrays([asked, *spans.flatten()], names=["question", "ids", "offsets"])

    return both_of


#: Symbols of words in training are characters from here on: all of them take four bytes.
FIRST_SYMBOL = 0x10000


def symbols_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols of all words, end to end, and the number of each word's symbols."""
    raw = pc.cast(words, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=len(raw) + 1, offset=8 * raw.offset)
    data = raw.buffers()[2]
    content = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    quads = content.reshape(-1, 4).astype(np.int64)
    ids = (quads[:, 0] & 7) << 18 | (quads[:, 1] & 63) << 12 | (quads[:, 2] & 63) << 6 | quads[:, 3] & 63
    return ids - FIRST_SYMBOL, np.diff(offsets) // 4


def words_from(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The words that :func:`symbols_of` takes apart."""
    code = ids + FIRST_SYMBOL
    quads = np.stack([0xF0 | code >> 18, 0x80 | code >> 12 & 63, 0x80 | code >> 6 & 63, 0x80 | code & 63], 1).astype(np.uint8)
    offsets = np.concatenate(([0], np.cumsum(4 * sizes.astype(np.int64))))
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(quads.tobytes())])
    return pc.cast(made, pa.large_string()).cast(pa.string())


def segments_function(pairs: list[tuple[int, int]]):
    """Batches of ``word, freq`` to ``segment, freq``: words are cut between symbols that are no pair of the list, and what
    is left alone is dropped."""

    def run(batches):
        keys = np.sort(np.array([left << 32 | right for left, right in pairs], dtype=np.int64))
        for batch in batches:
            ids, sizes = symbols_of(batch.column(0))
            if not len(ids):
                continue
            word = np.repeat(np.arange(len(sizes)), sizes)
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            joined = (keys[at] == key) & (word[1:] == word[:-1])
            starts = np.flatnonzero(np.append(True, ~joined))
            length = np.diff(np.append(starts, len(ids)))
            long = length > 1
            inside = np.repeat(long, length)
            freq = batch.column(1).to_numpy()[word[starts[long]]]
            segments = words_from(ids[inside], length[long])
            yield pa.RecordBatch.from_arrays([segments, pa.array(freq)], names=["segment", "freq"])

    return run


def merging_function(merges: Merges):
    """Batches of ``word, freq`` with the merges applied."""

    def run(batches):
        rules = Rules(merges, [], {})
        for batch in batches:
            ids, sizes = symbols_of(batch.column(0))
            word = np.repeat(np.arange(len(sizes)), sizes)
            word, ids, _, _ = merged_symbols(rules, ids.copy(), word, ids.copy(), ids.copy())
            words = words_from(ids, np.bincount(word, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays([words, batch.column(1)], names=["word", "freq"])

    return run
