"""Arrow functions that follow one JSON text through fragments of it, each of which ends at a closing brace.

Whether a brace counts depends on whether a string is open before it, and how deep it lies on all braces before. Both can be
told for a range of the text without knowing what comes before: for either case of the string, how much deeper the range
ends, and how many braces open at each depth relative to its start. They are sent to the workers by value.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _OPEN, _CLOSE = b'"{}'

#: Depth of the objects that are looked for: in the list of an object.
DEPTH = 2


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
    """File, block, first row and text of neighbouring rows ``value, file, block`` of one block, with the braces at their ends."""
    file, block = batch.column(1).dictionary_encode(), np.asarray(batch.column(2))
    code = np.asarray(file.indices)
    cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
    values = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), batch.column(0).cast(pa.large_string()))
    for k, text in enumerate(pc.binary_join(values, pa.scalar("}", pa.large_string()))):
        if cuts[k + 1] > cuts[k]:
            yield file.dictionary[code[cuts[k]]].as_py(), int(block[cuts[k]]), cuts[k], text.as_py().encode() + b"}"


def _braces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of all braces, one for those that open and minus one for the others, whether a string is open there if none is at
    the start, and whether the text has an odd number of quotes."""
    data = np.frombuffer(_ESCAPE.sub(b"__", text) if b"\\" in text else text, np.uint8)
    at = np.flatnonzero((data == _OPEN) | (data == _CLOSE))
    quotes = np.flatnonzero(data == _QUOTE)
    return at, np.where(data[at] == _OPEN, 1, -1), np.searchsorted(quotes, at) % 2 == 1, len(quotes) % 2 == 1


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments ``value, file, block`` to a row ``file, block, inside, ends_inside, deeper, opened`` for each block and case."""
    last: tuple[str, int] | None = None
    states: list[list] = []
    rows: list[tuple] = []

    def close() -> None:
        for case, (inside, depth, opened) in enumerate(states):
            rows.append((*last, bool(case), inside, depth, list(opened.items())))

    for batch in batches:
        for file, block, _, text in _stretches(batch):
            if (file, block) != last:
                close()
                last, states = (file, block), [[False, 0, Counter()], [True, 0, Counter()]]
            _, signs, quoted, odd = _braces(text)
            for state in states:
                sign = signs[quoted == state[0]]
                depth = state[1] + np.cumsum(sign)
                levels, n = np.unique(depth[sign > 0], return_counts=True)
                state[2].update(dict(zip(levels.tolist(), n.tolist())))
                state[0] ^= odd
                state[1] = int(depth[-1]) if len(depth) else state[1]
    close()
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.map_(pa.int32(), pa.int64())]
    names = ["file", "block", "inside", "ends_inside", "deeper", "opened"]
    columns = zip(*rows) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=names)


def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments ``value, file, block, inside, depth, opened`` with the state at the start of their block to the objects at the
    wanted depth, numbered in their file: ``file, number, block, whole, text``. What a block has only a part of isn't whole."""
    last: tuple[str, int] | None = None
    inside, depth, number, whole = False, 0, -1, True
    begun: list[bytes] = []
    rows: list[tuple] = []

    def told() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        columns = zip(*rows) if rows else [()] * 5
        made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(made, names=["file", "number", "block", "whole", "text"])

    def end(complete: bool) -> None:
        rows.append((last[0], number, last[1], complete, b"".join(begun)))
        begun.clear()

    for batch in batches:
        for file, block, row, text in _stretches(batch):
            if (file, block) != last:
                if begun:
                    end(False)
                last = (file, block)
                inside, depth, before = (batch.column(k)[row].as_py() for k in (3, 4, 5))
                number, whole = before - 1, False
            at, signs, quoted, odd = _braces(text)
            counted = quoted == inside
            at, sign = at[counted], signs[counted]
            after = depth + np.cumsum(sign)
            starts = at[(sign > 0) & (after == DEPTH)].tolist()
            stops = (at[(sign < 0) & (after == DEPTH - 1)] + 1).tolist()
            if depth >= DEPTH:
                begun.append(text[: stops[0]] if stops else text)
                if stops:
                    end(whole)
                    stops = stops[1:]
            for k, start in enumerate(starts):
                number, whole = number + 1, True
                begun.append(text[start : stops[k]] if k < len(stops) else text[start:])
                if k < len(stops):
                    end(True)
            inside ^= odd
            depth = int(after[-1]) if len(after) else depth
        yield told()
    if begun:
        end(False)
    yield told()
