"""Words of whole Arrow batches as 64-bit hashes, with numpy: no Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def alphabet(separators: bytes) -> np.ndarray:
    """For every byte what it counts as in a word: A-Z as a-z, separators as 0; bytes from 128 on are always in words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Separated by white space of ASCII.
SPACED = alphabet(bytes([0x20, *range(0x09, 0x0E)]))
#: Digits, letters of ASCII and everything beyond ASCII.
ALNUM = alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        size = max(n, _BLOCK + 4096)
        for name, base in (("up", _STEP), ("down", inverse)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"], _powers["down"]


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and the first byte of each, with the end of the last; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash, number of its text, first byte and end in the batch's bytes."""
    data, offsets = data_of(texts)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data):  # cut behind a separator or at the end of a text
            window = table[data[end - 1 : end + 4095]] == 0
            if window.any():
                end = min(len(data), end + int(window.argmax()))
                break
            end = min(len(data), end + 4096)
        h, s, e = _block(data[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "left")] - at, table)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(offsets, start, "right") - 1, start, np.concatenate(ends)


def _block(data: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = table[data]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = firsts[(firsts >= 0) & (firsts < len(data))]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = firsts[firsts > 0] - 1
    stops[before] = inside[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def shingles_of(hashes: np.ndarray, text: np.ndarray, k: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words and its text; a text with fewer words, but not none, has one run: all its words."""
    step = np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    n = len(hashes) - k + 1
    if n > 0:
        run = np.zeros(n, np.uint64)
        for j in range(k):
            run = run * step + hashes[j : j + n]
        keep = text[:n] == text[k - 1 :]
        runs, owners = mix(run[keep] + np.uint64(k)), text[:n][keep]
    else:
        runs, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = []
        for t in short:
            value = 0
            for h in hashes[first[t] : first[t] + counts[t]].tolist():
                value = (value * int(step) + h) & 0xFFFFFFFFFFFFFFFF
            extra.append((value + int(counts[t])) & 0xFFFFFFFFFFFFFFFF)
        runs = np.concatenate([runs, mix(np.array(extra, np.uint64))])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        runs, owners = runs[order], owners[order]
    return runs, owners


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, also over the ends of texts; the time doesn't grow with ``k``."""
    up, down = _power(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(hashes) - k + 1])


def prefixes_of(texts: pa.Array, table: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their longer-than-that prefixes (lengths in bytes), and the text of each."""
    data, offsets = data_of(texts)
    hashes, text, start, end = words_of(texts, table)
    found, owners = [hashes], [text]
    size = end - start
    for k in lengths:
        at = start[size > k]
        run = np.full(len(at), k, np.uint64)
        for j in range(k):
            run = run * _STEP + _BYTE[table[data[at + j]]]
        found.append(mix(run))
        owners.append(text[size > k])
    return np.concatenate(found), np.concatenate(owners)
