"""Quality rules by labelling lines: a linear-chain conditional random field marks each line as content or boilerplate.

What a line looks like (length, symbols, capitals, repeats, how it ends) gives a score of either label, neighbouring labels
score together, and Viterbi decoding picks the best sequence of a document. The share of words in content lines decides
whether a document stays. The field is trained without given labels: plain rules mark the lines that are obvious, the others
are unknown, and descent raises the likelihood of what is marked, with the unknown lines summed out.

Lines, words and features of a whole batch are cut and counted with numpy; a text is never cut, and only the lines of a
bounded sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .words import data_of, mix, shingles_of, words_of

#: Words end at white space of ASCII, lines at a line feed. Byte 0 is part of both and takes the code of a separator.
_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[[0x20, *range(0x09, 0x0E)]] = 0
_WORDS[0] = 0x20
_LINES = np.arange(256, dtype=np.uint8)
_LINES[0x0A] = 0
_LINES[0] = 0x0A

#: Fixed values of the base rules: symbols, words of a repeated run, least words, most repeated words of a hundred.
SYMBOLS = b"#*$%&|<>"
RUN, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

FEATURES = (
    "bias", "up to 2 words", "3 to 7 words", "log of words", "symbols per word", "other marks per word", "capital letters", "digits",
    "ends a sentence", "starts with a capital", "exclamation marks per word", "same line elsewhere", "repeated runs", "long words", "address",
)
CONTENT, BOILERPLATE, UNKNOWN = 1, 0, -1


def _table_of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters)] = 1
    return table


_LEADS = np.array([1 if b & 0xC0 != 0x80 else 0 for b in range(256)])
_SYMBOL, _DIGIT, _UPPER = _table_of(SYMBOLS), _table_of(b"0123456789"), _table_of(bytes(range(65, 91)))
_LETTER = _UPPER + _table_of(bytes(range(97, 123))) + (np.arange(256) >= 128) * _LEADS
_MARK = _table_of(b"=@[]{}\\^_`~/+|:;")
_LOUD = _table_of(b"!")
_STOPS = np.isin(np.arange(256), list(b".!?"))


def _between(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of a table's values over each stretch of bytes."""
    sums = np.concatenate([[0], np.cumsum(table[data])])
    return sums[end] - sums[start]


def _again(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal key under the same owner: an earlier one, any other one."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return later, any_


@dataclass
class Lines:
    """Lines with a word of a batch of texts, in order, and counts of the texts."""

    text: np.ndarray
    words: np.ndarray
    features: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def lines_of(texts: pa.Array) -> Lines:
    """Lines, their features and the base counts of texts; null counts as empty."""
    n = len(texts)
    data, offsets = data_of(texts)
    word, owner, start, end = words_of(texts, _WORDS)
    line, of_text, first, last = words_of(texts, _LINES)
    count = lambda who, weights=None: np.bincount(who, weights, minlength=n).astype(np.int64)

    # Words in runs of five that occur again in the same text.
    repeats = np.zeros(len(word) + 1, np.int64)
    if len(word) >= RUN:
        whole = np.flatnonzero(owner[: len(word) - RUN + 1] == owner[RUN - 1 :])
        run, _ = shingles_of(word, np.zeros(len(word), np.int64), RUN, 1)
        found = whole[_again(owner[whole], run[whole])[1]]
        np.add.at(repeats, found, 1)
        np.add.at(repeats, found + RUN, -1)
    repeated = (np.cumsum(repeats[:-1]) > 0).astype(np.int64)

    # Every word stands in one line; lines without a word are left out.
    at = np.searchsorted(first, start, "right") - 1
    in_line = np.bincount(at, minlength=len(line))
    some = in_line > 0
    again = _again(of_text[some], line[some])
    line_words, text, first, last = in_line[some], of_text[some], first[some], last[some]
    begins = np.concatenate([[0], np.cumsum(line_words)]).astype(np.int64)
    over_words = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[begins])
    chars = _between(_LEADS, data, start, end) if len(word) else np.zeros(0, np.int64)
    spans = lambda table: _between(table, data, first, last)
    opening, closing = start[begins[:-1]], end[begins[1:] - 1] - 1
    letters = np.maximum(spans(_LETTER), 1)
    w = np.maximum(line_words, 1)
    columns = [
        np.ones(len(text)),
        line_words < 3,
        (line_words >= 3) & (line_words < 8),
        np.log1p(line_words) / 4,
        np.minimum(spans(_SYMBOL) / w, 2),
        np.minimum(spans(_MARK) / w, 2),
        spans(_UPPER) / letters,
        spans(_DIGIT) / np.maximum(over_words(chars), 1),
        _STOPS[data[closing]],
        (_UPPER[data[opening]] > 0) | (data[opening] >= 128),
        np.minimum(spans(_LOUD) / w, 1),
        again[1],
        over_words(repeated) / w,
        over_words(chars > 20) / w,
        np.minimum(spans(_table_of(b"@")) / w, 1),
    ]
    return Lines(
        text, line_words, np.stack([np.asarray(c, float) for c in columns], 1) if len(text) else np.zeros((0, len(FEATURES))),
        count(owner), count(owner, chars), np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]).astype(np.int64),
        count(text, again[0]), count(owner, repeated),
    )


def seeds_of(features: np.ndarray) -> np.ndarray:
    """Labels of the lines that plain rules are sure of, unknown for the others."""
    f = dict(zip(FEATURES, features.T))
    short = (f["up to 2 words"] + f["3 to 7 words"]) > 0
    clean = (f["symbols per word"] < 0.05) & (f["capital letters"] < 0.3) & (f["exclamation marks per word"] < 0.2) & (f["repeated runs"] < 0.1)
    content = ~short & clean & (f["ends a sentence"] > 0) & (f["same line elsewhere"] == 0)
    loud = ~short & ((f["capital letters"] > 0.7) | (f["exclamation marks per word"] > 0.5))
    bad = (f["symbols per word"] > 0.3) | loud | (f["repeated runs"] > 0.5) | ((f["same line elsewhere"] > 0) & short)
    return np.where(bad, BOILERPLATE, np.where(content, CONTENT, UNKNOWN))


@dataclass(frozen=True)
class Field:
    """Weights of a line's features for content against boilerplate, and scores of the first label and of two in a row."""

    weights: np.ndarray
    first: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Best labels of the lines of each text; of equally good sequences the one with content last."""
        gain = (features @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.step.tolist()
        first_b, first_c = self.first.tolist()
        texts = text.tolist()
        back: list[tuple[int, int]] = []
        ends: list[tuple[int, int]] = []  # number of lines so far, best last label
        b = c = 0.0
        for k, g in enumerate(gain):
            if k == 0 or texts[k] != texts[k - 1]:
                if k:
                    ends.append((k, int(c >= b)))
                b, c = first_b, first_c + g
                back.append((0, 0))
            else:
                stay_b, from_c = b + bb, c + cb
                from_b, stay_c = b + bc, c + cc
                back.append((int(from_c >= stay_b), int(stay_c >= from_b)))
                b, c = max(stay_b, from_c), max(from_b, stay_c) + g
        if gain:
            ends.append((len(gain), int(c >= b)))
        labels = np.zeros(len(gain), np.int8)
        start = 0
        for end, label in ends:
            for k in range(end - 1, start - 1, -1):
                labels[k] = label
                label = back[k][label]
            start = end
        return labels


def _expected(score: np.ndarray, size: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward and backward sums over all sequences (line, sequence, label): log of their weight, how likely each label of
    a line is, and how often each two labels follow each other."""
    length = len(score)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[0] = first + score[0]
    for k in range(1, length):
        before, on = forward[k - 1], k < size
        for label in (BOILERPLATE, CONTENT):
            moved = np.logaddexp(before[:, 0] + step[0, label], before[:, 1] + step[1, label]) + score[k, :, label]
            forward[k, :, label] = np.where(on, moved, before[:, label])
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    for k in range(length - 2, -1, -1):
        behind, on = score[k + 1] + backward[k + 1], k + 1 < size
        for label in (BOILERPLATE, CONTENT):
            moved = np.logaddexp(step[label, 0] + behind[:, 0], step[label, 1] + behind[:, 1])
            backward[k, :, label] = np.where(on, moved, 0)
    inside = np.arange(length)[:, None] < size
    single = np.exp(forward + backward - total[:, None]) * inside[:, :, None]
    behind = score[1:] + backward[1:]
    double = np.array([[(np.exp(forward[:-1, :, a] + step[a, b] + behind[:, :, b] - total) * inside[1:]).sum() for b in (0, 1)] for a in (0, 1)])
    return total, single, double


def train(features: list[np.ndarray], seeds: list[np.ndarray], rounds: int = 150, rate: float = 0.3, decay: float = 0.001) -> Field:
    """Field that makes the marked labels of the sequences likely; unknown ones are summed out. Without any: all content."""
    n_features = len(FEATURES)
    kept = [k for k, s in enumerate(seeds) if len(s) and (s != UNKNOWN).any()]
    if not kept:
        return Field(np.zeros(n_features), np.zeros(2), np.zeros((2, 2)))
    size = np.array([len(seeds[k]) for k in kept])
    x = np.zeros((size.max(), len(kept), n_features))
    allowed = np.zeros((size.max(), len(kept), 2))
    for row, k in enumerate(kept):
        x[: size[row], row] = features[k]
        for label in (BOILERPLATE, CONTENT):
            allowed[: size[row], row, label][(seeds[k] != UNKNOWN) & (seeds[k] != label)] = -1e9
    theta = np.zeros(n_features + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        weights, first, step = theta[:n_features], theta[n_features : n_features + 2], theta[n_features + 2 :].reshape(2, 2)
        score = np.zeros(x.shape[:2] + (2,))
        score[:, :, CONTENT] = x @ weights
        _, free, free_steps = _expected(score, size, first, step)
        _, told, told_steps = _expected(score + allowed, size, first, step)
        slope = np.concatenate([
            np.tensordot((told - free)[:, :, CONTENT], x, ((0, 1), (0, 1))), (told - free)[0].sum(0), (told_steps - free_steps).ravel(),
        ]) / len(kept) - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[:n_features], theta[n_features : n_features + 2], theta[n_features + 2 :].reshape(2, 2))


def _sampled(lines: int):
    """Features and seeds of up to ``lines`` neighbouring lines of each text, from a line that its hash picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = lines_of(batch.column(0))
            bounds = np.searchsorted(found.text, np.arange(batch.num_rows + 1))
            seeds = seeds_of(found.features)
            keys = np.asarray(batch.column(1))
            kept, features, labels = [], [], []
            for k in range(batch.num_rows):
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    a += int(mix(keys[k : k + 1].astype(np.uint64))[0] % np.uint64(max(1, b - a - lines + 1)))
                    b = min(b, a + lines)
                    kept.append(int(keys[k]))
                    features.append(found.features[a:b].ravel())
                    labels.append(seeds[a:b])
            columns = [pa.array(kept, pa.int64()), pa.array(features, pa.list_(pa.float64())), pa.array(labels, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "features", "seeds"])

    return run


def fit(docs: DataFrame, sample: int = 800, lines: int = 64, seed: int = 0, text: str = "text") -> Field:
    """Field trained on up to ``lines`` neighbouring lines of each of about ``sample`` different texts, drawn by a hash of the
    text: a text counts once however often it occurs, and the driver gets so many lines at most."""
    n = docs.select(F.approx_count_distinct(F.xxhash64(text)).alias("n")).first()["n"]
    key = F.xxhash64(F.col(text), F.lit(seed))
    share = min(1.0, 1.2 * sample / max(1, n))
    drawn = docs.select(F.col(text).alias("t"), key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = map_batches(drawn, _sampled(lines), "key bigint, features array<double>, seeds array<bigint>")
    told = rows.dropDuplicates(["key"]).orderBy("key").limit(sample).collect()
    return train([np.array(r["features"]).reshape(-1, len(FEATURES)) for r in told], [np.array(r["seeds"]) for r in told])


_JUDGED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, content_lines array<int>, kept boolean"


def _judge(field: Field, least: float):
    names = [part.split(" ")[0] for part in _JUDGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = lines_of(batch.column(0))
            labels = field.decode(found.features, found.text)
            of_content = np.bincount(found.text, found.words * labels, minlength=n)
            share = of_content / np.maximum(found.n_words, 1)
            bounds = np.searchsorted(found.text, np.arange(n + 1))
            content = [np.flatnonzero(labels[a:b]).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
            counts = [pa.array(c) for c in (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words)]
            kept = ~found.base_failed & (share >= least)
            made = [*counts, pa.array(found.base_failed), pa.array(share), pa.array(content, pa.list_(pa.int32())), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *names])

    return run


def judge(docs: DataFrame, field: Field, least_content: float = 0.5, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``carry`` (all but the text) with counts, verdict of the base rules, share of words in content lines, the
    numbers of these lines (among lines with a word, from 0) and ``kept``.

    Base rules: under ten words, or over a fifth of the words in runs of five that occur again in the text. What passes them
    is kept if ``least_content`` of its words at least are in content lines. Null text is empty: no words, not kept. A carried
    column that has the name of a result gives way to it. Repeated rows are judged one by one.
    """
    names = [part.split(" ")[0] for part in _JUDGED.split(", ")]
    carried = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text]) if c not in names]
    rows = docs.select(F.col(text).cast("string").alias("_text_of_lines"), *[F.col(f"`{c}`") for c in carried])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_batches(rows, _judge(field, least_content), f"{kinds}, {_JUDGED}" if kinds else _JUDGED)
