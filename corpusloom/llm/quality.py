"""Quality of texts by attention over their passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import labelled_sample, map_batches
from .words import SPACED, data_of, words_of

#: Words of a passage; labelled rows of each class that the model is fitted on (about; by a hash of the id), and passages of
#: a fitted document, spread evenly over it.
PASSAGE, SAMPLE, PASSAGES = 64, 3000, 64
#: Size of an encoded passage and of the attention's inner layer; steps and rate of the fit.
HIDDEN, INNER, STEPS, RATE = 16, 8, 250, 0.03

#: Classes of bytes whose shares describe a passage. Fixed order; the last is whatever the others leave.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\n\r",
    b".,;:",
    b"!?",
    b"'\"()-",
    b"*#%&$@^~",
    b"|<>{}[]=+/\\_`",
    bytes(range(0x80, 0x100)),
]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _number, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _number
N_BYTES = len(_CLASSES) + 1
#: Shares of the byte classes; length of a word; share of words equal to the one before, of repeated words, of one-byte
#: words, of words that end in a symbol, of words all in capitals; number of words.
FEATURES = N_BYTES + 7


def passages_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (64 words in a row) and the text it is of; a text without words is one passage of zeros."""
    n = len(texts)
    data, _ = data_of(texts)
    hashes, text, start, end = words_of(texts, SPACED)
    first = np.searchsorted(text, np.arange(n + 1))
    in_text = np.arange(len(text)) - first[text]
    heads = np.flatnonzero(in_text % PASSAGE == 0)
    owner = text[heads]
    if not len(heads):
        return np.zeros((n, FEATURES)), np.arange(n)
    size = np.diff(np.append(heads, len(text)))
    out = np.zeros((len(heads), FEATURES))
    begins, ends = start[heads], end[heads + size - 1]
    kinds = _CLASS[data]
    spans = np.maximum(1, ends - begins)
    for k in range(N_BYTES):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        out[:, k] = (sums[ends] - sums[begins]) / spans
    passage = np.repeat(np.arange(len(heads)), size)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
    order = np.lexsort((hashes, passage))
    repeated = np.append(False, (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1]))
    length = end - start
    last, head = kinds[end - 1], kinds[start]
    columns = (length / 10.0, again, repeated[np.argsort(order)], length == 1, np.isin(last, (6, 8, 9)), (head == 1) & (last != 0) & (length > 1))
    for k, column in enumerate(columns):
        out[:, N_BYTES + k] = np.add.reduceat(np.asarray(column, float), heads) / size
    out[:, N_BYTES + 6] = np.log1p(size) / np.log1p(PASSAGE)
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(empty):
        out, owner = np.concatenate([out, np.zeros((len(empty), FEATURES))]), np.concatenate([owner, empty])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


@dataclass
class Attention:
    """Gated attention: passages are encoded, weighted by what two inner layers make of them, summed and scored."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(x: np.ndarray, seed: int = 5) -> Attention:
        draw = np.random.default_rng(seed).normal
        scale = x.std(0)
        weights = {
            "E": draw(0, 0.3, (FEATURES, HIDDEN)),
            "e": np.zeros(HIDDEN),
            "V": draw(0, 0.3, (HIDDEN, INNER)),
            "U": draw(0, 0.3, (HIDDEN, INNER)),
            "w": draw(0, 0.3, INNER),
            "c": draw(0, 0.3, HIDDEN),
            "b": np.zeros(1),
        }
        return Attention(x.mean(0), np.where(scale > 1e-6, scale, 1.0), weights)

    def forward(self, x: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
        """``heads``: where each document's passages begin, none empty."""
        p = self.weights
        size = np.diff(np.append(heads, len(x)))
        own = np.repeat(np.arange(len(heads)), size)
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = (v * u) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, heads)[own])
        a = s / np.add.reduceat(s, heads)[own]
        z = np.add.reduceat(a[:, None] * h, heads)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"own": own, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y}

    def slopes(self, x: np.ndarray, heads: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted cross-entropy."""
        p, f = self.weights, self.forward(x, heads)
        own, h, v, u, a = f["own"], f["h"], f["v"], f["u"], f["a"]
        d = weight * (f["y"] - label)
        out = {"b": np.array([d.sum()]), "c": f["z"].T @ d}
        dz = (d[:, None] * p["c"])[own]
        da = (dz * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, heads)[own])
        out["w"] = (v * u).T @ ds
        inner = ds[:, None] * p["w"]
        dv, du = inner * u * (1 - v**2), inner * v * u * (1 - u)
        out["V"], out["U"] = h.T @ dv, h.T @ du
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        out["E"], out["e"] = np.clip((x - self.mean) / self.scale, -8, 8).T @ dh, dh.sum(0)
        return out

    def train(self, x: np.ndarray, heads: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Attention:
        """Descent with running means of slopes and of their squares, over all documents at each step."""
        one = {k: np.zeros_like(w) for k, w in self.weights.items()}
        two = {k: np.zeros_like(w) for k, w in self.weights.items()}
        weight = weight / weight.sum()
        for t in range(1, steps + 1):
            for k, g in self.slopes(x, heads, label, weight).items():
                g = g + 1e-4 * self.weights[k]
                one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g**2
                self.weights[k] = self.weights[k] - RATE * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bags(passages: int) -> Callable:
    """Task function: (id, label, text) to the features of at most ``passages`` passages of each text, spread evenly."""

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x, owner = passages_of(batch.column(2))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            bags = []
            for i in range(batch.num_rows):
                own = x[cuts[i] : cuts[i + 1]]
                if len(own) > passages:
                    own = own[np.linspace(0, len(own) - 1, passages).astype(int)]
                bags.append(own.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["id", "label", "bag"])

    return bags_of


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS, passages: int = PASSAGES) -> Attention | float:
    """Learns from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` 0 or 1).

    About ``sample`` rows of each class are drawn by a hash of the id, weighted back to the share of their class; the driver
    receives at most ``passages`` passages of each, of 19 numbers. Rows without label teach nothing, null texts count as empty.
    Without both classes there is nothing to learn: the share of label 1 is returned, 0.5 for no rows.
    """
    drawn, sizes = labelled_sample(docs, labels, sample, 5)
    if len(sizes) < 2:
        return float(next(iter(sizes))) if sizes else 0.5
    rows = sorted(map_batches(drawn, _bags(passages), "id long, label int, bag binary").collect(), key=lambda r: (r["id"], r["label"], bytes(r["bag"])))
    label = np.array([r["label"] for r in rows], float)
    if len(set(label.tolist())) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(float) for r in rows]
    x = np.concatenate(bags)
    heads = np.cumsum([0, *(len(b) for b in bags)])[:-1]
    weight = np.where(label == 1, sizes[1] / label.sum(), sizes[0] / (len(label) - label.sum()))
    return Attention.start(x).train(x, heads, label, weight, steps)


def _scorer(shared, carried: int, schema: pa.Schema) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _sliced(batches):
            n = batch.num_rows
            if isinstance(model, float):
                scores, passage, weight = np.full(n, model), np.zeros(n, np.int64), np.ones(n)
            else:
                x, owner = passages_of(batch.column(carried))
                heads = np.searchsorted(owner, np.arange(n))
                told = model.forward(x, heads)
                scores = told["y"]
                weight = np.maximum.reduceat(told["a"], heads)
                top = np.flatnonzero(told["a"] == weight[owner])
                passage = top[np.searchsorted(owner[top], np.arange(n))] - heads
            kept = [batch.column(c) for c in range(len(schema) - 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(passage), pa.array(weight)], schema=schema)

    return score


def score(docs: DataFrame, model: Attention | float, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``carry``, all by default) with ``score``, ``passage`` and ``attention``.

    ``score`` (0 to 1) is the probability of label 1 from all passages of the whole text; ``passage`` is the number of the
    one with the largest weight, ``attention`` that weight. A null or empty text, or one without words, is one passage of
    zeros. Rows may repeat; a column that is called like an added one gives way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "passage", "attention")]
    kept = [c for c in carry if c != "text"]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], "text")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if "text" in carry or f.name != "text")
    schema = f"{fields}score double, passage long, attention double"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = map_batches(rows, _scorer(shared, len(kept), arrow), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"c{kept.index(c)}").alias(c) for c in carry], "score", "passage", "attention")
