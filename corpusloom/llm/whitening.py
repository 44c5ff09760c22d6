"""Whitening of embeddings by a covariance over distinct vectors, weighted by how often each occurs.

Vectors become whole numbers, equal ones are one row with a count, and all work on them is done once for each distinct
vector: sums, centring, the weighted product that is the covariance, and the projection. Rows are joined back by two hashes.
Only matrices of the size of the dimension meet: one for each task, and one on the driver, which finds its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import lookup, map_batches

#: Fixed values of the whole-number form: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """Rows of the fit list, per-dimension sums, eigenvalues and -vectors (columns) by falling eigenvalue, trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components that have a variance beyond rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return int((self.values > least).sum())


def whole_numbers(vector: Column) -> Column:
    """Entries as whole numbers, of 62 bits at most; null for a vector that is null or has null or non-finite entries."""
    bounded = lambda c: F.least(F.greatest(c * SCALE, F.lit(float(-_SAFE))), F.lit(float(_SAFE)))
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(entries, lambda c: F.floor(bounded(c)).cast("bigint") + SHIFT))


def _keys(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(SHIFT), x).alias("h2")]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``h1, h2, x, copies``: every distinct ``x``; vectors that lack entries which the longest have are left out."""
    found = rows.groupBy("x").agg(F.count("*").alias("copies"))
    found = written(found.select(*_keys(F.col("x")), "x", "copies"), "vectors")
    longest = found.agg(F.max(F.size("x"))).first()[0] or 0
    return found.where((F.size("x") == longest) & (F.size("x") > 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _sum_up(d: int):
    """Rows of the fit list and per-dimension sums of a task, as places -1, 0, 1, ...; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x, w = _matrix(batch.column(0), d), np.asarray(batch.column(1))
            if not len(x):
                continue
            n += int(w.sum())
            most = int(np.abs(x).max()) * int(w.sum())
            # Python's whole numbers where 64 bits would not do.
            part = (x * w[:, None]).sum(0) if most < _SAFE else (x.astype(object) * w.astype(object)[:, None]).sum(0)
            sums = [a + int(b) for a, b in zip(sums, part.tolist())]
        if n:
            places, values = list(range(-1, d)), [Decimal(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["place", "value"])

    return run


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums``, exact: whole numbers of 64 bits where they do, else Python's."""
    most = max(n * int(np.abs(x).max(initial=0)), *(abs(s) for s in sums))
    if most < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it is beyond 64 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * y.shape[1] < _SAFE:
        return (y.astype(np.int64) ** 2).sum(1).tolist()
    sums = (y.astype(object) ** 2).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in sums]


def _products(d: int, n: int, sums: tuple[int, ...]):
    """One weighted product of centred vectors per task, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, w = _matrix(batch.column(0), d), np.asarray(batch.column(1))
            if len(x):
                z = centred(x, n, sums).astype(float) / n
                part = (z * (w / n)[:, None]).T @ z
                total = part if total is None else total + part
        if total is not None:
            values = pa.ListArray.from_arrays(np.arange(0, d * d + 1, d, dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), values], names=["i", "products"])

    return run


def fit(vectors: DataFrame, fit_weights: str = "counts") -> Whitening:
    """Covariance and components of the distinct ``vectors`` (:func:`distinct_vectors`), divisor n, centred before multiplying.

    ``fit_weights``: ``counts``, a vector counts as often as it occurs, or ``one``. The driver gets a matrix of the size of
    the dimension. An empty table has n = 0 and no component.
    """
    weight = {"counts": F.col("copies"), "one": F.lit(1).cast("bigint")}[fit_weights].alias("w")
    rows = vectors.select("x", weight)
    first = rows.first()
    if first is None:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(first["x"])
    totals = map_batches(rows, _sum_up(d), "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    by_place = {r["place"]: int(r["value"]) for r in totals.collect()}
    n, sums = by_place[-1], tuple(by_place[k] for k in range(d))
    parts = map_batches(rows, _products(d, n, sums), "i int, products array<double>")
    entries = parts.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    covariance = np.zeros((d, d))
    for i, line in entries.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("line")).collect():
        covariance[i] = [v for _, v in line]
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    largest = vectors_[np.abs(vectors_).argmax(0), np.arange(d)]
    return Whitening(n, sums, values.copy(), vectors_ * np.where(largest < 0, -1.0, 1.0), float(np.trace(covariance)))


def _whiten(model: Whitening, k: int):
    d = len(model.sums)
    scale = np.zeros(k)
    scale[: min(k, model.rank)] = 1 / np.sqrt(model.values[: min(k, model.rank)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(_matrix(batch.column(2), d), model.n, model.sums)
            white = (y.astype(float) / model.n) @ model.vectors[:, :k] * scale
            made = pa.ListArray.from_arrays(np.arange(0, white.size + 1, k, dtype=np.int32), pa.array(white.ravel()))
            deviation = pa.array(_deviations(y), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), deviation, made], names=["h1", "h2", "copies", "deviation", "white"])

    return run


def identity_error(white: DataFrame, model: Whitening, k: int, fit_weights: str = "counts") -> float:
    """Largest entry of the covariance of whitened vectors minus the identity, over components that have a variance."""
    k = min(k, model.rank)
    weight = F.col("copies") if fit_weights == "counts" else F.lit(1)
    at = [F.col("white")[i] for i in range(k)]
    places = [(i, j) for i in range(k) for j in range(i, k)]
    if not places:
        return 0.0
    sums = white.agg(*[F.sum(weight * a) for a in at], *[F.sum(weight * at[i] * at[j]) for i, j in places]).first()
    mean = [s / model.n for s in sums[:k]]
    return max(abs(s / model.n - mean[i] * mean[j] - (i == j)) for s, (i, j) in zip(sums[k:], places))


def whiten(
    table: DataFrame, components: int = 8, fit_weights: str = "counts", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component, from 1.

    Rows whose vector is null or empty, has null or non-finite entries, or fewer entries than the longest, are left out; other
    columns are ignored; a repeated id has rows for each of its rows. ``deviation`` is the exact sum of squares of
    ``n * x - S``, null beyond 64 bits. ``whitened`` is 0 on a component without variance, as of equal vectors or of fewer
    vectors than dimensions. There are as many components as dimensions at most.
    """
    x = F.col("x")
    rows = table.select(F.col(id_column).alias("id"), whole_numbers(F.col(vector_column)).alias("x")).where("x is not null")
    vectors = distinct_vectors(rows)
    model = fit(vectors, fit_weights)
    k = min(components, len(model.sums))
    out = f"{id_column} component n deviation whitened explained identity_error".split()
    if not k:
        empty = table.select(F.col(id_column), *[F.lit(0).cast(t) for t in ("int", "bigint", "bigint", "double", "double", "double")])
        return empty.limit(0).toDF(*out)
    kind = "h1 bigint, h2 bigint, copies bigint, deviation bigint, white array<double>"
    white = written(map_batches(vectors.select("h1", "h2", "x", "copies"), _whiten(model, k), kind), "whitened")
    error = identity_error(white, model, k, fit_weights)
    told = lookup(rows.select("id", *_keys(x)), white, ["h1", "h2"], "copies", rows.count())
    share = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values[:k]])
    each = told.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
