"""Whitened vectors against one machine's eigenvectors of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest
from corpusloom.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, n int, component string"


def table(spark, vectors, partitions=3):
    rows = [(k, None if v is None else [None if e is None else float(e) for e in v], 1, "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, COLUMNS).repartition(partitions)


def expected(vectors, weights=None):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    fitted = x if weights is None else np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(0)
    z = (n * fitted - sums) / n
    values, vectors_ = np.linalg.eigh(z.T @ z / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    y = n * x - sums
    return n, (y**2).sum(1), (y / n) @ vectors_[:, :8] / np.sqrt(values[:8]), values / values.sum()


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_as_one_machine(spark, weights):
    draw = np.random.default_rng(1)
    vectors = (draw.normal(size=(200, 12)) * np.linspace(3, 0.5, 12)).tolist()
    vectors += [vectors[0]] * 80 + [vectors[1]] * 5  # a vector that holds a large share
    bad = [None, [], [float("nan")] * 12, [float("inf"), *[0.0] * 11], [None, *[0.0] * 11], [1.0] * 11]
    rows = whitening.whiten(table(spark, vectors + bad), fit_weights=weights).collect()
    n, deviation, white, share = expected(vectors, None if weights == "counts" else "one")
    assert len(rows) == 8 * len(vectors)
    assert {r["n"] for r in rows} == {n}
    got = np.zeros_like(white)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-12
        assert r["identity_error"] < 1e-10
    sign = np.sign((got * white).sum(0))
    assert np.abs(got - white * sign).max() < 1e-9


def test_few_dimensions_equal_vectors_and_no_rows(spark):
    flat = whitening.whiten(table(spark, [[1.0, 2.0]] * 4)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in flat] == [(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)] * 4
    line = whitening.whiten(table(spark, [[0.0, 0.0], [1.0, 1.0]])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in line) == [(0, 1, 1), (0, 2, 0), (1, 1, 1), (1, 2, 0)]
    nothing = whitening.whiten(table(spark, [[1.0]]).limit(0))
    assert nothing.collect() == [] and nothing.columns == line[0].__fields__


def test_a_repeated_id_has_rows_for_each_of_its_rows(spark):
    docs = table(spark, [[1.0, 0.5], [2.0, 0.0], [0.0, 3.0]])
    assert whitening.whiten(docs.unionByName(docs)).count() == 12


def test_exact_beyond_64_bits():
    x = np.array([[10**15, 3], [-(10**15), 4]])
    y = whitening.centred(x, 10**6, (5, 7))
    assert y.tolist() == [[10**21 - 5, 3 * 10**6 - 7], [-(10**21) - 5, 4 * 10**6 - 7]]
    assert whitening._deviations(y) == [None, None]
    assert whitening._deviations(np.array([[3 * 10**9, 1]])) == [9 * 10**18 + 1]


def test_entries_beyond_62_bits_count_as_that(spark):
    rows = whitening.whiten(table(spark, [[1e30], [0.0]])).collect()
    assert {r["n"] for r in rows} == {2} and all(r["deviation"] is None for r in rows)
    assert {round(abs(r["whitened"]), 9) for r in rows} == {1.0}


def test_sums_are_exact(spark):
    vectors = [[0.25 * k, -3.5] for k in range(50)]
    rows = spark.createDataFrame([(k, v, 1, "") for k, v in enumerate(vectors)], COLUMNS).selectExpr("vec_id as id", "embedding")
    found = whitening.distinct_vectors(rows.select("id", whitening.whole_numbers(rows["embedding"]).alias("x")))
    model = whitening.fit(found)
    x = [[int(1024 * e) + 100_000 for e in v] for v in vectors]
    assert model.sums == tuple(map(sum, zip(*x)))
    variance = sum(Fraction(50 * row[0] - model.sums[0], 50) ** 2 for row in x) / 50
    assert abs(model.trace - float(variance)) < 1e-9 * float(variance) and model.rank == 1
