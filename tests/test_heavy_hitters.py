import random
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.functions.heavy_hitters import summaries
from corpusloom.operators import bpe


@pytest.mark.parametrize("one_in", [2, 5, 40])
def test_no_frequent_piece_is_missed(spark, one_in):
    draw = random.Random(one_in)
    texts = [" ".join(draw.choice("abcdef") if draw.random() < 0.4 else f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    texts = sorted(texts) + ["", None, "zz " * 900]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r["piece"]: r["freq"] for r in bpe.frequent_pieces(rows, one_in).collect()}
    every = {r["piece"]: r["freq"] for r in bpe.piece_frequencies(rows).collect()}
    total = sum(every.values())
    assert got == {p: n for p, n in every.items() if n * one_in >= total}
    assert bpe.frequent_pieces(rows.limit(0), one_in).count() == 0


def test_counters_bound_counts_from_both_sides():
    draw = random.Random(1)
    values = [[f"v{int(draw.paretovariate(0.6))}" for _ in range(50)] for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[k : k + 10], pa.list_(pa.string()))], names=["p"]) for k in range(0, 200, 10)]
    (told,) = summaries(20)(iter(batches))
    rows = told.to_pylist()
    lost, total = (next(r["n"] for r in rows if r["kind"] == kind) for kind in ("lost", "total"))
    least = {r["value"]: r["n"] for r in rows if r["kind"] == "value"}
    true = Counter(v for part in values for v in part)
    assert total == 10_000 and 0 < lost <= total / 21 and len(least) <= 40
    assert all(least.get(v, 0) <= n <= least.get(v, 0) + lost for v, n in true.items())
