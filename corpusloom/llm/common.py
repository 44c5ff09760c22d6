"""Helpers the operators share: joins that split hot keys, connected components, paths of written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A key with more than one in so many rows is hot, so there are never more hot keys than this.
HOT_SHARE = 1000


#: Bytes of an Arrow batch between Spark and its Python workers, and the setting's default, which is taken as not set.
BATCH_BYTES, _DEFAULT_BYTES, _BYTES_KEY = 4 << 20, 64 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of about 4 MB, where the session has no size of its own: texts vary in length, and a batch
    is held several times on its way."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES_KEY).rstrip("b") == str(_DEFAULT_BYTES):
        conf.set(_BYTES_KEY, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lookup(many: DataFrame, one: DataFrame, key: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``many`` with ``one``, whose rows are unique by ``key`` and count in ``n`` the rows of ``many`` they meet.

    Keys that hold more than a thousandth of ``total`` rows are at most a thousand, so those rows of ``one`` are broadcast
    and a hot key stays where its rows are; all other keys are joined by a shuffle. ``how``: inner or left; columns of
    ``one`` other than ``key`` and ``n`` must be few and narrow.
    """
    hot = one.where(F.col(n) * HOT_SHARE > total)
    cold = one.where(~(F.col(n) * HOT_SHARE > total) | F.col(n).isNull())
    in_hot = many.join(F.broadcast(hot), key)
    in_cold = many.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how)
    return in_cold.unionByName(in_hot)


def salted(pairs: DataFrame, key: str, other: str, rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """Thin ``pairs`` with a column ``<key>_salt``, and for each key how many copies of its wide row they then meet.

    A key met by more than ``rows`` rows needs so many copies, and ``other`` decides which copy a row meets: no task gets
    more than about ``rows`` rows of a key.
    """
    counts = written(pairs.groupBy(key).agg(F.count("*").alias("_n")), "counts")
    copies = F.ceil(F.col("_n") / rows).cast("int")
    told = lookup(pairs, counts, [key], "_n", pairs.count())
    return (
        told.withColumn(f"{key}_salt", F.pmod(F.xxhash64(other), copies).cast("int")).drop("_n"),
        counts.select(key, F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"{key}_salt")),
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b: long) as ``node, component``: the smallest node that can be reached.

    Large-star and small-star alternate until nothing changes. Large-star points the larger neighbours of a node to the
    smallest of its neighbourhood, small-star the smaller ones; both keep the components, and the number of rounds grows
    with the logarithm of the nodes. Every round is written, so a lost executor costs one round at most. Null ends and
    loops are left out; a node without links has no row.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * state[0]
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, least, ["u"], "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = lookup(large, least, ["u"], "n", total)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(heads.join(leaves.select("node"), "node", "left_anti"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two digests of them."""
    key = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(key), F.sum(key % (1 << 32))).first())


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` labelled rows of each class (``id, label, text``), and how many rows each class has.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1; other rows don't count, of repeated ids the larger label does). Rows are
    drawn by a hash of the id, so the drawn ids are bounded by the parameter and are broadcast: no text is shuffled.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").alias("id"), "label", "text")
    return rows, sizes


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``key`` of a partition sorted by it, each as one table."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(table[k]) for k in key]
        change = np.zeros(len(columns[0]), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for k in range(len(cuts) - 1):
            if k > 0 and rest:
                yield pa.concat_tables(rest)
                rest = []
            if cuts[k + 1] > cuts[k]:
                rest.append(table.slice(cuts[k], cuts[k + 1] - cuts[k]))
    if rest:
        yield pa.concat_tables(rest)
