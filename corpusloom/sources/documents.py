"""Document scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents up to which the first ones are sorted out by every task, and ranges of ids that are counted at once.
SMALL, BUCKETS = 256, 1_000


def scan_documents(spark: SparkSession, path: str, source: str, id_column: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """``source, doc_id, text`` of a Parquet table; a missing text is empty. Only the two columns are read.

    The splits of the files stay as they are. ``partitions`` deals the rows anew, for a file of one row group.
    """
    docs = spark.read.parquet(path).select(
        F.lit(source).alias("source"),
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return docs.repartition(partitions, "doc_id") if partitions else docs


def take_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by id; a negative ``n`` means all. Of rows that repeat the last id some stay, ``n`` in all.

    Up to ``SMALL`` documents, each task keeps its own first ``n`` before they meet. For more, the id of the last one is found
    by counting ids, and the documents are filtered where they are: no text is moved. Rows without an id come first.
    """
    if n < 0 or (0 <= n <= SMALL):
        return docs if n < 0 else docs.orderBy("doc_id").limit(n)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"))
    low, high, total, known = ids.agg(F.min("id"), F.max("id"), F.count("*"), F.count("id")).first()
    if n >= total:
        return docs
    nulls = total - known
    if n <= nulls:
        return docs.where("doc_id is null").limit(n)
    last, left, rows = _nth_id(ids, n - nulls, low, high)
    if left == rows:
        return docs.where(F.col("doc_id").isNull() | (F.col("doc_id") <= last))
    return docs.where(F.col("doc_id").isNull() | (F.col("doc_id") < last)).unionByName(docs.where(F.col("doc_id") == last).limit(left))


def _nth_id(ids: DataFrame, n: int, low: int, high: int) -> tuple[int, int, int]:
    """The ``n``-th smallest id, how many of its rows are among the first ``n``, and how many rows it has.

    Each round counts the ids of ``BUCKETS`` equal ranges and goes on with the one that holds the ``n``-th: a few rounds, each
    a pass over the ids that brings so many numbers to the driver.
    """
    while True:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.expr(f"cast((cast(id as decimal(20,0)) - {low}) div {width} as int)").alias("bucket")
        counts = ids.where(F.col("id").between(low, high)).groupBy(bucket).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["bucket"]):
            if n <= r["n"]:
                break
            n -= r["n"]
        low += r["bucket"] * width
        high = min(high, low + width - 1)
        if width == 1:
            return low, n, r["n"]


def concat_sources(*sources: DataFrame | None) -> DataFrame:
    """All documents of the sources that are switched on (``None``: skipped)."""
    wanted = [s for s in sources if s is not None]
    if not wanted:
        raise ValueError("every document source is skipped")
    return reduce(DataFrame.unionByName, wanted)
