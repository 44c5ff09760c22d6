"""Dense row numbers without a window over everything."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..session import scratch_path

_PART = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?\.[^/]*$")
_ROWS_PER_BUCKET = 200_000


@dataclass(frozen=True)
class Indexed:
    """Rows with a dense ``idx`` from 0, and the number of rows of each group (``None``: one group)."""

    rows: DataFrame
    counts: dict[str | None, int]

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def size_of_group(self, group: Column | None) -> Column:
        """Row count of the group named in a column, as an expression."""
        if group is None:
            return F.lit(self.total).cast("bigint")
        size = F.lit(None).cast("bigint")
        for name, n in self.counts.items():
            size = F.when(group == name, F.lit(n).cast("bigint")).otherwise(size)
        return size


def _file_order(path: str) -> tuple[int, int, str]:
    found = _PART.search(path)
    return (int(found[1]), int(found[2] or 0), path) if found else (0, 0, path)


def dense_index(df: DataFrame, order: tuple[str, ...], group: str | None = None, path: str | None = None) -> Indexed:
    """Rows numbered in ``order``, within each value of ``group`` (a column of few values, such as a split).

    The rows are range-partitioned on the whole unique key, which no single hot value can unbalance, and written once in
    that order. A row's number is then its row number inside its file plus the rows of the files before it: no second
    shuffle, and nothing that a retry could renumber. The driver sees one count per file.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "indexed")
    keys = ([group] if group else []) + list(order)
    # A fixed number keeps small tables spread over all cores, which merged partitions would not be.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(group) if group else writer).parquet(path)
    return read_indexed(spark, path, df, group)


def read_indexed(spark: SparkSession, path: str, like: DataFrame, group: str | None = None) -> Indexed:
    """Number the rows of a table that was written in order."""
    stored = spark.read.schema(like.schema).parquet(path)
    file = F.col("_metadata.file_path")
    per_file = stored.groupBy(file.alias("file"), *([group] if group else [])).count().collect()
    offsets, counts = [], {}
    for row in sorted(per_file, key=lambda r: _file_order(r["file"])):
        name = row[group] if group else None
        offsets.append((row["file"], counts.get(name, 0)))
        counts[name] = counts.get(name, 0) + row["count"]
    if not offsets:
        return Indexed(like.limit(0).withColumn("idx", F.lit(0).cast("bigint")), {})
    starts = spark.createDataFrame(offsets, "file string, first bigint")
    rows = stored.withColumn("file", file).withColumn("in_file", F.col("_metadata.row_index")).join(starts, "file")
    idx = (F.col("first") + F.col("in_file")).alias("idx")
    return Indexed(rows.select(*like.columns, idx), counts)


def shuffled_rank(df: DataFrame, n: int, *key: Column | str | int, name: str = "rank") -> DataFrame:
    """Adds the dense rank of each row in the order of a hash of its unique key.

    Hashes are uniform whatever the data, so their leading digits cut the rows into even buckets; each bucket is numbered on
    its own and starts where the counts of the earlier ones end. There are 256 buckets at least, and so many that one holds
    about 200,000 rows at most; only their counts meet in one task.
    """
    digits = 2
    while n > _ROWS_PER_BUCKET * 16**digits:
        digits += 1
    drawn = df.withColumn("_h", digest(*key)).withColumn("_b", F.substring("_h", 1, digits))
    counts = drawn.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", *[k for k in key if isinstance(k, Column)])) - 1
    ranked = drawn.withColumn("_in", inside).join(starts, "_b")
    return ranked.withColumn(name, F.col("_first") + F.col("_in")).drop("_h", "_b", "_n", "_in", "_first")
