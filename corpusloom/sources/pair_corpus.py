"""The tab-separated pair corpus: writing it, and the two ways it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.corpus import PAIR_KEY
from ..operators.indexing import Indexed, dense_index


def write_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Replace the pair table at ``path``, one folder per split; returns the counts per split read back from it."""
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)
    stored = pairs.sparkSession.read.schema(pairs.schema).parquet(path)
    return stored.groupBy("split").agg(F.count("*").alias("n_pairs"))


def index_pairs(pairs: DataFrame, path: str | None = None) -> Indexed:
    """Write routed pairs in corpus order and number them from 0 within each split."""
    indexed = dense_index(pairs, PAIR_KEY, group="split", path=path)
    if not indexed.counts:
        raise ValueError("no valid sentence pairs")
    return indexed


def write_pair_text(pairs: DataFrame, path: str) -> None:
    """Replace the text files at ``path``: one ``s1 TAB s2`` line per pair."""
    pairs.select(F.concat_ws("\t", "s1", "s2")).write.mode("overwrite").option("lineSep", "\n").text(path)


def parse_pair_line(line: Column) -> Column:
    """``struct(s1, s2)`` of a valid line, null otherwise.

    The line is stripped before it is cut, so a trailing tab invalidates it and a leading one is ignored; further fields
    are ignored; lines that are not UTF-8 are skipped.
    """
    fields = F.split(strip(line), "\t")
    s1, s2 = strip(F.get(fields, F.lit(0))), strip(F.get(fields, F.lit(1)))
    return F.when(F.is_valid_utf8(line) & (s1 != "") & (s2 != ""), F.struct(s1.alias("s1"), s2.alias("s2")))


def read_pair_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Valid pairs with the place of their line: ``file, block, line, s1, s2``. Only a line feed ends a line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        parse_pair_line(F.col("value")).alias("pair"),
    )
    return placed.filter(F.col("pair").isNotNull()).select("file", "block", "line", "pair.s1", "pair.s2")


def index_pair_corpus(spark: SparkSession, path: str | list[str]) -> Indexed:
    """Valid pairs of text files numbered from 0 in line order; an empty corpus is an error."""
    indexed = dense_index(read_pair_corpus(spark, path), ("file", "block", "line"))
    if not indexed.total:
        raise ValueError("no valid sentence pairs")
    return indexed


def read_training_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Both halves of each line as rows of ``text``, for vocabulary training.

    A line is cut at its first tab; a line without one is a single half; empty halves are left out. A lone carriage return
    ends a line here. Text that is not UTF-8 fails the job.
    """
    value = F.col("value")
    checked = F.when(F.is_valid_utf8(value), value).otherwise(
        F.raise_error(F.lit("training text is not valid UTF-8")).cast("string")
    )
    halves = spark.read.text(paths).select(F.explode_outer(F.split(checked, "\t", 2)).alias("text"))
    return halves.filter(F.col("text") != "")


def training_text(pairs: DataFrame) -> DataFrame:
    """Both sentences of each pair as rows of ``text``."""
    return pairs.select(F.explode_outer(F.array("s1", "s2")).alias("text"))
