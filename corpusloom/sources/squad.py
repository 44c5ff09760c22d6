"""Question-answering JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json_ranges import DEPTH, objects, ranges
from ..operators.indexing import Indexed, dense_index
from ..session import written

_ARTICLE = (
    "paragraphs array<struct<context: string, qas: array<struct<id: string, question: string,"
    " answers: array<struct<text: string, answer_start: int>>>>>>"
)
QA_SCHEMA = f"data array<struct<{_ARTICLE.replace(' ', ': ', 1)}>>"
ARTICLE_SCHEMA = _ARTICLE


#: Blocks behind the first of their file whose states are broadcast; a row has about 100 bytes.
BROADCAST_BLOCKS = 200_000


def read_qa_examples(
    spark: SparkSession, path: str | list[str], articles_per_line: bool = False, whole_files: bool = False
) -> Indexed:
    """Flat examples, numbered from 0 in file order as ``ex_idx``.

    The usual layout is one JSON object per file, which is split between tasks (:func:`split_objects`); with ``whole_files``
    a file is parsed by one task. ``articles_per_line``: every line is an article.
    """
    if articles_per_line:
        raw = spark.read.schema(ARTICLE_SCHEMA).json(path)
        articles = raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("article"),
            "paragraphs",
        )
    elif whole_files:
        raw = spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)
        articles = raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.posexplode("data").alias("article", "a"),
        ).select("file", "block", "article", "a.paragraphs")
    else:
        told = split_objects(spark, path).withColumn("a", F.from_json("text", ARTICLE_SCHEMA))
        articles = told.select("file", F.lit(0).cast("bigint").alias("block"), F.col("number").alias("article"), "a.paragraphs")
    return dense_examples(flatten_articles(articles))


def _block_states(fragments: DataFrame) -> DataFrame:
    """``file, block, inside, depth, opened``: for each block whether a string is open at its start, how deep it starts, and how
    many objects at the wanted depth open before it.

    A block's part in this is a few numbers for either case of the string; windows over one row per block put them together.
    """
    schema = "file string, block bigint, inside boolean, ends_inside boolean, deeper int, opened map<int,bigint>"
    told = written(fragments.mapInArrow(ranges, schema), "json_ranges")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # A block turns the case around or it doesn't, whichever case it starts with.
    turns = told.where("not inside").select("file", "block", F.col("ends_inside").cast("int").alias("turn"))
    cases = turns.select("file", "block", (F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    real = told.join(cases, ["file", "block", "inside"])
    deep = real.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)).cast("int"))
    here = F.coalesce(F.try_element_at("opened", F.lit(DEPTH) - F.col("depth")), F.lit(0))
    return deep.select("file", "block", "inside", "depth", F.coalesce(F.sum(here).over(before), F.lit(0)).alias("opened"))


def split_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, number, text``: the objects in the list that a file's one JSON object holds, whatever the size of the file.

    Files are read as text that is cut at closing braces, so every block of a file is a task of its own. A first pass tells the
    state at the start of each block; in the second each task puts its objects together. What lies across a block's end is
    put together by a shuffle: two parts of each block at most. ``number`` grows along the file.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    fragments = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    states = written(_block_states(fragments), "json_states")
    later = states.where("block > 0")
    n = later.count()
    if n <= BROADCAST_BLOCKS:
        joined = fragments.join(F.broadcast(later), ["file", "block"], "left")
    else:
        placed = fragments.withColumn("row", F.monotonically_increasing_id())
        joined = placed.join(later, ["file", "block"], "left").sortWithinPartitions("file", "block", "row")
    start = {"inside": F.lit(False), "depth": F.lit(0), "opened": F.lit(0).cast("bigint")}
    known = joined.select("value", "file", "block", *[F.coalesce(F.col(c), default).alias(c) for c, default in start.items()])
    found = known.mapInArrow(objects, "file string, number bigint, block bigint, whole boolean, text string")
    found = written(found, "json_objects")
    parts = found.where("not whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    across = parts.select("file", "number", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return found.where("whole").select("file", "number", "text").unionByName(across)


def flatten_articles(articles: DataFrame) -> DataFrame:
    """Articles to questions, with the place of each question."""
    paras = articles.select("file", "block", "article", F.posexplode("paragraphs").alias("para", "p"))
    asked = paras.select("file", "block", "article", "para", "p.context", F.posexplode("p.qas").alias("qa", "q"))
    return asked.select(
        "file",
        "block",
        "article",
        "para",
        "qa",
        F.col("q.id").alias("qid"),
        "q.question",
        "context",
        F.coalesce(F.transform("q.answers", lambda a: a["text"]), F.array().cast("array<string>")).alias("answers"),
        F.get("q.answers", F.lit(0))["answer_start"].alias("answer_start"),
    )


def dense_examples(flat: DataFrame) -> Indexed:
    place = ("file", "block", "article", "para", "qa")
    numbered = dense_index(flat, place)
    return Indexed(numbered.rows.withColumnRenamed("idx", "ex_idx").drop(*place), numbered.counts)


def first_examples(examples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` examples in file order; ``n <= 0`` means all."""
    return examples if n <= 0 else examples.filter(F.col("ex_idx") < n)
