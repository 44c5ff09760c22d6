"""Near copies of whole documents, and of passages inside documents, by MinHash bands and by anchored runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import passing_tables, written
from .anchors import CONTEXTS, anchors, contexts, lengthened, paragraphs
from .common import lookup, map_batches
from .near_groups import membership, near_classes

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
_SPACE = r"\x20\x09-\x0D"


def near_documents(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of near copies: per row ``doc_id, n_shingles, copies, class_id, component_id, kept, text_hash, high, low, head``.

    ``component_id`` is the smallest id reachable over links, ``kept`` says whether the document is that one. Null and empty
    texts, and texts without words, have no shingles and are linked with nothing. A row without id keeps a null component
    and is kept. Rows that repeat an id are judged by their own text: ``text_hash`` (``xxhash64`` of it) tells them apart,
    ``high`` and ``low`` are the digest of their shingles, and of the texts in a component that share its id ``head`` names
    the one that stands for it. Other columns of ``docs`` are not read.
    """
    items = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed, classes = near_classes(items, shingle_words, similarity)
    found = membership(signed, classes)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "copies",
        "class_id",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
        "text_hash",
        "high",
        "low",
        "head",
    )


def repeated_passages(
    docs: DataFrame, min_words: int = 25, shingle_words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """Text that repeats, within a document or across documents, with the place of the copy that stays.

    Paragraphs are lines of ``min_words`` words or more, and adjacent shorter lines joined (``anchors.paragraphs``). One row per
    paragraph of a group of near copies: ``doc_id, paragraph`` (first line), ``n_words, copies, group_doc, group_paragraph,
    removed, lines`` (those with words), with ``first_word`` null. Groups are the connected components of paragraphs whose sets of word runs have a
    Jaccard similarity of at least ``similarity``; the copy in the smallest document, there the first, stays.

    Then one row per repeated passage (``repeated_runs``) that is not all in removed paragraphs, with ``first_word``, its first
    word's number in the document, from 0, and ``lines`` null: these stand inside longer paragraphs or go over the ends of short ones. Null and
    empty texts and rows without an id have no row. Rows that repeat an id count as one document where they are equal;
    paragraphs that differ at one place of such rows are rows of their own. Paragraphs are told apart by a 64-bit hash of
    document, place and text.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with passing_tables(docs.sparkSession) as keep:
        whole = keep(written(repeated_paragraphs(docs, min_words, shingle_words, similarity), "paragraphs"))
    return whole.unionByName(repeated_runs(docs, whole, min_words))


def repeated_paragraphs(docs: DataFrame, min_words: int, shingle_words: int, similarity: tuple[int, int]) -> DataFrame:
    """The rows of ``repeated_passages`` for whole paragraphs."""
    # read three times below: texts are cut and words counted once
    places = written(paragraphs(docs, min_words).withColumn("id", F.xxhash64("doc_id", "paragraph", "text")), "all_paragraphs")
    signed, classes = near_classes(places.select("id", "text"), shingle_words, similarity, bands=20, rows=4)
    sizes = classes.groupBy("component").agg(F.sum("copies").alias("rows"), F.count("*").alias("n")).where("rows > 1")
    groups = written(lookup(classes, written(sizes, "group_sizes"), ["component"], "n", classes.count()).drop("n"), "groups_of_classes")
    found = lookup(signed.where("high is not null"), groups, ["high", "low"], "copies", signed.count())
    repeated = written(found.select("id", "component", F.col("rows").alias("copies")), "repeated")
    thin = places.select("id", "doc_id", "paragraph", "n_words", "lines")
    rows = written(repeated.dropDuplicates(["id"]).join(thin, "id").dropDuplicates(["id"]), "places")
    place = F.struct("doc_id", "paragraph")
    least = rows.groupBy("component").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    told = lookup(rows, written(least, "least"), ["component"], "n", rows.count())
    return told.select(
        "doc_id",
        "paragraph",
        "n_words",
        "copies",
        F.col("least.doc_id").alias("group_doc"),
        F.col("least.paragraph").alias("group_paragraph"),
        (place != F.col("least")).alias("removed"),
        F.lit(None).cast("int").alias("first_word"),
        "lines",
    )


def repeated_runs(docs: DataFrame, whole: DataFrame, min_words: int) -> DataFrame:
    """The rows of ``repeated_passages`` for equal runs of words, wherever lines end.

    Every run of ``2 * min_words - 1`` words or more that occurs twice has equal anchored passages of ``min_words`` words in all its
    copies. Each passage is compared with the copy that stays and lengthened by the equal words beside it. That copy is the
    one in the smallest document, there the first, of those without words in removed paragraphs, if there are any.
    ``paragraph`` is the line of the anchored passage's first word, ``n_words`` counts the lengthened one.
    """
    with passing_tables(docs.sparkSession) as keep:
        marks = written(anchors(docs, min_words), "anchors")
        counts = written(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "anchor_counts")
        found = lookup(marks, counts, ["hash"], "n", marks.count())
        found = found.repartition("doc_id").groupBy("doc_id", "hash", "at").agg(F.min(F.struct("paragraph", "last", "n_lines")).alias("l")).select("hash", "doc_id", "at", "l.*")
        gone = whole.where("removed").groupBy("doc_id").agg(F.flatten(F.collect_list("lines")).alias("gone"))
        lines = F.sequence("paragraph", "last")
        found = found.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        left = found.where(F.size(F.array_intersect(lines, "gone")) < F.col("n_lines")).withColumn("touches", F.arrays_overlap(lines, "gone"))
        left = keep(written(left.drop("gone", "last", "n_lines"), "anchors_left"))
    place = F.struct("touches", "doc_id", "at", "paragraph")
    groups = left.groupBy("hash").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    told = written(lookup(left, written(groups, "groups"), ["hash"], "n", left.count()), "told")
    wanted = told.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    texts = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "places")
    beside = map_batches(texts, contexts(min_words), CONTEXTS).groupBy("hash", "doc_id", "at").agg(F.min(F.struct("before", "after")).alias("c"))
    # written joined, so that the wide rows are dealt by place once
    rows = written(told.join(beside.select("hash", "doc_id", "at", "c.*"), ["hash", "doc_id", "at"]), "contexts")
    stays = rows.where((F.col("doc_id") == F.col("least.doc_id")) & (F.col("at") == F.col("least.at")))
    stays = written(stays.select("hash", F.col("before").alias("b"), F.col("after").alias("a"), "n"), "stays")
    rows = lookup(rows.withColumnRenamed("n", "copies"), stays, ["hash"], "n", told.count())
    return lengthened(
        rows.select(
            "doc_id",
            "paragraph",
            F.lit(min_words).alias("n_words"),
            "copies",
            F.col("least.doc_id").alias("group_doc"),
            F.col("least.paragraph").alias("group_paragraph"),
            ((F.col("doc_id") != F.col("least.doc_id")) | (F.col("at") != F.col("least.at"))).alias("removed"),
            F.col("at").alias("first_word"),
            F.lit(None).cast("array<int>").alias("lines"),
            "before",
            "after",
            "b",
            "a",
        )
    )


def without_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs and passages cut out of their texts; documents without any stay as they are.

    Of a removed passage the words and the space behind them go, line ends stay. Words that another passage's staying copy
    covers stay too.
    """
    span = F.when(F.col("first_word").isNotNull(), F.struct("first_word", (F.col("first_word") + F.col("n_words")).alias("end")))
    rows = repeated.where("removed or first_word is not null").groupBy("doc_id")
    gone = rows.agg(
        F.flatten(F.collect_set(F.when(F.col("first_word").isNull(), F.col("lines")))).alias("_gone"),
        F.collect_set(F.when(F.col("removed"), span)).alias("_cut"),
        F.collect_set(F.when(~F.col("removed"), span)).alias("_stay"),
    )
    covers = lambda spans, i: F.exists(spans, lambda s: (s["first_word"] <= i) & (i < s["end"]))
    words = F.regexp_extract_all("text", F.lit(f"[^{_SPACE}]+[{_SPACE}]*"), F.lit(0))
    rest = F.transform(words, lambda w, i: F.when(covers("_cut", i) & ~covers("_stay", i), F.regexp_replace(w, "[^\n]", "")).otherwise(w))
    text = F.concat(F.regexp_extract("text", f"^[{_SPACE}]*", 0), F.array_join(rest, ""))
    lines = F.split(F.when(F.size("_cut") > 0, text).otherwise(F.col("text")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    joined = docs.join(gone, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
