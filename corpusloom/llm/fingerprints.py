"""Document fingerprints: bottom-k sketches of word runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from ..session import written

#: Smallest hashes kept, and words of a run.
K, WORDS = 64, 5


def words(text: Column) -> Column:
    """Words of a text between white space of ASCII; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """``struct<size: long, k: int, hashes: array<bigint>>``: the ``k`` smallest distinct hashes of runs of ``n`` words, in order.

    ``size`` is the number of distinct runs if there are at most ``k``, and estimated from the k-th smallest hash otherwise.
    A text of fewer words, but not none, has one run; one without words has an empty sketch. Null counts as empty.
    """
    return _sketch_of(_runs(text, n), k)


def _runs(text: Column, n: int) -> Column:
    # one-element arrays bind a value that several expressions below use, so that it is computed once
    bound = F.array(F.transform(words(text), lambda w: F.xxhash64(w)))
    last = lambda h: F.sequence(F.lit(0), F.size(h) - n)
    return F.transform(
        bound,
        lambda h: F.when(F.size(h) >= n, F.transform(last(h), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def _sketch_of(hashes: Column, k: int) -> Column:
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
    return F.transform(F.array(least), lambda h: F.struct(_distinct(h, k).alias("size"), F.lit(k).alias("k"), h.alias("hashes")))[0]


def _distinct(hashes: Column, k: int) -> Column:
    """Number of distinct hashes below which the ``k`` smallest lie: (k - 1) over the share of the range up to the k-th."""
    share = (F.element_at(hashes, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(hashes) < k, F.size(hashes).cast("bigint")).otherwise(F.greatest(F.lit(k).cast("bigint"), F.round((k - 1) / share).cast("bigint")))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets, from their sketches."""
    return _sketch_of(F.concat(a["hashes"], b["hashes"]), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of the union's ``k`` smallest hashes that both sketches hold.

    Exact where both sets have at most ``k`` runs in all; 1 for two empty sets.
    """
    union = F.slice(F.sort_array(F.array_union(a["hashes"], b["hashes"])), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a["hashes"], b["hashes"]), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second, 0 to 1; 1 for an empty first set."""
    j = resemblance(a, b, k)
    union = _union_size(a, b, k)
    return F.when(a["size"] == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * union / a["size"]))


def _union_size(a: Column, b: Column, k: int) -> Column:
    return merge(a, b, k)["size"]


def text_form(of: Column) -> Column:
    """A sketch as text: hashes in hexadecimal, joined by points; equal sets have equal texts."""
    return F.array_join(F.transform(of["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ".")


def fingerprints(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """``docs`` with a column ``sketch`` of the whole text."""
    return docs.withColumn("sketch", sketch(F.col("text"), k, n))


def next_documents(docs: DataFrame) -> DataFrame:
    """``key, prev_key, prev_chars``: for each document the one before it, in ascending order of ``doc_id``.

    ``key`` is the id with a hash of the text. The last document comes before the first. Rows that repeat an id with the
    same text are one document; of other rows with equal ids the order is that of the hash. Null ids come first.
    """
    thin = docs.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("bigint").alias("n_chars")).distinct()
    indexed = dense_index(thin, ("doc_id", "h"))
    total = indexed.total
    before = indexed.rows.select(F.pmod(F.col("idx") + 1, F.lit(max(1, total))).alias("idx"), F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"), F.col("n_chars").alias("prev_chars"))
    return indexed.rows.select("idx", "doc_id", "h").join(before, "idx").drop("idx")


def edited_likeness(docs: DataFrame, k: int = K, n: int = WORDS) -> DataFrame:
    """Each document's sketch, its edited text's, and how like they are, and how like the next document's is.

    The edited text replaces the last half of the code points (rounded down) by as many, or all, of the first of the next
    document; the next of the last is the first. Columns: ``doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited,
    near_next``. Null texts are empty; rows that repeat an id with the same text have equal results. A text is shuffled once by its own key, and from there only what its predecessor
    needs goes on to that.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.withColumn("h", F.xxhash64("text"))
    order = written(next_documents(plain), "order")
    id_key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    chars = F.char_length("text").cast("bigint")
    half = F.floor(chars / 2)
    sent = order.select(id_key("doc_id").alias("o1"), F.col("h").alias("o2"), id_key("prev_id").alias("p1"), F.col("prev_h").alias("p2"), "prev_chars")
    base = plain.select(id_key("doc_id").alias("o1"), F.col("h").alias("o2"), "text", sketch(F.col("text"), k, n).alias("sketch")).join(sent, ["o1", "o2"])
    first = F.substring("text", F.lit(1), (chars - half).cast("int"))
    own = base.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.nullif("o1", F.lit(-(1 << 63))).alias("doc_id"), chars.alias("n_chars"), first.alias("first"), "sketch")
    once = base.withColumn("_row", F.row_number().over(W.partitionBy("o1", "o2").orderBy("o2"))).where("_row = 1")
    second = F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 2).cast("int"))
    following = once.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), second.alias("second"), F.col("sketch").alias("next_sketch"))
    both = own.join(following, ["k1", "k2"]).withColumn("edited", F.concat("first", "second"))
    done = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, n).alias("edited_sketch"), "next_sketch"
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
