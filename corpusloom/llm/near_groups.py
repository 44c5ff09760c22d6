"""Near copies by MinHash: universal hash minima, banding, signature and exact checks, components by stars.

The work on texts is one pass; all later tables hold thin rows. Equal shingle sets are one class from the start, so copies
never meet each other again. Candidates come from bands of minima that agree. In a bucket of candidates each class is first
checked against its most similar one only, which links most groups with few checks; then every pair of a bucket that is still
in different components is checked, in blocks of bounded size, unless its signatures differ too much. No pair within a
component is ever written, and no bucket, however large, meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import passing_tables, written
from .common import components, lookup, map_batches, runs, salted
from .words import SPACED, mix, shingles_of, words_of

_SIGNED = "id long, text_hash long, n_shingles long, high long, low long, signature binary"
_SETS = "id long, shingles binary"
_LINKS = "a long, b long"
_KEYS = ["bucket", "block", "other"]
#: Rows of a bucket that meet the rows of another block, and their word runs; larger buckets are dealt to more tasks.
_BLOCK, _BLOCK_SHINGLES = 1500, 4_000_000


def distinct_per_text(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text one after the other, and where each text's values start (with the end)."""
    cuts = np.searchsorted(owner, np.arange(n + 1))
    h = h.copy()
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h[first:end].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[cuts]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def signer(shingle_words: int, bands: int, rows: int, table: np.ndarray) -> Callable:
    """Task function: (id, text, text_hash) to set size, a 128-bit digest of the set and the minima of ``bands * rows`` hashes."""
    n_hashes = bands * rows
    seeds = mix(np.arange(1, 2 * n_hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, shifts = seeds[:n_hashes] | np.uint64(1), seeds[n_hashes:]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            hashes, text, _, _ = words_of(batch.column(1), table)
            h, owner = shingles_of(hashes, text, shingle_words, n)
            values, cuts = distinct_per_text(h, owner, n)
            full = np.flatnonzero(np.diff(cuts) > 0)
            starts = cuts[full]
            minima = np.zeros((n, n_hashes), np.uint16)
            digests = np.zeros((2, n), np.uint64)
            if len(full):
                for k in range(n_hashes):
                    least = np.minimum.reduceat(values * factors[k] + shifts[k], starts)
                    minima[full, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
                for k, salt in enumerate((0x1234567, 0x89ABCDE)):
                    digests[k, full] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), starts))
            empty = np.diff(cuts) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.diff(cuts)),
                    pa.array(digests[0].view(np.int64), mask=empty),
                    pa.array(digests[1].view(np.int64), mask=empty),
                    pa.array([None if e else m.tobytes() for m, e in zip(minima, empty)], pa.binary()),
                ],
                names=["id", "text_hash", "n_shingles", "high", "low", "signature"],
            )

    return sign


def shingle_sets(shingle_words: int, table: np.ndarray) -> Callable:
    """Task function: (id, text) to the sorted 64-bit hashes of the shingles."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, text, _, _ = words_of(batch.column(1), table)
            values, cuts = distinct_per_text(*shingles_of(hashes, text, shingle_words, batch.num_rows), batch.num_rows)
            sets = [values[cuts[i] : cuts[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return collect


def _least_agreement(similarity: float, n_hashes: int) -> int:
    """Equal minima below which a pair of the similarity is not expected: six standard deviations below the mean."""
    return int(n_hashes * similarity - 6 * (n_hashes * similarity * (1 - similarity)) ** 0.5)


class _Bucket:
    """Rows of two blocks of one bucket, and which of their pairs may be similar."""

    def __init__(self, group: pa.Table, bands: int, rows: int, similarity: float, least: int):
        self.ids, self.sizes, self.components, self.own = (group[c].to_numpy() for c in ("id", "size", "component", "own_block"))
        self.components = self.components.copy()
        self.block, self.other, self.band = (group[c][0].as_py() for c in ("block", "other", "band"))
        self.signatures = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(len(self.ids), -1)
        self.rows, self.similarity, self.least = rows, similarity, least
        self.first, self.second = np.flatnonzero(self.own == self.block), np.flatnonzero(self.own == self.other)

    def alike(self, i: int, partners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partners in other components that size and signature allow, their equal minima, and whether no earlier band has the pair."""
        partners = partners[self.components[partners] != self.components[i]]
        s = self.sizes[partners]
        partners = partners[np.minimum(s, self.sizes[i]) >= self.similarity * np.maximum(s, self.sizes[i])]
        same = self.signatures[partners] == self.signatures[i]
        agree = same.sum(1)
        keep = agree >= self.least
        partners, same, agree = partners[keep], same[keep], agree[keep]
        new = ~same[:, : self.band * self.rows].reshape(len(partners), self.band, self.rows).all(2).any(1)
        return partners, agree, new

    def new_pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Every pair of the two blocks at most once, by its first row."""
        for i in self.first.tolist():
            partners, agree, new = self.alike(i, self.second[self.second > i] if self.block == self.other else self.second)
            if new.any():
                yield i, partners[new], agree[new]


def _buckets(batches: Iterator[pa.RecordBatch], *how) -> Iterator[tuple[pa.Table, _Bucket]]:
    for group in runs(batches, ["bucket", "block", "other"]):
        components = group["component"].to_numpy()
        if len(components) > 1 and not (components == components[0]).all():
            yield group, _Bucket(group, *how)


def nearest_pairs(*how) -> Callable:
    """Task function over rows of buckets: each row with its most similar partner, as far as signatures allow any."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, bucket in _buckets(batches, *how):
            seekers = [(i, bucket.second) for i in bucket.first.tolist()]
            if bucket.block != bucket.other:
                seekers += [(i, bucket.first) for i in bucket.second.tolist()]
            for i, partners in seekers:
                partners, agree, _ = bucket.alike(i, partners)
                if len(partners):
                    best = bucket.ids[partners[int(np.argmax(agree))]]
                    left.append(min(best, bucket.ids[i]))
                    right.append(max(best, bucket.ids[i]))
            if len(left) > 20_000:
                yield _pairs(left, right)
                left, right = [], []
        if left:
            yield _pairs(left, right)

    return pairs


def open_rows(*how) -> Callable:
    """Task function over rows of buckets: those with a pair in different components that signatures allow."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bucket in _buckets(batches, *how):
            keep = np.zeros(len(bucket.ids), bool)
            for i, partners, _ in bucket.new_pairs():
                keep[i] = True
                keep[partners] = True
            if keep.any():
                yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    return rows_of


def bucket_links(numerator: int, denominator: int, *how) -> Callable:
    """Task function over rows of buckets with their full sets: pairs of components with a link between them.

    A link joins its ends' components within the task, so a bucket of n rows gives fewer than n pairs. Every pair that stays
    in different components has been compared in full.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bucket in _buckets(batches, *how):
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
            left, right, named = [], [], bucket.components.copy()
            for i, partners, agree in bucket.new_pairs():
                for j in partners[np.argsort(-agree, kind="stable")].tolist():
                    here, there = bucket.components[i], bucket.components[j]
                    if here != there and _similar(sets[i], sets[j], numerator, denominator):
                        bucket.components[bucket.components == there] = here
                        left.append(min(named[i], named[j]))
                        right.append(max(named[i], named[j]))
            if left:
                yield _pairs(left, right)

    return links


def _similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return denominator * common >= numerator * (len(x) + len(y) - common)


def _pairs(left: list[int], right: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _confirm(numerator: int, denominator: int) -> Callable:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                keep.append(_similar(np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64), numerator, denominator))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return confirm


def near_classes(
    items: DataFrame,
    shingle_words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = 28,
    rows: int = 5,
    table: np.ndarray = SPACED,
) -> tuple[DataFrame, DataFrame]:
    """Signed items and, of each class of equal sets, the component of near copies.

    ``items`` has ``id: long`` and ``text``. Returns (1) one row per item: ``id, text_hash, n_shingles, high, low`` (digest of
    the set, null where there is no word), (2) one row per set: ``high, low, copies, class_id`` (smallest id with that set),
    ``component`` (smallest ``class_id`` reachable over links), ``head`` (whether it stands for its component: of the sets with
    that id, the least digest). Two sets are linked if their Jaccard similarity is at least ``similarity``; every link found by
    the bands is confirmed on the full sets. Sets are told apart by their digests alone, so texts that share an id are judged
    one by one. With 28 bands of 5 minima a pair of similarity 0.85 is missed by the bands once in 13 million.
    """
    with passing_tables(items.sparkSession) as keep:
        signed, found = _near_classes(items, shingle_words, similarity, bands, rows, table)
        return keep(signed), keep(found)


def _near_classes(
    items: DataFrame, shingle_words: int, similarity: tuple[int, int], bands: int, rows: int, table: np.ndarray
) -> tuple[DataFrame, DataFrame]:
    ratio = similarity[0] / similarity[1]
    plain = items.select("id", "text", F.xxhash64("text").alias("text_hash"))
    signed = written(map_batches(plain, signer(shingle_words, bands, rows, table), _SIGNED), "signed")
    classes = (
        signed.where("high is not null and id is not null")
        .groupBy("high", "low")
        .agg(F.min(F.struct("id", "text_hash", "n_shingles", "signature")).alias("r"), F.count("*").alias("copies"))
    )
    # each class is a node with a number of its own; it keeps it, as the table is written
    classes = classes.select(
        F.monotonically_increasing_id().alias("node"),
        "high",
        "low",
        "copies",
        F.col("r.id").alias("class_id"),
        F.col("r.text_hash").alias("text_hash"),
        F.col("r.n_shingles").alias("size"),
        F.col("r.signature").alias("signature"),
    )
    classes = written(classes, "classes")
    members = written(_members(classes, bands, rows), "members")
    one = classes.select(F.col("node").alias("id"), "size", "signature")
    how = (bands, rows, ratio, _least_agreement(ratio, bands * rows))
    alone = one.withColumn("component", F.col("id"))
    near = written(map_batches(_dealt(members, alone), nearest_pairs(*how), _LINKS).distinct(), "near")
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    # a class is represented by one text, found by its id and hash; texts are shuffled here at every size, so that the plan
    # is the same on a small table
    shown = classes.join(wanted.withColumnRenamed("id", "node"), "node", "left_semi").select("node", F.col("class_id").alias("id"), "text_hash")
    texts = plain.join(shown.hint("merge"), ["id", "text_hash"]).select("node", "text")
    sets = written(map_batches(texts, shingle_sets(shingle_words, table), _SETS).dropDuplicates(["id"]), "sets")
    links = written(_checked(near, sets, similarity), "links")
    first = written(components(links), "components")
    named = one.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    tied = written(members.join(wanted, "id", "left_semi").join(named.select("id", "component"), "id"), "tied")
    several = tied.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_members = tied.join(several, "bucket", "left_semi").drop("component")
    dealt = _dealt(open_members, named)
    still = written(map_batches(dealt, open_rows(*how), dealt.schema), "open")
    full = still.join(sets.hint("merge"), "id").select(*dealt.columns, "shingles")
    more = map_batches(full.repartition(*_KEYS).sortWithinPartitions(*_KEYS), bucket_links(*similarity, *how), _LINKS)
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    result = (
        classes.select("node", "high", "low", "copies", "class_id")
        .join(first, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(second, "component", "left")
        .select("high", "low", "copies", "class_id", F.coalesce("joined", "component").alias("node"))
    )
    result = written(result, "components_of_classes")
    heads = result.groupBy("node").agg(F.min(F.struct("class_id", "high", "low")).alias("least"), F.count("*").alias("n"))
    found = lookup(result, written(heads, "heads"), ["node"], "n", result.count())
    head = F.struct("class_id", "high", "low") == F.col("least")
    found = found.select("high", "low", "copies", "class_id", F.col("least.class_id").alias("component"), head.alias("head"))
    # without the signatures, which are most of it
    return written(signed.select("id", "text_hash", "n_shingles", "high", "low"), "items"), written(found, "named_classes")


def membership(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Items with their class and component; items without words or id are their own."""
    total = signed.count()
    kept = ["id", "text_hash", "n_shingles", "high", "low"]
    told = lookup(signed.where("high is not null and id is not null"), classes, ["high", "low"], "copies", total)
    alone = signed.where("high is null or id is null").select(
        *kept, F.lit(1).cast("bigint").alias("copies"), F.col("id").alias("class_id"), F.col("id").alias("component"), F.lit(True).alias("head")
    )
    return told.select(*kept, "copies", "class_id", "component", "head").unionByName(alone)


def _band_key(band: Column, rows: int) -> Column:
    """Band in the upper byte, so that keys order like their bands, and 56 bits of the hash of its minima."""
    minima = F.xxhash64(band, F.substring("signature", band * (2 * rows) + 1, F.lit(2 * rows)))
    return F.shiftleft(band.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(minima, 8))


def _members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, band, n, shingles, id): the classes of every band value that two classes or more share.

    Close classes share many bands, so many buckets hold the same classes. Of these the one of the first band stays: a pair is
    looked at in the first band that has it, and no bucket of that band can be among those that go. They are told by their
    number, the sum of their sizes and a 64-bit digest. ``bands`` is below 128.
    """
    own = classes.select(F.col("node").alias("id"), "size", "signature", F.xxhash64("node").alias("mark"))
    cut = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    thin = cut.select(_band_key(F.col("band"), rows).alias("bucket"), F.col("band").cast("smallint").alias("band"), "id", "size", "mark")
    buckets = thin.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor("mark").alias("marks"))
    buckets = buckets.where("n > 1").groupBy("marks", "n", "shingles").agg(F.min("bucket").alias("bucket")).drop("marks")
    total = classes.count() * bands
    return lookup(thin.drop("size", "mark"), written(buckets, "buckets"), ["bucket"], "n", total)


def _dealt(members: DataFrame, named: DataFrame) -> DataFrame:
    """Buckets as pairs of blocks, each pair in one task: all of ``_KEYS`` together and in order."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / _BLOCK), F.ceil(F.col("shingles") / _BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    met = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows_of = members.select("bucket", "band", "id", own.alias("own_block"), met.alias("met")).join(named, "id")
    pair = (F.least("own_block", "met").alias("block"), F.greatest("own_block", "met").alias("other"))
    dealt = rows_of.select("bucket", *pair, "band", "own_block", "id", "size", "component", "signature")
    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def _checked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs, copies_a = salted(written(pairs, "pairs"), "a", "b")
    pairs, copies_b = salted(written(pairs, "salted"), "b", "a")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")).join(copies_a, "a")
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("two")).join(copies_b, "b")
    both = pairs.join(one, ["a", "a_salt"]).join(two, ["b", "b_salt"])
    return map_batches(both.select("a", "b", "one", "two"), _confirm(*similarity), _LINKS)
