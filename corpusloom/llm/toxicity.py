"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .common import labelled_sample, map_batches
from .words import ALNUM, prefixes_of, shingles_of, words_of

#: Labelled rows of each class that examples are drawn from (about; by a hash of the id), and terms that tell the classes apart.
SAMPLE, TERMS = 4000, 4096
#: Prefixes of words that count as terms, in bytes.
PREFIXES = (4, 5, 6, 7)
#: Log-likelihood ratio, ratio of its shares in both classes, and documents that a term needs to be kept.
LEAST_RATIO, LEAST_ODDS, LEAST_DOCS = 20.0, 8, 4
NEIGHBOURS, BLOCK = 15, 64
#: Weight of the belief without neighbours in a vote.
SMOOTH = 0.5
_REMEMBERED = 20_000


@dataclass
class Examples:
    """Labelled examples as an inverted index in blocks of 64, with the largest weight of each term in each block.

    ``terms`` are sorted hashes; postings of term ``t`` in block ``b`` are ``rows`` and ``weights`` from ``cuts[t, b]`` to
    ``cuts[t, b + 1]``. Vectors have length 1. ``vote`` is how many labelled rows an example stands for.
    """

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vote: np.ndarray
    prior: float
    cuts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    most: np.ndarray

    @staticmethod
    def build(terms, idf, ids, labels, vote, prior, example, term, count) -> Examples:
        order = np.argsort(terms)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        terms, idf, term = terms[order], idf[order], place[term]
        weight = (1 + np.log(count)) * idf[term]
        length = np.sqrt(np.bincount(example, weights=weight**2, minlength=len(ids)))
        weight = weight / np.maximum(length[example], 1e-12)
        blocks = max(1, -(-len(ids) // BLOCK))
        by = np.lexsort((example, term))
        term, example, weight = term[by], example[by], weight[by]
        slot = term * blocks + example // BLOCK
        cuts = np.searchsorted(slot, np.arange(len(terms) * blocks + 1))
        most = np.zeros(len(terms) * blocks)
        np.maximum.at(most, slot, weight)
        return Examples(terms, idf, ids, labels, vote, prior, cuts, example, weight, most.reshape(len(terms), blocks))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest positive cosine, of equal ones the first, and their cosines.

        Blocks are read by decreasing bound and no further than the bound exceeds the k-th cosine, so none is missed.
        """
        blocks = self.most.shape[1]
        bound = weight @ self.most[term]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) >= k and bound[b] < cosine[-1] - 1e-9):
                break
            score = np.zeros(BLOCK)
            for t, w in zip(term.tolist(), weight.tolist()):
                a, z = self.cuts[t * blocks + b], self.cuts[t * blocks + b + 1]
                if z > a:
                    score[self.rows[a:z] - b * BLOCK] += w * self.weights[a:z]
            some = np.flatnonzero(score > 0)
            best, cosine = np.concatenate([best, some + b * BLOCK]), np.concatenate([cosine, score[some]])
            order = np.lexsort((best, -np.round(cosine, 9)))[:k]
            best, cosine = best[order], cosine[order]
        return best, cosine

    def judge(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int], list[float]]:
        """Score and evidence of a text from its terms: votes of the neighbours by cosine squared, smoothed by the belief
        about texts without neighbours."""
        if not len(term):
            return self.prior, [], []
        weight = (1 + np.log(count)) * self.idf[term]
        best, cosine = self.nearest(term, weight / np.sqrt((weight**2).sum()))
        votes = cosine**2 * self.vote[best]
        total = votes.sum() + SMOOTH
        score = (float(votes[self.labels[best] == 1].sum()) + SMOOTH * self.prior) / total
        return min(1.0, max(0.0, score)), self.ids[best].tolist(), np.minimum(cosine, 1.0).tolist()


def _filter_bits(terms: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _known(texts: pa.Array, terms: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of the known terms of every text, sorted by text and term."""
    if not len(terms):
        none = np.zeros(0, np.int64)
        return none, none, none
    h, text = prefixes_of(texts, ALNUM, PREFIXES)
    maybe = bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
    h, text = h[maybe], text[maybe]
    slot = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    same = terms[slot] == h
    pairs, count = np.unique(text[same] * len(terms) + slot[same], return_counts=True)
    return pairs // len(terms), pairs % len(terms), count


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to the distinct terms of each text and the least hash of its runs of three words."""
    for batch in _sliced(batches):
        n = batch.num_rows
        h, text = prefixes_of(batch.column(2), ALNUM, PREFIXES)
        words, owner, _, _ = words_of(batch.column(2), ALNUM)
        runs, run_text = shingles_of(words, owner, 3, n)
        order = np.argsort(text, kind="stable")
        h, cuts = h[order], np.searchsorted(text[order], np.arange(n + 1))
        ends = np.searchsorted(run_text, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([int(runs[ends[i] : ends[i + 1]].min().view(np.int64)) if ends[i + 1] > ends[i] else None for i in range(n)], pa.int64()),
                pa.array([np.unique(h[cuts[i] : cuts[i + 1]]).view(np.int64) for i in range(n)], pa.list_(pa.int64())),
            ],
            names=["id", "label", "least", "terms"],
        )


def _vectors(shared) -> Callable:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        bits = _filter_bits(terms)
        for batch in _sliced(batches):
            text, term, count = _known(batch.column(2), terms, bits)
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(term), pa.array(count)], names=["id", "label", "term", "count"])

    return vectors


def _document_counts(shared) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        bits = _filter_bits(terms)
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in _sliced(batches):
            _, term, _ = _known(batch.column(0), terms, bits)
            total += np.bincount(term, minlength=len(terms))
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["term", "n"])

    return count


def _ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of a term found in ``a`` of ``n1`` and ``b`` of ``n0`` documents."""
    def part(x, n, p):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / (n * p)), 0) + np.where(n - x > 0, (n - x) * np.log(np.maximum(n - x, 1e-12) / np.maximum(n * (1 - p), 1e-12)), 0)

    p = np.clip((a + b) / (n1 + n0), 1e-12, 1 - 1e-12)
    return 2 * (part(a, n1, p) + part(b, n0, p))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Examples:
    """Examples from ``docs`` (``doc_id, text``) by ``labels`` (``doc_id, label`` 0 or 1), document frequencies over all ``docs``.

    About ``sample`` rows of each class are drawn by a hash of the id; of near copies (equal least hash of word runs) in a
    class one stays. Terms are words and prefixes of words; those that the positive class has significantly more often, at
    most ``terms``, span the vectors, so that ordinary prose doesn't drown what the label is about. Rows without text or
    label teach nothing; without both classes every score is the share of positive rows, or 0 for no rows. The driver
    receives ``terms`` counts and the examples' vectors, bounded by both parameters.
    """
    spark = docs.sparkSession
    rows, sizes = labelled_sample(docs, labels, sample, 3)
    drawn = rows.where("text is not null")
    told = map_batches(drawn, _describe, "id long, label int, least long, terms array<long>")
    chosen = written(told.groupBy("label", F.coalesce("least", F.lit(0)).alias("least")).agg(F.min(F.struct("id", "terms")).alias("x")).select("label", "x.id", "x.terms"), "examples")
    n = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positive = sizes.get(1, 0) / max(1, sum(sizes.values()))
    nothing = np.zeros(0, np.int64)
    if len(n) < 2:
        return Examples.build(np.zeros(0, np.uint64), np.zeros(0), nothing, nothing, np.zeros(0), positive, nothing, nothing, nothing)
    df = chosen.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where(F.col("a") >= LEAST_DOCS)
    table = df.where(F.col("a") * n[0] > (F.col("n") - F.col("a")) * n[1] * LEAST_ODDS).orderBy(F.desc(F.col("a") / n[1] - (F.col("n") - F.col("a")) / n[0]), "term").limit(terms * 4).toPandas()
    a, b = table["a"].to_numpy(float), (table["n"] - table["a"]).to_numpy(float)
    ratio = _ratio(a, b, n[1], n[0])
    best = np.argsort(-ratio, kind="stable")[:terms]
    best = best[ratio[best] >= LEAST_RATIO]
    words = np.sort(table["term"].to_numpy(np.int64)[best].view(np.uint64))
    shared = spark.sparkContext.broadcast(words)
    counts = map_batches(docs.select("text"), _document_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = next((r["n"] for r in counts if r["term"] == -1), 0)
    found = np.zeros(len(words))
    for r in counts:
        if r["term"] >= 0:
            found[r["term"]] = r["n"]
    idf = np.log((1 + total) / (1 + found)) + 0.1
    picked = drawn.join(chosen.select("id", "label"), ["id", "label"], "left_semi").select("id", "label", "text")
    rows = map_batches(picked, _vectors(shared), "id long, label int, term long, count long").toPandas()
    ids = np.sort(rows["id"].unique())
    example = np.searchsorted(ids, rows["id"].to_numpy())
    labels = np.zeros(len(ids), np.int64)
    labels[example] = rows["label"].to_numpy()
    vote = np.where(labels == 1, sizes[1] / n[1], sizes[0] / n[0])
    vote = vote / max(vote.min(), 1e-12) if len(vote) else vote
    with_terms = np.bincount(labels, minlength=2)
    silent1 = max(0, n[1] - with_terms[1]) * sizes[1] / n[1]
    silent0 = max(0, n[0] - with_terms[0]) * sizes[0] / n[0]
    prior = silent1 / max(1.0, silent1 + silent0)
    rows = rows.drop_duplicates(["id", "term"])
    return Examples.build(words, idf, ids, labels, vote, prior, np.searchsorted(ids, rows["id"].to_numpy()), rows["term"].to_numpy(), rows["count"].to_numpy())


def _scorer(shared, carried: int, schema: pa.Schema) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Examples = shared.value
        bits = _filter_bits(own.terms)
        told: dict[bytes, tuple] = {}
        for batch in _sliced(batches):
            n = batch.num_rows
            text, term, count = _known(batch.column(carried), own.terms, bits)
            cuts = np.searchsorted(text, np.arange(n + 1))
            out = []
            for i in range(n):
                t, c = term[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
                key = t.tobytes() + c.tobytes()
                if key not in told:
                    if len(told) > _REMEMBERED:
                        told.clear()
                    told[key] = own.judge(t, c)
                out.append(told[key])
            kept = [batch.column(c) for c in range(len(schema) - 3)]
            added = [pa.array([x[k] for x in out], f.type) for k, f in enumerate(list(schema)[-3:])]
            yield pa.RecordBatch.from_arrays([*kept, *added], schema=schema)

    return score


def score(docs: DataFrame, examples: Examples, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``carry``, all by default) with ``score``, ``evidence`` and ``cosines``.

    ``score`` (0 to 1) is the share of positive votes among the 15 nearest examples, by cosine squared; ``evidence`` their
    ids and ``cosines`` their similarities, nearest first. Null and empty texts, and texts without a known term, have no
    neighbours and get the share of positives among such examples. Rows may repeat;
    a column that is called like an added one gives way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "evidence", "cosines")]
    kept = [c for c in carry if c != "text"]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], "text")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if "text" in carry or f.name != "text")
    schema = f"{fields}score double, evidence array<long>, cosines array<double>"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    shared = docs.sparkSession.sparkContext.broadcast(examples)
    out = map_batches(rows, _scorer(shared, len(kept), arrow), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"c{kept.index(c)}").alias(c) for c in carry], "score", "evidence", "cosines")
