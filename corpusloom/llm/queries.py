"""Registered queries of the operators in this subpackage, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import decontamination, dedup, divergence, fingerprints, language, line_crf, packing, pii, quality, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    thin = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(written(thin, "pieces"))  # so that a task holds a tokenizer or a packer, not both


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def _labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labels without those held out: ``doc_id, label``."""
    return _table(spark, sf_dir, "labels").where(~language.held_out(4, 2)).select("doc_id", F.col(label).alias("label"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = toxicity.fit(docs, _labels(spark, sf_dir, "toxic"))
    told = toxicity.score(docs, examples, carry=["doc_id"])
    return told.select("doc_id", language.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))
    text = fingerprints.text_form
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text(F.col("sketch")).alias("fingerprint"), text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    told = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir, "quality")), carry=["doc_id"])
    return told.select("doc_id", language.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passage", "attention")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    page = lambda c: F.substring_index(c, ":", -1).try_cast("bigint")
    return records.select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.text_form(base), 256).alias("base_sha256"), pii.text_form(F.col("spans")).alias("spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_documents(_table(spark, sf_dir, "documents"), shingle_words=3, similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language.held_out(5, 0)
    told = language.identify(docs, language.fit_profiles(docs.where(~held)))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8, fit_weights="counts")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_crf.judge(docs, line_crf.fit(docs), carry=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in globals().items() if name.startswith("op")}

#: Every source has every kept term as a row, and all pairs of sources are joined term by term: no blocks, levels or products.
_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
members AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
levels AS MATERIALIZED (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n
  FROM members m JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM levels GROUP BY lang, source),
langs AS (SELECT lang, term, sum(n) AS n FROM levels GROUP BY lang, term),
lang_totals AS (SELECT lang, sum(n) AS total FROM langs GROUP BY lang),
p AS MATERIALIZED (
  SELECT lang, source, term, l.n, 1 + (CAST(1000000000 AS HUGEINT) * (l.n + 5)) // (t.total + 5 * s.v) AS p
  FROM levels l JOIN totals t USING (lang, source) JOIN sizes s USING (lang)),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (l.n + 5)) // (t.total + 5 * s.v) AS q
  FROM langs l JOIN lang_totals t USING (lang) JOIN sizes s USING (lang)),
found AS (
  SELECT m.lang, m.source, 'pair' AS part, o.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                   WHERE x.lang = m.lang AND x.source = m.source AND y.source = o.source), 0) AS value
  FROM members m JOIN members o ON o.lang = m.lang AND o.source <> m.source
  UNION ALL
  SELECT p.lang, p.source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""

ORACLES: dict[str, str] = {"op11_source_divergence_audit": _DIVERGENCE}
