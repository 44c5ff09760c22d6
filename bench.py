"""Headline stages at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each stage reads the tables the stage before it wrote, as a user's jobs would, and writes all its columns to a sink that
discards them. A figure is the median of three runs after one that warms up; training and table builds run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from corpusloom.catalog import derived as D  # noqa: E402
from corpusloom.catalog.queries import QUERIES  # noqa: E402
from corpusloom.operators import bpe, corpus, encoding, qa_eval, qa_features, samples  # noqa: E402
from corpusloom.session import local_session, written  # noqa: E402
from corpusloom.sources.documents import concat_sources, scan_documents  # noqa: E402
from corpusloom.sources.pair_corpus import index_pairs, training_text  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
VOCAB_SIZE = 400
SEQ_LEN = 128


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}

    def once(name: str, build):
        start = time.perf_counter()
        made = build()
        seconds[name] = round(time.perf_counter() - start, 3)
        return made

    def timed(name: str, build, count: bool = True) -> None:
        if count:
            rows[name] = build().count()
        else:
            drain(build())
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            drain(build())
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)

    # the tables are one row group each, which is one task unless the rows are dealt anew
    docs = concat_sources(
        scan_documents(spark, f"{SF_DIR}/documents.parquet", "wiki", partitions=int(CPUS)), scan_documents(spark, f"{SF_DIR}/benchmark.parquet", "books", "item_id")
    )
    timed("b_pairs", lambda: corpus.route_split(corpus.adjacent_pairs(docs), D.TEST_RATIO))
    pairs = written(corpus.route_split(corpus.adjacent_pairs(docs), D.TEST_RATIO), "pairs")
    timed("c3_piece_frequencies", lambda: bpe.piece_frequencies(training_text(pairs)))
    frequencies = written(bpe.piece_frequencies(training_text(pairs)), "frequencies")
    training = once("c8_train_vocabulary", lambda: bpe.train(frequencies, VOCAB_SIZE))
    rows["c8_rounds"] = training.rounds
    vocabulary = training.vocabulary
    timed("c10_encode_documents", lambda: docs.select("doc_id", encoding.encode(F.col("text"), vocabulary).alias("ids")))
    timed("c11_offsets", lambda: docs.select("doc_id", encoding.encode_with_offsets(F.col("text"), vocabulary).alias("e")))
    indexed = once("d1_index", lambda: index_pairs(pairs))
    timed("d2_next_sentence", lambda: samples.sample_second_sentences(indexed, 1))
    timed("d7_samples", lambda: samples.pretraining_samples(indexed, vocabulary, SEQ_LEN, 1))
    encoded_pairs = once("d7_encode_pairs", lambda: samples.encoded_pairs(indexed, vocabulary))
    timed("d7_epoch_samples", lambda: samples.epoch_samples(encoded_pairs, len(vocabulary), SEQ_LEN, 1))
    timed("d8_shuffled_batches", lambda: QUERIES["d8_shuffled_batches"](spark, SF_DIR))
    examples = D.qa_examples(spark, SF_DIR).rows
    encoded = qa_features.encode_examples(examples, vocabulary)
    timed("e_train_features", lambda: qa_features.train_features(qa_features.judged_features(encoded, True)))
    features = written(qa_features.eval_features(qa_features.judged_features(encoded, False)), "features")
    logits = written(D.logits(features), "logits")
    timed("f_predictions", lambda: qa_eval.predict(features, logits, examples))
    predicted = written(qa_eval.predict(features, logits, examples), "predictions")
    timed("f_metrics", lambda: qa_eval.qa_metrics(predicted, examples), count=False)
    rows["f_metrics"] = rows["f_predictions"]
    for name in ("g4_running_loss", "g5_epoch_summary", "g7_improvements", "h1_streamed_pairs", "h2_dashboard"):
        timed(name, lambda name=name: QUERIES[name](spark, SF_DIR))
    start = time.perf_counter()
    full = bpe.train(frequencies)
    large = {"tokens": len(full.vocabulary), "rounds": full.rounds, "seconds": round(time.perf_counter() - start, 3)}
    per_second = {n: round(rows[n] / s) for n, s in seconds.items() if rows.get(n) and s}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "rows_per_second": per_second,
                "sf": SF_DIR,
                "cpus": int(CPUS),
                "training_at_default_size": large,  # beyond the total, which compares with earlier runs
            }
        )
    )


if __name__ == "__main__":
    main()
