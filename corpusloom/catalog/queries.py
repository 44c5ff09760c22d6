"""One query per operator. Arrays are shown as text, so that any client can compare them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..functions.text import EOS, MASK, SOS, collapse, fold, normalize_answer, pieces_for_encoding
from ..operators import bpe, corpus, encoding, qa_eval, qa_features, run_metrics, samples, sentence_model
from ..operators.vocabulary import Vocabulary, special_mismatches, token_usage
from ..session import scratch_path
from ..sources import documents, evaluation, metrics, pair_corpus
from ..sources.squad import first_examples, read_qa_examples
from .. import streaming
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAP = 100
BATCH = 32
ACCUMULATION = 4
SEED = 7


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(array: Column) -> Column:
    return F.array_join(array, " ")


def shown_spans(offsets: Column) -> Column:
    return F.array_join(F.transform(offsets, lambda o: F.concat_ws(":", o["s"], o["e"])), " ")


# ---------------------------------------------------------------- sources and sinks


@query
def a1_document_scan(spark, sf):
    return D.documents(spark, sf)


@query
def a2_source_cap(spark, sf):
    return documents.take_documents(D.documents(spark, sf), CAP)


@query
def a2_large_source_cap(spark, sf):
    docs = D.all_documents(spark, sf)
    return documents.take_documents(docs, docs.count() // 2)


@query
def a3_source_union(spark, sf):
    return documents.concat_sources(D.documents(spark, sf), D.books(spark, sf))


@query
def a4_pair_corpus(spark, sf):
    return pair_corpus.read_pair_corpus(spark, D.line_files(spark, sf)).select("s1", "s2")


@query
def a4_pair_corpus_index(spark, sf):
    pairs = pair_corpus.index_pair_corpus(spark, D.line_files(spark, sf))
    return pairs.rows.agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_distinct("idx").alias("n"))


@query
def a5_training_text(spark, sf):
    return pair_corpus.read_training_text(spark, D.line_files(spark, sf))


@query
def a6_qa_examples(spark, sf):
    return D.qa_examples(spark, sf).rows.select(
        "ex_idx", "qid", "question", "context", F.array_join("answers", "|").alias("answers"), "answer_start"
    )


@query
def a6_split_object(spark, sf):
    rows = read_qa_examples(spark, D.qa_object(spark, sf)).rows
    return rows.select("ex_idx", "qid", "question", "context", F.array_join("answers", "|").alias("answers"), "answer_start")


@query
def a7_pair_sink(spark, sf):
    return pair_corpus.write_pairs(D.routed_pairs(spark, sf), scratch_path(spark, "pairs"))


@query
def a8_vocabulary_store(spark, sf):
    path = scratch_path(spark, "vocabulary")
    D.vocabulary(spark, sf).save(spark, path)
    loaded = Vocabulary.load(spark, path)
    return loaded.vocab_table(spark)


@query
def a9_metric_log(spark, sf):
    return metrics.read_metrics(spark, D.metric_log(spark, sf)).select(
        "run", "event", "epoch", "step", "split", "batch_loss", F.round("avg_loss", 6).alias("avg_loss"), "_ts"
    )


@query
def a9_repeated_batches(spark, sf):
    """Every batch is appended twice under one name, and counts once."""
    path = scratch_path(spark, "repeated")
    once = metrics.read_metrics(spark, D.metric_log(spark, sf))
    for _ in range(2):
        for event in ("step", "epoch"):
            metrics.append_metrics(once.where(F.col("event") == event), path, batch=event)
    return metrics.read_metrics(spark, path).select(
        "run", "event", "epoch", "step", "split", "batch_loss", F.round("avg_loss", 6).alias("avg_loss"), "_ts"
    )


def _written_evaluation(spark, sf) -> str:
    path = scratch_path(spark, "evaluation")
    predicted = evaluation.write_predictions(D.gold_predictions(spark, sf), path)
    evaluation.write_metrics(qa_eval.qa_metrics(predicted, D.qa_examples(spark, sf).rows), path)
    return path


@query
def a10_evaluation_sink(spark, sf):
    path = _written_evaluation(spark, sf)
    written, _ = evaluation.read_evaluation(spark, path)
    return written.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "count")


@query
def a10_evaluation_lines(spark, sf):
    found = evaluation.evaluation_lines(*evaluation.read_evaluation(spark, _written_evaluation(spark, sf)))
    return found.where("value not like '{\"metrics\"%'")


@query
def a10_evaluation_event(spark, sf):
    metrics, _ = evaluation.read_evaluation(spark, _written_evaluation(spark, sf))
    event = evaluation.evaluation_event(metrics, "evaluation")
    return event.withColumns({c: F.round(c, 6) for c in ("exact_match", "f1")})


@query
def a10_predictions(spark, sf):
    return evaluation.read_evaluation(spark, _written_evaluation(spark, sf))[1]


# ---------------------------------------------------------------- corpus


@query
def b1_paragraphs(spark, sf):
    return corpus.paragraphs(D.paragraph_documents(spark, sf))


@query
def b2_sentences(spark, sf):
    return corpus.sentences(D.paragraph_documents(spark, sf), filtered=False)


def _scores(scores: DataFrame, least: float) -> DataFrame:
    kept = scores.where(F.col("score") >= least)
    return kept.withColumn("score", F.round("score", 6))


@query
def b2_abbreviations(spark, sf):
    return _scores(sentence_model.abbreviation_scores(D.word_counts(spark, sf)), sentence_model.ABBREVIATION)


@query
def b2_sentence_starters(spark, sf):
    pairs = D.word_pairs(spark, sf)
    known = D.learnt_sentences(spark, sf).abbreviations
    return _scores(sentence_model.starter_scores(pairs, D.word_counts(spark, sf), known), sentence_model.STARTER)


@query
def b2_collocations(spark, sf):
    pairs = D.word_pairs(spark, sf)
    known = D.learnt_sentences(spark, sf).abbreviations
    return _scores(sentence_model.collocation_scores(pairs, D.word_counts(spark, sf), known), sentence_model.COLLOCATION)


@query
def b2_learnt_sentences(spark, sf):
    return corpus.sentences(D.paragraph_documents(spark, sf), D.learnt_sentences(spark, sf), filtered=False)


@query
def b3_collapsed_text(spark, sf):
    return D.all_documents(spark, sf).withColumn("text", collapse(F.col("text")))


@query
def b4_kept_sentences(spark, sf):
    return corpus.sentences(D.paragraph_documents(spark, sf))


@query
def b5_adjacent_pairs(spark, sf):
    return corpus.adjacent_pairs(D.all_documents(spark, sf))


@query
def b5_paragraph_pairs(spark, sf):
    return corpus.adjacent_pairs(D.paragraph_documents(spark, sf))


@query
def b6_split_routing(spark, sf):
    pairs = corpus.adjacent_pairs(D.all_documents(spark, sf))
    return corpus.route_split(pairs).select(*corpus.PAIR_KEY, "split")


@query
def b7_pair_counts(spark, sf):
    return corpus.pair_counts(D.routed_pairs(spark, sf))


# ---------------------------------------------------------------- vocabulary


@query
def c1_normalized_text(spark, sf):
    return D.all_documents(spark, sf).withColumn("text", fold(F.col("text")))


@query
def c1_accents_only(spark, sf):
    return D.all_documents(spark, sf).withColumn("text", fold(F.col("text"), lowercase=False))


@query
def c2_pieces(spark, sf):
    pieces = pieces_for_encoding(F.col("text"))
    rows = D.all_documents(spark, sf).select("source", "doc_id", F.posexplode_outer(pieces).alias("pos", "piece"))
    return rows.filter(F.col("piece").isNotNull())


@query
def c3_piece_frequencies(spark, sf):
    return bpe.piece_frequencies(D.all_documents(spark, sf))


@query
def c3_frequent_pieces(spark, sf):
    return bpe.frequent_pieces(D.all_documents(spark, sf), one_in=1000)


@query
def c4_byte_symbol_usage(spark, sf):
    encoded = D.all_documents(spark, sf).select(encoding.encode(F.col("text"), D.bytes_only()).alias("ids"))
    return token_usage(encoded, "ids", D.bytes_only())


@query
def c5_pair_counts(spark, sf):
    words = D.symbol_words(spark, sf)
    return bpe.pair_ids(bpe.pair_counts(words))


@query
def c6_next_merges(spark, sf):
    words = D.symbol_words(spark, sf)
    return bpe.pair_ids(bpe.top_pairs(bpe.pair_counts(words), 50))


@query
def c7_merged_words(spark, sf):
    words = D.symbol_words(spark, sf)
    left, right = D.first_pair(spark, sf)
    merged = bpe.merge_words(words, [(left, right, len(D.bytes_only()))])
    return merged.select(F.array_join(bpe.word_ids(F.col("word")), " ").alias("ids"), "freq")


@query
def c8_trained_merges(spark, sf):
    return D.vocabulary(spark, sf).merges_table(spark)


@query
def c8_trained_vocabulary(spark, sf):
    return D.vocabulary(spark, sf).vocab_table(spark)


@query
def c8_full_training(spark, sf):
    """Training at the operator's own size; tests compare it with the public library."""
    return bpe.train(bpe.piece_frequencies(D.all_documents(spark, sf))).vocabulary.merges_table(spark)


@query
def c9_reserved_ids(spark, sf):
    vocab = D.vocabulary(spark, sf).vocab_table(spark)
    swapped = F.when(F.col("id") == EOS, SOS).when(F.col("id") == SOS, EOS).otherwise(F.col("id")).alias("id")
    return special_mismatches(spark, vocab.select(swapped, "token"))


@query
def c10_encode_bytes(spark, sf):
    ids = encoding.encode(F.col("text"), D.bytes_only())
    return D.all_documents(spark, sf).select("source", "doc_id", shown(ids).alias("ids"))


@query
def c10_encode(spark, sf):
    ids = encoding.encode(F.col("text"), D.vocabulary(spark, sf))
    return D.all_documents(spark, sf).select("source", "doc_id", shown(ids).alias("ids"))


@query
def c11_offsets_bytes(spark, sf):
    encoded = D.all_documents(spark, sf).select(
        "source", "doc_id", encoding.encode_with_offsets(F.col("text"), D.bytes_only()).alias("e")
    )
    return encoded.select("source", "doc_id", shown(F.col("e.ids")).alias("ids"), shown_spans(F.col("e.offsets")).alias("offsets"))


@query
def c11_offsets(spark, sf):
    encoded = D.all_documents(spark, sf).select(
        "source", "doc_id", encoding.encode_with_offsets(F.col("text"), D.vocabulary(spark, sf)).alias("e")
    )
    return encoded.select("source", "doc_id", shown(F.col("e.ids")).alias("ids"), shown_spans(F.col("e.offsets")).alias("offsets"))


@query
def c12_decode(spark, sf):
    vocabulary = D.vocabulary(spark, sf)
    encoded = D.all_documents(spark, sf).select("source", "doc_id", encoding.encode(F.col("text"), vocabulary).alias("ids"))
    return encoded.select("source", "doc_id", encoding.decode(F.col("ids"), vocabulary).alias("text"))


@query
def c13_to_seq(spark, sf):
    turns = D.table(spark, sf, "conversations")
    ids = turns.select("conv_id", "turn", encoding.encode(F.col("text"), D.bytes_only()).alias("ids"))
    made = encoding.to_seq(F.col("ids"), 256, with_eos=True, with_sos=True, with_len=True)
    return ids.select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", shown(F.col("m.seq")).alias("seq"), "m.length")


@query
def c14_from_seq(spark, sf):
    turns = D.table(spark, sf, "conversations")
    ids = turns.select("conv_id", "turn", encoding.encode(F.col("text"), D.bytes_only()).alias("ids"))
    seq = F.concat(encoding.to_seq(F.col("ids"), 256, with_sos=True), F.array((F.lit(1000) + F.col("turn")).cast("int")))
    return ids.select("conv_id", "turn", shown(encoding.from_seq(seq, D.bytes_only())).alias("tokens"))


@query
def c15_token_usage(spark, sf):
    vocabulary = D.vocabulary(spark, sf)
    encoded = D.all_documents(spark, sf).select(encoding.encode(F.col("text"), vocabulary).alias("ids"))
    return token_usage(encoded, "ids", vocabulary)


@query
def c15_vocabulary_size(spark, sf):
    vocab = D.vocabulary(spark, sf).vocab_table(spark)
    return vocab.agg(F.count("*").alias("size"), F.count_if("is_special").alias("n_special"))


# ---------------------------------------------------------------- samples


def _byte_samples(spark, sf) -> DataFrame:
    return samples.pretraining_samples(D.indexed_pairs(spark, sf), D.bytes_only(), D.SEQ_LEN, SEED)


def _shown_sample(df: DataFrame) -> DataFrame:
    return df.select(
        "split", "idx", "is_next", *[shown(F.col(c)).alias(c) for c in ("bert_input", "bert_label", "segment_label")]
    )


def _byte_ids(spark, sf) -> DataFrame:
    """Ids of both sentences of every pair, before any sampling."""
    return samples.pair_ids(D.indexed_pairs(spark, sf).rows, D.bytes_only(), "split", "idx", F.lit(1).alias("is_next"))


@query
def d1_dense_index(spark, sf):
    return D.indexed_pairs(spark, sf).rows.select("split", "idx", *corpus.PAIR_KEY)


@query
def d2_next_sentence(spark, sf):
    return samples.sample_second_sentences(D.indexed_pairs(spark, sf), SEED).select("split", "idx", "is_next", "s1", "s2")


@query
def d2_distinct_negatives(spark, sf):
    drawn = samples.sample_second_sentences(D.indexed_pairs(spark, sf), SEED, repeat=False)
    return drawn.select("split", "idx", "is_next", "s1", "s2")


def _sentence_codes(spark, sf) -> DataFrame:
    """Ids and codes of both sentences of every pair, a row each."""
    rows = _byte_ids(spark, sf)
    sides = [rows.select("split", "idx", F.lit(k).alias("side"), F.col(f"i{k}").alias("ids")) for k in (1, 2)]
    both = sides[0].unionByName(sides[1])
    codes = samples.mask_codes(F.col("ids"), len(D.bytes_only()), "mask", SEED, 0, F.col("split"), F.col("idx"), F.col("side"))
    return both.withColumn("codes", codes)


@query
def d3_masked_tokens(spark, sf):
    ids, codes = F.col("ids"), F.col("codes")
    return _sentence_codes(spark, sf).select(
        "split",
        "idx",
        "side",
        shown(samples.masked_input(ids, codes)).alias("input"),
        shown(samples.masked_label(ids, codes)).alias("label"),
    )


@query
def d4_replacements(spark, sf):
    tokens = _sentence_codes(spark, sf).select(F.explode_outer(F.arrays_zip("ids", "codes")).alias("t"))
    replaced = tokens.select("t.*").filter((F.col("codes") > MASK) & (F.col("codes") != F.col("ids")))
    return replaced.groupBy(F.col("codes").alias("id")).agg(F.count("*").alias("n"))


@query
def d5_truncated_lengths(spark, sf):
    cut = samples.truncate_pair(_byte_ids(spark, sf), D.SEQ_LEN)
    return cut.select("split", "idx", F.size("i1").alias("n1"), F.size("i2").alias("n2"))


@query
def d6_assembled(spark, sf):
    cut = samples.truncate_pair(_byte_ids(spark, sf), D.SEQ_LEN)
    unmasked = {f"codes{k}": F.transform(f"i{k}", lambda i: F.lit(0)) for k in (1, 2)}
    return _shown_sample(samples.assemble(cut.withColumns(unmasked), D.SEQ_LEN)).drop("bert_label")


@query
def d7_samples(spark, sf):
    return _shown_sample(_byte_samples(spark, sf))


@query
def d7_subword_samples(spark, sf):
    made = samples.pretraining_samples(D.indexed_pairs(spark, sf), D.vocabulary(spark, sf), D.SEQ_LEN, SEED)
    return _shown_sample(made)


@query
def d7_epoch_samples(spark, sf):
    encoded = samples.encoded_pairs(D.indexed_pairs(spark, sf), D.bytes_only())
    return _shown_sample(samples.epoch_samples(encoded, len(D.bytes_only()), D.SEQ_LEN, SEED))


def _train_batches(spark, sf) -> DataFrame:
    pairs = D.indexed_pairs(spark, sf)
    train = pairs.rows.filter("split = 'train'").select("idx")
    return samples.epoch_batches(train, pairs.counts["train"], BATCH, SEED)


@query
def d8_shuffled_batches(spark, sf):
    return _train_batches(spark, sf)


@query
def d8_ordered_batches(spark, sf):
    pairs = D.indexed_pairs(spark, sf)
    test = pairs.rows.filter("split = 'test'").select("idx")
    return samples.epoch_batches(test, pairs.counts["test"], BATCH, shuffle=False, drop_last=False)


@query
def d8_qa_batches(spark, sf):
    features = _eval_indexes(spark, sf).select(F.col("feature_index").alias("example_index"))
    return samples.epoch_batches(features, features.count(), BATCH, shuffle=False, drop_last=False, key="example_index", dense=False)


@query
def d8_qa_training_batches(spark, sf):
    made = qa_features.train_features(qa_features.judged_features(D.encoded_examples(spark, sf), True))
    features = made.select("example_index")
    return samples.epoch_batches(features, features.count(), BATCH, SEED, key="example_index", dense=False)


@query
def d9_step_plan(spark, sf):
    return samples.step_plan(spark, D.indexed_pairs(spark, sf).counts["train"], BATCH, ACCUMULATION, epochs=3)


@query
def d9_step_boundaries(spark, sf):
    n = samples.batch_count(D.indexed_pairs(spark, sf).counts["train"], BATCH)
    return samples.step_boundaries(_train_batches(spark, sf), n, ACCUMULATION)


@query
def d10_masked_positions(spark, sf):
    return samples.masked_positions(_byte_samples(spark, sf), "split", "idx")


@query
def d11_padding_mask(spark, sf):
    mask = F.transform(samples.padding_mask(F.col("bert_input")), lambda m: m.cast("int"))
    return _byte_samples(spark, sf).select("split", "idx", F.array_join(mask, "").alias("mask"))


# ---------------------------------------------------------------- question-answering features


@query
def e1_first_examples(spark, sf):
    return first_examples(D.qa_examples(spark, sf).rows, CAP).select("ex_idx", "qid")


def _fitted(spark, sf) -> DataFrame:
    return qa_features.fit_to_length(D.encoded_examples(spark, sf))


@query
def e2_query_budget(spark, sf):
    asked = qa_features.encode_questions(D.qa_examples(spark, sf).rows, D.bytes_only())
    return qa_features.fit_question(asked).select("ex_idx", shown(F.col("q_ids")).alias("q_ids"), "budget")


@query
def e3_context_cut(spark, sf):
    return _fitted(spark, sf).select(
        "ex_idx", shown(F.col("c_ids")).alias("c_ids"), shown_spans(F.col("c_offsets")).alias("offsets")
    )


@query
def e4_assembled(spark, sf):
    return qa_features.assemble_features(_fitted(spark, sf)).select(
        "ex_idx", shown(F.col("input_ids")).alias("input_ids"), shown(F.col("segment_ids")).alias("segment_ids"), "context_start"
    )


@query
def e5_answer_span(spark, sf):
    return qa_features.answer_span(_fitted(spark, sf)).select("ex_idx", "tok_start", "tok_end")


@query
def e6_drop_counts(spark, sf):
    return qa_features.drop_counts(qa_features.judged_features(D.encoded_examples(spark, sf), True))


@query
def e7_train_features(spark, sf):
    made = qa_features.train_features(qa_features.judged_features(D.encoded_examples(spark, sf), True))
    return made.select(
        "example_index", shown(F.col("input_ids")).alias("input_ids"), "start_position", "end_position"
    )


def _eval_features(spark, sf) -> DataFrame:
    return qa_features.eval_features(qa_features.judged_features(D.encoded_examples(spark, sf), False))


def _eval_indexes(spark, sf) -> DataFrame:
    return qa_features.eval_feature_indexes(D.qa_examples(spark, sf).rows, D.bytes_only())


@query
def e7_eval_features(spark, sf):
    return _eval_features(spark, sf).select(
        "feature_index",
        "context_start",
        shown(F.col("input_ids")).alias("input_ids"),
        shown(F.col("segment_ids")).alias("segment_ids"),
        shown_spans(F.col("context_token_offsets")).alias("offsets"),
    )


@query
def e7_subword_features(spark, sf):
    made = qa_features.qa_features(D.qa_examples(spark, sf).rows, D.vocabulary(spark, sf), True)
    return made.select("example_index", shown(F.col("input_ids")).alias("input_ids"), "start_position", "end_position")


# ---------------------------------------------------------------- question-answering evaluation


def _scored(spark, sf) -> DataFrame:
    return qa_eval.context_scores(_eval_features(spark, sf), D.logits(_eval_indexes(spark, sf)))


@query
def f1_context_scores(spark, sf):
    sixteenths = {
        n: F.array_join(F.transform(n, lambda v: (v * 16).cast("int")), " ") for n in ("start_scores", "end_scores")
    }
    return _scored(spark, sf).select("feature_index", *[c.alias(n) for n, c in sixteenths.items()])


@query
def f2_top_candidates(spark, sf):
    top = qa_eval.top_candidates(F.col("start_scores"))
    rows = _scored(spark, sf).select("feature_index", F.posexplode(top).alias("rank", "c"))
    return rows.select("feature_index", "rank", F.col("c.at").alias("position"), (-F.col("c.neg")).alias("score"))


@query
def f3_best_span(spark, sf):
    spans = qa_eval.decode_spans(_scored(spark, sf))
    return spans.select("feature_index", "span.s", "span.e", (-F.col("span.neg")).alias("score"))


def _texts(spark, sf, max_answer_tokens: int) -> DataFrame:
    spans = qa_eval.decode_spans(_scored(spark, sf), max_answer_tokens)
    return qa_eval.span_text(qa_eval.span_characters(spans), D.qa_examples(spark, sf).rows)


@query
def f4_without_legal_span(spark, sf):
    return _texts(spark, sf, 1)


@query
def f5_span_text(spark, sf):
    return _texts(spark, sf, qa_eval.MAX_ANSWER_TOKENS)


@query
def f6_predictions(spark, sf):
    return qa_eval.predict(_eval_features(spark, sf), D.logits(_eval_indexes(spark, sf)), D.qa_examples(spark, sf).rows)


@query
def f7_normalized_answers(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", normalize_answer(F.col("text")).alias("text"))


def _golds(spark, sf) -> DataFrame:
    """Every gold answer of a question beside the prediction; without any, the empty one."""
    given = F.when(F.size("answers") > 0, F.col("answers")).otherwise(F.array(F.lit("")))
    golds = D.qa_examples(spark, sf).rows.select("qid", F.posexplode(given).alias("gold_number", "gold"))
    return golds.join(D.gold_predictions(spark, sf), "qid")


@query
def f8_exact_match(spark, sf):
    return _golds(spark, sf).select("qid", "gold_number", qa_eval.exact_match(F.col("text"), F.col("gold")).alias("em"))


@query
def f9_token_f1(spark, sf):
    return _golds(spark, sf).select("qid", "gold_number", F.round(qa_eval.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


@query
def f9_turn_overlap(spark, sf):
    """Whole turns against each other: the question as a prediction of the reply."""
    return D.qa_turns(spark, sf).select(
        "qid", F.round(qa_eval.token_f1(F.col("question"), F.col("context")), 6).alias("f1")
    )


@query
def f10_qa_metrics(spark, sf):
    made = qa_eval.qa_metrics(D.gold_predictions(spark, sf), D.qa_examples(spark, sf).rows)
    return made.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "count")


# ---------------------------------------------------------------- training events


@query
def g1_nsp_accuracy(spark, sf):
    draw = digest("nsp-logits", F.col("doc_id"))
    pair = F.array(*[F.conv(F.substring(draw, i, 2), 16, 10).cast("double") for i in (1, 3)])
    rows = D.table(spark, sf, "labels").select(pair.alias("logits"), F.col("quality").alias("is_next"))
    return run_metrics.nsp_accuracy(rows).select(F.round("nsp_acc", 6).alias("nsp_acc"), "n")


@query
def g2_mlm_accuracy(spark, sf):
    positions = samples.masked_positions(_byte_samples(spark, sf), "split", "idx")
    draw = F.substring(digest("mlm", F.col("split"), F.col("idx"), F.col("position")), 1, 1)
    predicted = positions.select(
        "split", "idx", "position", F.when(draw < "9", F.col("label")).otherwise(F.col("label") + 1).alias("prediction")
    )
    made = run_metrics.mlm_accuracy(positions, predicted, ["split", "idx", "position"])
    return made.select(F.round("mlm_acc", 6).alias("mlm_acc"), "n")


@query
def g3_pretraining_losses(spark, sf):
    rows = D.batch_rows(spark, sf)
    nsp = rows.select("batch_id", F.slice("logits", 1, 2).alias("logits"), F.pmod("label", F.lit(2)).alias("is_next"))
    losses = run_metrics.batch_losses(nsp, rows.filter("label <> 0"))
    return losses.select("batch_id", *[F.round(c, 6).alias(c) for c in ("nsp_loss", "mlm_loss", "loss")])


@query
def g3_qa_losses(spark, sf):
    rows = D.batch_rows(spark, sf).select(
        "batch_id",
        F.col("logits").alias("start_logits"),
        F.col("logits").alias("end_logits"),
        F.col("label").alias("start_position"),
        (F.col("label") + 3).alias("end_position"),
    )
    return run_metrics.qa_batch_losses(rows).select("batch_id", F.round("loss", 6).alias("loss"))


@query
def g4_running_loss(spark, sf):
    means = run_metrics.running_means(D.metric_events(spark, sf))
    return means.select("run", "epoch", "step", "i", "running_loss")


@query
def g4_running_accuracy(spark, sf):
    batches = D.metric_events(spark, sf).select(
        "run", "epoch", "step", F.pmod("user_id", F.lit(5)).alias("correct"), F.lit(4).cast("bigint").alias("total")
    )
    made = run_metrics.running_accuracy(batches, "correct", "total", "running_acc")
    return made.select("run", "epoch", "step", "running_acc")


@query
def g5_epoch_summary(spark, sf):
    batch = F.floor(F.col("step") / 16).alias("batch")
    batches = D.metric_events(spark, sf).groupBy("run", "epoch", batch).agg(
        F.avg(F.col("batch_loss").cast("double")).alias("loss"),
        F.avg((F.col("batch_loss") * 2).cast("double")).alias("mlm_loss"),
        F.avg((F.col("batch_loss") * 3).cast("double")).alias("nsp_loss"),
        F.count_if(F.pmod("user_id", F.lit(3)) == 0).alias("mlm_correct"),
        F.count_if(F.pmod("user_id", F.lit(3)) < 2).alias("mlm_total"),
        F.count_if(F.pmod("user_id", F.lit(2)) == 0).alias("nsp_correct"),
        F.count("*").alias("nsp_total"),
    )
    made = run_metrics.epoch_summary(batches)
    return made.select("run", "epoch", *[F.round(c, 6).alias(c) for c in made.columns if c not in ("run", "epoch")])


@query
def g6_logged_steps(spark, sf):
    steps = run_metrics.running_means(D.metric_events(spark, sf))
    return run_metrics.logged_steps(steps, 50).select("run", "epoch", "step", "i")


def _test_epochs(spark, sf) -> DataFrame:
    return D.epoch_events(spark, sf).filter("split = 'test'").select("run", "epoch", "avg_loss")


@query
def g7_improvements(spark, sf):
    flagged = run_metrics.improvements(_test_epochs(spark, sf), "avg_loss")
    return flagged.select("run", "epoch", "is_best")


@query
def g7_highest_improvements(spark, sf):
    flagged = run_metrics.improvements(_test_epochs(spark, sf), "avg_loss", lower_is_better=False, start=-1.0)
    return flagged.select("run", "epoch", "is_best")


@query
def g7_best_epoch(spark, sf):
    return run_metrics.best_epoch(run_metrics.improvements(_test_epochs(spark, sf), "avg_loss"))


@query
def g7_streamed_improvements(spark, sf):
    """Epoch records arrive out of order, in several files, one at a time."""
    arriving, path, state = (scratch_path(spark, n) for n in ("late-epochs", "flags", "state"))
    draw = F.substring(digest("late", F.col("run"), F.col("epoch")), 1, 1)
    epochs = _test_epochs(spark, sf).select("run", "epoch", "avg_loss", (F.conv(draw, 16, 10).cast("int") % 3).alias("part"))
    epochs.repartition(3, "part").write.json(arriving)
    stream = spark.readStream.schema("run string, epoch int, avg_loss double").option("maxFilesPerTrigger", 1).json(arriving)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        streaming.append_flags(streaming.streamed_improvements(stream, "avg_loss"), path, state).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return streaming.latest_flags(spark.read.schema(streaming.FLAGS).parquet(path))


@query
def g8_final_metrics(spark, sf):
    made = run_metrics.final_metrics(metrics.read_metrics(spark, D.metric_log(spark, sf)), "test", ["avg_loss"])
    return made.select("run", "epoch", F.round("avg_loss", 6).alias("avg_loss"))


@query
def g8_epoch_curve(spark, sf):
    made = run_metrics.epoch_curve(metrics.read_metrics(spark, D.metric_log(spark, sf)), ["avg_loss"])
    return made.withColumn("avg_loss", F.round("avg_loss", 6))


# ---------------------------------------------------------------- streams


@query
def h1_streamed_pairs(spark, sf):
    arriving = {
        name: streaming.stream_table(spark, sf, f"{name}.parquet", source, D.table(spark, sf, name).schema, key)
        for name, source, key in (("documents", "wiki", "doc_id"), ("benchmark", "books", "item_id"))
    }
    docs = documents.concat_sources(*arriving.values())
    path, state = scratch_path(spark, "streamed"), scratch_path(spark, "state")
    streaming.stream_pairs(docs, path, state).awaitTermination()
    rows = spark.read.schema("source string, doc_id bigint, para int, pos int, s1 string, s2 string, split string")
    return rows.parquet(path)


@query
def h2_dashboard(spark, sf):
    events = metrics.stream_metrics(spark, D.metric_log(spark, sf))
    path, state = scratch_path(spark, "dashboard"), scratch_path(spark, "state")
    streaming.publish(streaming.dashboard(events), path, state).awaitTermination()
    made = spark.read.parquet(path)
    return made.select(
        "run", "split", "last_epoch", *[F.round(c, 6).alias(c) for c in ("last_loss", "best_loss")], "n_epochs"
    )


@query
def h2_step_rate(spark, sf):
    events = metrics.stream_metrics(spark, D.metric_log(spark, sf))
    path, state = scratch_path(spark, "rate"), scratch_path(spark, "state")
    streaming.append_closed(streaming.step_rate(events, "1 day", "1 day"), path, state).awaitTermination()
    made = spark.read.schema("run string, window_start timestamp, n_steps bigint, mean_loss double").parquet(path)
    return made.select("run", "window_start", "n_steps", F.round("mean_loss", 6).alias("mean_loss"))
