import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import qa_eval, qa_features
from corpusloom.operators.vocabulary import byte_vocabulary
from corpusloom.plans import evaluate, finetuning_features
from corpusloom.sources.evaluation import evaluation_event, evaluation_lines, read_evaluation
from corpusloom.sources.squad import first_examples, read_qa_examples, split_objects

V = byte_vocabulary()


def qa(qid, question, answers=None):
    made = {"id": qid, "question": question}
    if answers is not None:
        made["answers"] = [{"text": t, "answer_start": s} for t, s in answers]
    return made


ARTICLES = [
    {"paragraphs": [{"context": "The cat sat on the mat.", "qas": [
        qa("q0", "Who sat?", [("cat", 4), ("The cat", 0)]), qa("q1", "Why?"), qa("q2", "Where?", [])]}]},
    {"paragraphs": [{"context": "Dogs bark.", "qas": [qa("q3", "Who barks?", [("Dogs", 0)])]}, {"context": "x", "qas": []}]},
]


@pytest.fixture(scope="module")
def squad(tmp_path_factory):
    path = tmp_path_factory.mktemp("squad") / "train.json"
    path.write_text(json.dumps({"version": "1.1", "data": ARTICLES}, indent=1))
    return str(path)


def test_examples_are_flat_and_in_file_order(spark, squad, tmp_path):
    rows = read_qa_examples(spark, squad).rows.orderBy("ex_idx").collect()
    assert [(r["ex_idx"], r["qid"], r["answers"], r["answer_start"]) for r in rows] == [
        (0, "q0", ["cat", "The cat"], 4), (1, "q1", [], None), (2, "q2", [], None), (3, "q3", ["Dogs"], 0)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(a) for a in ARTICLES))
    lines = read_qa_examples(spark, str(tmp_path / "lines.json"), articles_per_line=True)
    assert sorted(map(str, lines.rows.collect())) == sorted(map(str, rows)) and lines.total == 4
    assert first_examples(lines.rows, 2).count() == 2 and first_examples(lines.rows, -1).count() == 4


TRICKY = ['a } b', '{"x": [}]}', 'quote " and \\ and \\" {', "\\\\", "é漢\U0001f600}", "\n}\t{", "", "}" * 30, '"' * 7 + "{" * 5]


def tricky_file(path, n, indent, seed):
    import random

    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(TRICKY) for _ in range(draw.randrange(4)))
    data = []
    for k in range(n):
        asked = [[qa(f"{k}-{p}-{q}", text(), [(text(), q)] * draw.randrange(3)) for q in range(draw.randrange(4))] for p in range(draw.randrange(4))]
        data.append({"title": text(), "paragraphs": [{"context": text(), "qas": q, "extra": {"a": {"b": {}}}} for q in asked]})
    made = {"version": "1.1 }{", "data": data, "meta": {"about": "}"}}
    path.write_text(json.dumps(made, indent=indent, ensure_ascii=seed % 2 == 0), encoding="utf-8")


@pytest.mark.parametrize("size, indent", [(101, None), (400, 1), (10**6, 2)])
def test_one_object_is_split_between_tasks(spark, tmp_path, size, indent):
    for k in range(3):
        tricky_file(tmp_path / f"{k}.json", (7, 1, 0)[k], indent, size + k)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        assert split_objects(spark, str(tmp_path)).count() >= 8
        split = read_qa_examples(spark, str(tmp_path))
        got = sorted(map(str, split.rows.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = read_qa_examples(spark, str(tmp_path), whole_files=True)
    assert got == sorted(map(str, whole.rows.collect())) and split.counts == whole.counts and split.total > 5


def test_states_that_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusloom.sources.squad.BROADCAST_BLOCKS", 0)
    test_one_object_is_split_between_tasks(spark, tmp_path, 500, None)


def judged(spark, squad, is_training, seq_len, max_query_len=64):
    encoded = qa_features.encode_examples(read_qa_examples(spark, squad).rows, V)
    return qa_features.judged_features(encoded, is_training, seq_len, max_query_len)


def outcomes(frame):
    return {r["qid"]: r["drop_reason"] for r in frame.collect()}


def test_drop_reasons(spark, squad):
    assert outcomes(judged(spark, squad, True, 64)) == {"q0": None, "q1": "no_answer", "q2": "no_answer", "q3": None}
    # The question fills the feature: this comes before the missing answer.
    assert set(outcomes(judged(spark, squad, True, 8)).values()) == {"overflow"}
    assert set(outcomes(judged(spark, squad, False, 8)).values()) == {"overflow"}
    # The answer lies behind the cut.
    assert outcomes(judged(spark, squad, True, 13, 6))["q0"] == "overflow"
    assert outcomes(judged(spark, squad, False, 13, 6))["q0"] is None
    counts = {r["outcome"]: r["n"] for r in qa_features.drop_counts(judged(spark, squad, True, 64)).collect()}
    assert counts == {"kept": 2, "no_answer": 2}


def test_feature_layout(spark, squad):
    features, _ = finetuning_features(spark, squad, V, True, max_examples=1, seq_len=40, max_query_len=3)
    row = features.first()
    n = len(" the cat sat on the mat.")
    assert row["context_start"] == 5 and row["segment_ids"] == [1] * 5 + [2] * (n + 1) + [0] * (40 - 6 - n)
    assert row["input_ids"][0] == 3 and row["input_ids"][4] == 2 and row["input_ids"][5 + n] == 2
    # The prefixed space is a token of its own, and the space before the answer is another.
    assert (row["start_position"], row["end_position"]) == (5 + 1 + 4, 5 + 1 + 6)


def test_span_inside_one_token(spark):
    offsets = "array(named_struct('s', 0, 'e', 5), named_struct('s', 5, 'e', 9))"
    df = spark.range(1).selectExpr(f"{offsets} as c_offsets", "array('b') as answers", "6 as answer_start")
    row = qa_features.answer_span(df).first()
    assert (row["tok_start"], row["tok_end"]) == (1, 1)


def spans(spark, starts, ends, longest=30, k=20):
    df = spark.createDataFrame([(starts, ends)], "start_scores array<float>, end_scores array<float>")
    return qa_eval.decode_spans(df, longest, k).first()["span"]


def searched(starts, ends, longest, k=20):
    top = [sorted(range(len(v)), key=lambda i: (-v[i], i))[:k] for v in (starts, ends)]
    best, found = -1e30, None
    for s in top[0]:
        for e in top[1]:
            if s <= e < s + longest and starts[s] + ends[e] > best:
                best, found = starts[s] + ends[e], (s, e)
    return found


def test_best_span(spark):
    assert spans(spark, [1.0, 1.0, 0.0], [0.0, 2.0, 2.0])["s"] == 0
    equal = spans(spark, [0.0] * 4, [0.0] * 4)
    assert (equal["s"], equal["e"]) == (0, 0)
    assert spans(spark, [0.0, 5.0], [5.0, 0.0], longest=1, k=1) is None
    assert spans(spark, [float("-inf")], [0.0]) is None


def test_best_span_against_search(spark):
    import random

    draw = random.Random(4)
    cases = [([draw.randrange(-20, 20) / 4 for _ in range(n)], [draw.randrange(-20, 20) / 4 for _ in range(n)])
             for n in (1, 2, 5, 19, 20, 21, 40, 90) for _ in range(6)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, start_scores array<float>, end_scores array<float>")
    for longest in (1, 3, 30):
        for r in qa_eval.decode_spans(df, longest).select("i", "span").collect():
            got = (r["span"]["s"], r["span"]["e"]) if r["span"] else None
            assert got == searched(*cases[r["i"]], longest)


def scores(spark, pairs):
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, p string, g string")
    made = df.select("i", qa_eval.exact_match(F.col("p"), F.col("g")).alias("em"), qa_eval.token_f1(F.col("p"), F.col("g")).alias("f1"))
    return [(r["em"], round(r["f1"], 6)) for r in made.orderBy("i").collect()]


def test_scores(spark):
    got = scores(spark, [("a a b", "a b b"), ("", ""), ("", "x"), ("The Cat!", "cat"), ("x y", "z"), ("x x y", "x y y")])
    assert got == [(0.0, 0.666667), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.666667)]


def test_metrics(spark, squad):
    examples = read_qa_examples(spark, squad).rows
    predicted = spark.createDataFrame([("q0", "the cat"), ("q1", ""), ("other", "x")], "qid string, text string")
    assert tuple(qa_eval.qa_metrics(predicted, examples).first()) == (100.0, 100.0, 2)
    assert tuple(qa_eval.qa_metrics(predicted.limit(0), examples).first()) == (0.0, 0.0, 0)
    row = spark.createDataFrame([("q0", "cat dog")], "qid string, text string")
    em, f1, n = qa_eval.qa_metrics(row, examples).first()
    assert (em, round(f1, 4), n) == (0.0, 66.6667, 1)


def test_the_last_feature_wins(spark):
    texts = spark.createDataFrame([(1, "q", "new"), (0, "q", "old")], "feature_index int, qid string, text string")
    assert [tuple(r) for r in qa_eval.predictions(texts).collect()] == [("q", "new")]


def test_the_best_of_several_answers_counts(spark, squad):
    examples = read_qa_examples(spark, squad).rows
    predicted = spark.createDataFrame([("q0", "cat sat"), ("q3", "dogs")], "qid string, text string")
    em, f1, n = qa_eval.qa_metrics(predicted, examples).first()
    assert (em, round(f1, 4), n) == (50.0, 83.3333, 2)


def test_nothing_to_train_on(spark, tmp_path):
    path = tmp_path / "none.json"
    path.write_text(json.dumps({"data": [{"paragraphs": [{"context": "x", "qas": [qa("q", "y?")]}]}]}))
    with pytest.raises(ValueError, match="nothing to train on"):
        finetuning_features(spark, str(path), V, True)
    features, _ = finetuning_features(spark, str(path), V, False)
    assert features.count() == 1


def test_evaluation_end_to_end(spark, squad, tmp_path):
    features, examples = finetuning_features(spark, squad, V, False, seq_len=64)
    at = {0: (5, 7), 3: (0, 4)}
    rows = []
    for r in features.collect():
        s, e = at.get(r["feature_index"], (0, 0))
        start, end = [0.0] * 64, [0.0] * 64
        start[r["context_start"] + s], end[r["context_start"] + e] = 9.0, 9.0
        rows.append((r["feature_index"], start, end))
    logits = spark.createDataFrame(rows, "feature_index bigint, start_logits array<float>, end_logits array<float>")
    metrics = evaluate(features, logits, examples.rows, str(tmp_path / "out"))
    stored, predicted = read_evaluation(spark, str(tmp_path / "out"))
    got = {r["qid"]: r["text"] for r in predicted.collect()}
    assert got["q0"] == "cat" and got["q3"] == "Dogs"
    assert tuple(stored.first()) == tuple(metrics.first()) == (50.0, 50.0, 4)
    lines = [json.loads(r["value"]) for r in evaluation_lines(stored, predicted).collect()]
    assert [x["metrics"] for x in lines if "metrics" in x] == [{"exact_match": 50.0, "f1": 50.0, "count": 4}]
    assert {x["qid"]: x["text"] for x in lines if "qid" in x} == got
    assert tuple(evaluation_event(stored, "r").first()) == ("r", "epoch", -1, "dev", 50.0, 50.0, 4)
