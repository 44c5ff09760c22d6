"""Line labels against all sequences of labels, base counts against plain loops."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import line_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(runs)
    repeated = {j for i, run in enumerate(runs) if n[run] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def drawn(seed):
    draw = random.Random(seed)
    pieces = ["a", "b", "a b c d e", " ", "\n", "\n\n", "\t", "\r\n", "é", "漢字 ", "#", "A", "\x00", "\x0b", "\xa0", " ", "a b\n", "same line\n"]
    return "".join(draw.choice(pieces) for _ in range(draw.randrange(0, 120)))


def test_base_counts(spark):
    texts = [None, "", " \n ", "one", "a b c d e a b c d e", "x\nx\nx ", "a\n\n\na", *(drawn(k) for k in range(200)), "w " * 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    told = line_crf.judge(rows, line_crf.train([], [])).collect()
    assert len(told) == len(texts)
    for r in told:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == base(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])


def all_sequences(field, features):
    """Score of each sequence of labels."""
    for labels in itertools.product((0, 1), repeat=len(features)):
        score = field.first[labels[0]] + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))
        yield score + sum(float(f @ field.weights) for f, label in zip(features, labels) if label), labels


@pytest.mark.parametrize("seed", range(20))
def test_decoding_finds_the_best_sequence(seed):
    draw = np.random.default_rng(seed)
    n = len(line_crf.FEATURES)
    field = line_crf.Field(draw.normal(size=n), draw.normal(size=2), draw.normal(size=(2, 2)))
    sizes = draw.integers(1, 7, 5)
    features = draw.normal(size=(sizes.sum(), n))
    text = np.repeat(np.arange(5), sizes)
    labels = field.decode(features, text)
    for k in range(5):
        best = max(all_sequences(field, features[text == k]))
        assert tuple(labels[text == k]) == best[1]


def test_ties_are_content():
    n = len(line_crf.FEATURES)
    assert line_crf.Field(np.zeros(n), np.zeros(2), np.zeros((2, 2))).decode(np.ones((4, n)), np.array([0, 0, 1, 1])).tolist() == [1] * 4


def test_expected_labels_are_sums_over_all_sequences():
    draw = np.random.default_rng(3)
    n = len(line_crf.FEATURES)
    field = line_crf.Field(draw.normal(size=n), draw.normal(size=2), draw.normal(size=(2, 2)))
    features = [draw.normal(size=(k, n)) for k in (4, 1, 3)]
    score = np.zeros((4, 3, 2))
    for k, f in enumerate(features):
        score[: len(f), k, 1] = f @ field.weights
    total, single, double = line_crf._expected(score, np.array([4, 1, 3]), field.first, field.step)
    steps = np.zeros((2, 2))
    for k, f in enumerate(features):
        weighed = [(np.exp(s), labels) for s, labels in all_sequences(field, f)]
        z = sum(w for w, _ in weighed)
        assert np.isclose(total[k], np.log(z))
        for at in range(len(f)):
            assert np.isclose(single[at, k, 1], sum(w for w, labels in weighed if labels[at]) / z)
        for w, labels in weighed:
            for a, b in zip(labels, labels[1:]):
                steps[a, b] += w / z
    assert np.allclose(double, steps)
    assert np.allclose(single[1:, 1], 0)


def sentence(draw):
    return "The " + " ".join(draw.choice(["river", "ran", "slowly", "past", "old", "houses", "of", "a", "town"]) + draw.choice("abcdefgh") for _ in range(12)) + "."


def test_menus_go_and_prose_stays(spark):
    draw = random.Random(5)
    prose = lambda n: "\n".join(sentence(draw) for _ in range(n))
    menu = lambda n: "\n".join(" | ".join(draw.choice(["Home", "News", "Login", "Shop", "Help"]) + draw.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    texts = [prose(8) for _ in range(60)] + [menu(8) for _ in range(60)] + [prose(6) + "\n" + menu(2) + "\n" + prose(3), menu(6) + "\n" + prose(1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    told = {r["doc_id"]: r for r in line_crf.judge(rows, line_crf.fit(rows)).collect()}
    assert [told[k]["kept"] for k in range(122)] == [True] * 60 + [False] * 60 + [True, False]
    assert set(told[120]["content_lines"]) == {*range(6), 8, 9, 10}


def test_a_repeated_text_counts_once_and_nothing_to_learn(spark):
    draw = random.Random(6)
    rows = [(k, "x | y\nx | y") for k in range(300)] + [(1000 + k, "\n".join(sentence(draw) for _ in range(5))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    once = docs.dropDuplicates(["text"])
    a, b = line_crf.fit(docs, sample=50), line_crf.fit(once, sample=50)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.step, b.step)
    for nothing in (docs.limit(0), docs.selectExpr("doc_id", "cast(null as string) as text")):
        assert not line_crf.fit(nothing).weights.any()


def test_batches_don_t_matter():
    texts = [drawn(k) for k in range(40)]
    whole = line_crf.lines_of(pa.array(texts))
    for k, text in enumerate(texts):
        one = line_crf.lines_of(pa.array([text]))
        assert np.allclose(one.features, whole.features[whole.text == k])
