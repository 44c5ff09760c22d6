import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import language, quality, toxicity
from corpusloom.llm.words import ALNUM, SPACED, prefixes_of, shingles_of, words_of


def test_words_and_runs_equal_plain_python():
    texts = ["Ab ab  c", None, "", "é𝒳x é\tZ", "one", "x" * 3_000_000 + " y", " ", "a b c d a b c"]
    h, text, start, end = words_of(pa.array(texts), SPACED)
    plain = [(i, w.encode()) for i, t in enumerate(texts) for w in (t or "").lower().split()]
    data = "".join(t or "" for t in texts).encode()
    assert text.tolist() == [i for i, _ in plain]
    assert [data[a:b].lower() for a, b in zip(start, end)] == [w for _, w in plain]
    assert len(set(zip(h.tolist(), [w for _, w in plain]))) == len({w for _, w in plain}) == len(set(h.tolist()))
    runs, owner = shingles_of(h, text, 3, len(texts))
    count = Counter(i for i, _ in plain)
    assert Counter(owner.tolist()) == {i: max(1, n - 2) for i, n in count.items()}
    assert runs[owner == 7][0] == runs[owner == 7][-1]
    assert prefixes_of(pa.array(["abcdef abcxyz"]), ALNUM, (3,))[0].tolist()[2:] == [prefixes_of(pa.array(["abcq"]), ALNUM, (3,))[0][1]] * 2


# language


def test_gram_counts_equal_plain_python():
    texts = ["Ab, ba!", "", "é  É", "12", "a"]

    def plain(text):
        kept = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        out = Counter()
        for w in kept:
            padded = f" {w} "
            for n in range(1, 4):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip() and " " not in padded[i : i + n][1:-1] and not (padded[i] == " " and padded[i + n - 1] == " "))
        return sorted(out.values())

    text, _, count = language.gram_counts(texts, 3)
    assert [sorted(count[text == i].tolist()) for i in range(len(texts))] == [plain(t) for t in texts]


def test_out_of_place_distance_equals_brute_force(documents, prose):
    draw = random.Random(1)
    rows = [(i, prose(i, draw.choice([3, 80, 300]), ("abcde", "defgh", "ghijk")[i % 3]), ("xx", "yy", "zz")[i % 3]) for i in range(60)] + [(90, None, "xx"), (91, "12 !", None), (92, "", None), (93, "ABC abc", None), (93, "ABC abc", None), (None, "ghi", None)]
    docs = documents(rows)
    profiles = language.fit_profiles(docs, top=50, longest=3)
    assert profiles.languages == ["xx", "yy", "zz"]
    got = sorted(((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in language.identify(docs, profiles).collect()))
    want = []
    for doc, text, _ in rows:
        _, h, n = language.gram_counts([text or ""], 3)
        ranked = [x for _, x in sorted(zip((-n).tolist(), h.tolist()))][:50]
        if not ranked:
            want.append((str(doc), "und", 0.0))
            continue
        cost = []
        for lang, own in zip(profiles.languages, profiles.ranked):
            place = {int(x): i for i, x in enumerate(own)}
            cost.append((sum(abs(place[x] - i) if x in place else 50 for i, x in enumerate(ranked)) / (50 * len(ranked)), lang))
        want.append((str(doc), min(cost)[1], round(1 - min(cost)[0], 9)))
    assert got == sorted(want)
    held = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents([(i, prose(900 + i, 60, "defgh")) for i in range(9)]), profiles).collect()}
    assert set(held.values()) == {"yy"}


def test_no_labelled_language(documents):
    profiles = language.fit_profiles(documents([(1, "abc")]))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(documents([(1, "abc")]), profiles).collect()] == [("und", 0.0)]
    assert language.identify(documents([]), profiles).collect() == []


# toxicity


@pytest.fixture(scope="module")
def labelled(spark, documents, prose):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, draw.choice([4, 40, 120])).split()
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(["badword", "vilething", "nastyone", "nastytwo"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if i % 7 else None))
    rows += [(900, None), (901, ""), (902, "12"), (903, "badword"), (903, "badword"), (None, "vilething x")]
    return documents(rows), spark.createDataFrame(labels + [(3, 0), (77777, 1), (None, 1)], "doc_id long, label int")


def test_toxic_documents_are_found(spark, labelled, documents, prose):
    docs, labels = labelled
    examples = toxicity.fit(docs, labels)
    told = toxicity.score(docs, examples).collect()
    assert len(told) == docs.count()
    for r in told:
        assert 0 <= r["score"] <= 1 and len(r["evidence"]) == len(r["cosines"]) <= toxicity.NEIGHBOURS
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 5 == 0)
    by_id = {r["doc_id"]: r["score"] for r in told}
    assert by_id[900] == by_id[901] == by_id[902] == examples.prior < 0.1 and by_id[903] > 0.9 and by_id[None] > 0.9
    assert toxicity.score(documents([]), examples).collect() == []


def test_block_max_search_is_exact():
    draw = np.random.default_rng(1)
    n, terms = 500, 60
    dense = draw.random((n, terms)) * (draw.random((n, terms)) < 0.1)
    counts = np.ceil(dense * 5).astype(int)
    counts[10:40] = counts[10]
    example, term = np.nonzero(counts)
    index = toxicity.Examples.build(np.arange(terms, dtype=np.uint64), np.linspace(0.5, 2, terms), np.arange(n), np.zeros(n, int), np.ones(n), 0.1, example, term, counts[example, term])
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.linspace(0.5, 2, terms)
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    for q in range(0, n, 7):
        own = np.flatnonzero(counts[q])
        if not len(own):
            continue
        cosine = weights @ weights[q]
        want = [i for i in np.lexsort((np.arange(n), -np.round(cosine, 9))) if cosine[i] > 0][:15]
        got, values = index.nearest(own, weights[q][own])
        assert got.tolist() == want and np.allclose(values, cosine[want])


def test_one_class_or_none(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, label int"))).collect()] == [0.0, 0.0]
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]


def test_stage_drops_toxic_documents(spark, labelled, tmp_path):
    docs, labels = labelled
    labels.withColumnRenamed("label", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert {i for i in range(400) if i % 5} <= kept and not {i for i in range(0, 400, 5)} & kept and {900, 901, 902} <= kept


# quality


def test_slopes_equal_differences():
    draw = np.random.default_rng(2)
    x, heads = draw.random((12, quality.FEATURES)), np.array([0, 1, 5])
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([0.2, 0.5, 0.3])
    model = quality.Attention.start(x)

    def loss():
        y = model.forward(x, heads)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum()

    slopes = model.slopes(x, heads, label, weight)
    for name, w in model.weights.items():
        for at in ((0,) * w.ndim, tuple(s - 1 for s in w.shape)):
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            assert abs((up - loss()) / 2e-5 - slopes[name][at]) < 1e-6
            w[at] = keep


def test_junk_is_told_from_prose(spark, documents, prose):
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 20 + i % 200).capitalize() + "."
        good = int(i % 4 > 0)
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "*** "), " ".join(w for w in text.split()[:4] for _ in range(30))][i // 4 % 3]
        rows.append((i, text))
        labels.append((i, good))
    table = spark.createDataFrame([x for x in labels if x[0] < 200] + [(5, None), (None, 1)], "doc_id long, label int")
    docs = documents(rows + [(900, None), (901, ""), (902, "  "), (903, "x" * 200_000), (None, "A word."), (7, rows[7][1])])
    told = quality.score(docs, quality.fit(docs, table)).collect()
    assert len(told) == 306
    held = [(r["score"] >= 0.7) == (r["doc_id"] % 4 > 0) for r in told if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert sum(held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and 0 < r["attention"] <= 1 and r["passage"] >= 0 for r in told)


def test_passages_cover_whole_texts():
    words = ["ab"] * 130
    x, owner = quality.passages_of(pa.array([" ".join(words), None, "A! b", "", "x"]))
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 4] and not x[3].any() and not x[5].any()
    assert x[0][quality.N_BYTES + 1] == 63 / 64 and x[2][quality.N_BYTES + 6] == np.log1p(2) / np.log1p(64)


def test_quality_without_both_classes(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, label int")) == 0.5
    assert quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int")) == 1.0
    assert [r["score"] for r in quality.score(docs, 1.0).collect()] == [1.0, 1.0]
    assert quality.score(documents([]), 1.0).collect() == []


def test_quality_learns_from_as_many_passages_as_asked(spark, documents, prose, monkeypatch):
    docs = documents([(1, prose(1, 64 * 100)), (2, prose(2, 640))])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    start, learnt = quality.Attention.start, []
    monkeypatch.setattr(quality.Attention, "start", lambda x: learnt.append(len(x)) or start(x))
    for passages in (64, 80, 1000):
        quality.fit(docs, labels, steps=1, passages=passages)
    quality.fit(docs, labels, steps=1)
    assert learnt == [74, 90, 110, 74]
