import random
import re

import pyarrow as pa
import pytest

from corpusloom.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in windows}
    for _, text in docs:
        own, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (at := windows.get(tuple(own[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= at
        yield len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


@pytest.fixture(scope="module")
def tables(prose):
    draw = random.Random(8)
    items = [(i, prose(i, draw.choice([1, 3, 12, 13, 14, 40])) + ".") for i in range(25)] + [(99, None), (98, "!!"), (None, prose(7, 20)), (97, "the a the a the a the a the a the a the a the a")]
    docs = []
    for d in range(60):
        own = prose(1000 + d, draw.choice([0, 5, 60, 400])).split()
        for _ in range(draw.randint(0, 3)):
            part = words(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(part) - 5))
            part = part[a : a + draw.choice([4, 12, 13, 20, 99])]
            at = draw.randint(0, len(own))
            own[at:at] = [w.upper() if draw.random() < 0.5 else w for w in part]
        docs.append((d, draw.choice([" ", ", ", "\n"]).join(own)))
    docs += [(70, None), (71, ""), (72, "the a " * 3000), (73, items[3][1]), (73, items[3][1]), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [1 << 22, 120])
def test_hits_equal_brute_force(spark, documents, tables, block_words):
    docs, items = tables
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    found = decontamination.contamination(documents(docs), benchmark, carry=["doc_id", "source", "text"], block_words=block_words).collect()
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found)
    want = sorted((str(i), str(t), *w) for (i, t), w in zip(docs, brute(docs, items)))
    assert got == want
    for r in found:
        assert sum(s["past"] - s["first"] for s in r["hit_spans"]) == r["n_hit"] and r["n_items"] == len(r["items"])


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(documents([(1, "a b c")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows] == [(3, 0, [], False)]
    assert decontamination.contamination(documents([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_long_items_are_cut_with_overlap(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 20)
    text = prose(3, 100)
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = decontamination.contamination(documents([(i, " ".join(text.split()[i : i + 13])) for i in range(88)]), benchmark).collect()
    assert all(r["n_hit"] == 13 for r in rows)


def test_phrase_that_many_items_share(spark, documents, prose, monkeypatch):
    phrase = prose(500, 16)
    items = [(i, f"{prose(600 + i, 20)} {phrase} {prose(1600 + i, 3)}") for i in range(300)] + [(i, "two words") for i in range(300, 340)]
    docs = [(d, f"{prose(3000 + d, 30)} {phrase} {prose(4000 + d, 9)} two words") for d in range(20)] + [(50, items[7][1]), (51, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(documents(docs), benchmark, carry=["doc_id", "text"]).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found)
    assert got == sorted((i, *w) for (i, _), w in zip(docs, brute(docs, items)))

    hashed = [decontamination.words_of(pa.array([t]), decontamination.ALNUM)[0] for _, t in items]
    index = decontamination.Index([str(i) for i, _ in items], hashed)
    hashes, text, _, _ = decontamination.words_of(pa.array([t for _, t in docs]), decontamination.ALNUM)

    def hits():
        parts = list(index.hits(hashes, text))
        return max(len(first) for first, _, _ in parts), sorted({x for part in parts for x in zip(*(c.tolist() for c in part))})

    whole = hits()
    monkeypatch.setattr(decontamination, "EXPANDED", 97)
    largest, same = hits()
    assert largest <= 97 < whole[0] and same == whole[1]
