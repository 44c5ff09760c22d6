"""The audit of sources against a loop over all terms, with blocks and groups small enough that there are many of each."""

import random
import re
from collections import Counter

import pytest
from corpusloom.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term int, value string"


def brute_force(rows, min_docs, top):
    counts, kept, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        counts.setdefault((lang, source), Counter()).update(terms)
        kept.setdefault(lang, Counter()).update(set(terms))
        groups.setdefault(lang, set()).add(source)
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in kept[lang].items() if n >= min_docs]

        def p(names):
            n = {t: sum(counts[lang, s][t] for s in names) for t in terms}
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(terms)) for t in terms}

        whole = p(sources)
        own = {s: p([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in terms), o.encode()) for o in sources if o != s]
            found = [(whole[t] - own[s][t], t.encode()) for t in terms if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out.extend((lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items))
    return sorted(out)


def drawn(n, n_sources, seed):
    draw = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{'xyz'[k % 3] * (k // 26)}" for k in range(60)] + ["É", "été", "naïve", "Zero", "zero", "漢字"]
    weight = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(n):
        source = 0 if draw.random() < 0.4 else draw.randrange(n_sources)  # one source holds a large share
        text = " ".join(draw.choices(words, weight, k=draw.randrange(0, 30))) + draw.choice(["", "-A1b", "\x00c", " 5"])
        rows.append((k, text, draw.choice(["en", "de", None]), f"s{source}", 1, "x"))
    return rows


@pytest.mark.parametrize("block, group", [(512, 48), (7, 3), (1, 1)])
def test_as_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "GROUP_SOURCES", group)
    rows = drawn(150, 8, 3)
    rows += [(1000, None, "en", "empty", 1, "x"), (1001, "123", "fr", "a", 1, "x"), (1002, "once", "fr", "b", 1, None), (1003, "A a", None, None, 0, None)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(docs, 5, 4).collect()) == brute_force(rows, 5, 4)


def test_columns_of_a_matrix_are_split(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_COLUMNS", 5)
    rows = drawn(80, 5, 4)
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(tuple(r) for r in divergence.audit(docs, 3, 50).collect()) == brute_force(rows, 3, 50)


def test_sources_without_a_kept_term(spark):
    docs = spark.createDataFrame([(1, "a", "x", "s", 0, ""), (2, "b", "x", "t", 0, "")], COLUMNS)
    found = [tuple(r) for r in divergence.audit(docs, 30).collect()]
    assert sorted(found) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]
    assert divergence.audit(docs.limit(0)).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 7)
    text = "Ab c\x00défg " * 9 + "x" * 40 + " Q"
    found = [t for terms in divergence.terms_of(text.encode()) for t in terms]
    assert found == [b"ab", b"c", "défg".encode()] * 9 + [b"x" * 40, b"q"]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12, 9 * 10**17, 10**6)], "n long, total long, terms long")
    told = row.select(divergence.share("n", "total", "terms")).first()[0]
    assert told == 1 + 10**9 * (3 * 10**12 + 5) // (9 * 10**17 + 5 * 10**6)


def test_held_counts_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 3)
    rows = drawn(60, 4, 5)
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(tuple(r) for r in divergence.audit(docs, 2, 5).collect()) == brute_force(rows, 2, 5)
