import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def rows(prose):
    return [(i, prose(i // 3, 30 + 7 * i)) for i in range(30)] + [(50, None), (51, ""), (52, "é𝒳 one"), (53, prose(1, 3000)), (54, prose(1, 3000) + " end"), (-7, "first of all of these")]


def test_edited_texts_and_likeness(documents, rows):
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(documents(rows)).collect()}
    order = sorted(rows)
    for at, (doc, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(runs(text), runs(edited))) < 0.25
        assert abs(r["near_next"] - jaccard(runs(text), runs(following))) < 0.25
        if len(runs(text) | runs(following)) <= fingerprints.K:
            assert r["near_next"] == jaccard(runs(text), runs(following))


def test_repeated_rows_and_null_ids(documents):
    got = fingerprints.edited_likeness(documents([(1, "a b c d"), (1, "a b c d"), (2, "x y"), (None, "n"), (None, "n")])).collect()
    assert len(got) == 5 and len({str(r) for r in got}) == 3
    assert fingerprints.edited_likeness(documents([])).collect() == []
    alone = fingerprints.edited_likeness(documents([(1, "abcd")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_sketches_merge_and_estimate(documents, prose):
    whole = prose(5, 4000).split()
    a, b = " ".join(whole[:3000]), " ".join(whole[1000:])
    table = fingerprints.fingerprints(documents([(1, a), (2, b), (3, " ".join(whole)), (4, a)], 1), k=256)
    s = {r["doc_id"]: r["sketch"] for r in table.collect()}
    assert s[1] == s[4] and s[1]["hashes"] == sorted(s[1]["hashes"]) and len(s[1]["hashes"]) == 256
    wide = table.groupBy().pivot("doc_id", [1, 2, 3]).agg(F.first("sketch"))
    one, two, three = (F.col(f"`{i}`") for i in (1, 2, 3))
    row = wide.select(
        fingerprints.merge(one, two, 256).alias("merged"),
        fingerprints.resemblance(one, two, 256).alias("r"),
        fingerprints.containment(one, three, 256).alias("c"),
    ).first()
    assert row["merged"] == s[3]
    assert abs(row["r"] - 0.5) < 0.12 and row["c"] > 0.85
    assert abs(s[3]["size"] - 3996) < 800


def test_main_path_is_native(documents):
    plan = fingerprints.edited_likeness(documents([(1, "a b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
