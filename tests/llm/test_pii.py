import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    parts = ["a.b@c.de", "x@y", "a@b@c.d", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (415) 555-0100", "+49.30.123456"]
    parts += ["+1", "+1 2", "++44 20 7946 0958.", "é𝒳", "word", "\n", "7", "12", "378282246310005", "a_b@c.d_e@f.gh", "-1-2-3-4-5-6-7-8-9-0-1-2-3", "user@mail.example.com", "+", ".", "%"]
    out = [(i, "".join(draw.choice(parts) + draw.choice(["", " ", " ", "-", ", "]) for _ in range(draw.randint(0, 14)))) for i in range(400)]
    return out + [(900, None), (901, ""), (902, "9" * 5000), (903, "a" * 20000 + "@"), (904, "1.2.3.4 " * 800), (905, "12 " * 3000), (906, "1." * 4000), (None, "a@b.cd")]


def test_base_spans_equal_the_patterns(documents, rows):
    found = pii.find(documents(rows)).select("doc_id", "source", pii.text_form(F.filter("spans", lambda s: s["base"])).alias("base"), pii.text_form(F.col("spans")).alias("all"))
    got = {r["doc_id"]: r for r in found.collect()}
    for doc, text in rows:
        assert got[doc]["base"] == brute(text), text[:200]
        assert set(got[doc]["base"].split(",")) <= {*got[doc]["all"].split(","), ""}


def test_context_adds_what_the_patterns_miss(documents):
    sure = [(i, f"please call me, phone (415) 555-0{i:03d} today or mail joe{i}@mail.com") for i in range(200)]
    odd = [(1000 + i, f"see version 1.2.{i}.999 and order 123-{i:04d}") for i in range(50)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(documents(sure + odd)).collect()}
    assert [pii.KINDS[s["kind"]] for s in found[7]] == ["phone", "email"] and not found[7][0]["base"] and found[7][0]["probability"] > 0.9
    assert all(not found[1000 + i] for i in range(50))


def test_estimation_tells_labelers_apart():
    counts = {"+++++": 500, "++0++": 300, "+-0++": 20, "--0--": 400, "0--+-": 200, "0++++": 60, "--+--": 10}
    reliability, belief = pii.estimate(counts)
    assert belief["+++++"] > 0.99 > 0.01 > belief["--0--"] and belief["0++++"] > 0.9
    assert reliability.on_true[0]["+"] > reliability.on_false[0]["+"] and 0.4 < reliability.prior < 0.8


def test_redaction(spark, documents):
    docs = documents([(1, "é a@b.cd and 1.2.3.4!"), (2, None), (3, ""), (4, "none"), (4, "none"), (5, "pay 4111 1111 1111 1111")])
    out = corpus_pipeline.redact_personal_data(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.where("doc_id <> 2").collect())
    assert got[:4] == [(1, "é <email> and <ip>!", 19), (3, "", 0), (4, "none", 4), (4, "none", 4)]
    assert "4111" not in got[4][1] and out.where("doc_id = 2").first()["text"] is None
    assert pii.find(documents([])).collect() == []


def test_main_path_is_native(documents):
    plan = pii.find(documents([(1, "a@b.cd")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
