import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import anchors, dedup, near_groups
from corpusloom.llm.anchors import _blocks
from corpusloom.llm.common import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, k, part, whole):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and whole * common >= part * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        root = find(i)
        least[root] = min(least.get(root, doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def corpus(prose):
    draw = random.Random(4)
    rows = []
    for g in range(12):
        words = prose(g, draw.choice([2, 6, 40, 120])).split()
        for _ in range(draw.choice([1, 2, 9, 25])):
            own = list(words)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(["new", "other", "third"])
            rows.append((len(rows) * 3 + 1, draw.choice([" ", "  ", "\n"]).join(own)))
    rows += [(9000, ""), (9001, None), (9002, " \t"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, prose(99, 20000)), (9007, prose(99, 20000).upper())]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "similarity"), [(3, (85, 100)), (5, (80, 100))])
def test_components_equal_brute_force(documents, corpus, k, similarity):
    got = dedup.near_documents(documents(corpus), k, similarity).collect()
    want = brute_components(corpus, k, *similarity)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_links_through_the_middle(documents):
    words = [f"w{i}" for i in range(103)]
    step = lambda n: " ".join(w + "x" * (i < 2 * n) for i, w in enumerate(words))
    rows = [(i, step(i)) for i in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_documents(documents(rows), 3, (85, 100)).collect()}
    assert got == {doc: c for doc, (_, c) in brute_components(rows, 3, 85, 100).items()}


def test_rows_without_id_repeats_and_empty_table(documents):
    rows = dedup.near_documents(documents([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a b c")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [
        ("2", "2", True),
        ("4", "2", False),
        ("4", "2", False),
        ("None", "None", True),
        ("None", "None", True),
    ]
    assert dedup.near_documents(documents([])).collect() == []


def test_texts_that_share_an_id_are_judged_one_by_one(spark, documents, prose):
    def edited(text, n):
        words = text.split()
        for i in range(n):
            words[40 * i + 7] = "other"
        return " ".join(words)

    a, b = prose(31, 300), prose(32, 300)
    rows = [(1, a), (1, b), (2, edited(a, 1)), (3, edited(b, 1))]
    rows += [(9, prose(33, 200)), (9, prose(34, 200)), (9, prose(35, 200)), (5, prose(34, 200)), (8, edited(prose(35, 200), 1))]
    told = dedup.near_documents(documents(rows)).collect()
    by_text = {spark.range(1).selectExpr(f"xxhash64('{t}') h").first()["h"]: t for _, t in rows}
    got = sorted((r["doc_id"], by_text[r["text_hash"]], r["component_id"], r["kept"]) for r in told)
    component = [1, 1, 1, 1, 9, 5, 8, 5, 8]
    assert got == sorted((i, t, c, i == c) for (i, t), c in zip(rows, component))
    both_kept = corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in both_kept) == sorted([(1, a), (1, b), (5, rows[7][1]), (8, rows[8][1]), rows[4]])


def test_copies_with_one_id_stay_once(spark, documents, prose):
    text = prose(41, 300)
    near = text.replace(text.split()[150], "changed", 1)
    docs = documents([(4, text), (4, near), (4, text.upper()), (4, text), (6, near), (7, "one two"), (7, "")])
    out = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"], len(r["text"].split())) for r in out) == [(4, 300), (7, 0), (7, 2)]


def test_stage_keeps_one_of_each_group(spark, documents):
    docs = documents([(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, None), (8, ""), (None, "z")])
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "7", "8", "None"]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_repeated_passages(documents, prose):
    passage, near = prose(1, 60), prose(1, 60).replace(prose(1, 60).split()[30], "changed", 1)
    rows = [(1, prose(2, 40) + "\n" + passage), (2, near + "\n" + prose(3, 70)), (3, prose(4, 80)), (4, f"{passage}\n{passage}"), (5, None), (6, ""), (None, passage)]
    docs = documents(rows)
    found = dedup.repeated_passages(docs)
    got = sorted((r["doc_id"], r["paragraph"], r["group_doc"], r["group_paragraph"], r["removed"], r["copies"]) for r in found.collect())
    assert got == [(1, 1, 1, 1, False, 4), (2, 0, 1, 1, True, 4), (4, 0, 1, 1, True, 4), (4, 1, 1, 1, True, 4)]
    texts = {r["doc_id"]: r["text"] for r in dedup.without_repeats(docs, found).collect()}
    assert texts[1] == rows[0][1] and texts[2] == prose(3, 70) and texts[4] == "" and texts[5] is None and texts[3] == rows[2][1]
    assert dedup.repeated_passages(documents([])).collect() == []


def inside(docs, rows, passage, doc, found):
    """Words of the passage in a document that rows of the result cover."""
    text = dict(rows)[doc]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [k for k, line in enumerate(text.split("\n")) for _ in line.split()]
    part = passage.split()
    first = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    covered = set()
    for r in found:
        if r["doc_id"] == doc and r["first_word"] is not None:
            covered |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
        elif r["doc_id"] == doc and r["lines"]:
            covered |= {i for i, line in enumerate(lines) if line in r["lines"]}
    return len(covered & set(range(first, first + len(part))))


def test_passage_inside_a_longer_line(documents, prose):
    passages = [prose(100 + i, n) for i, n in enumerate([49, 50, 59, 80])]
    rows = []
    for i, passage in enumerate(passages):
        rows.append((2 * i, f"{prose(200 + i, 40)} {passage} {prose(300 + i, 39)}"))
        rows.append((2 * i + 1, f" {prose(400 + i, 10)}\n{prose(500 + i, 70)} {passage}  {prose(600 + i, 120)}\n{prose(700 + i, 5)}"))
    docs = documents(rows)
    found = dedup.repeated_passages(docs)
    got = found.collect()
    for i, passage in enumerate(passages):
        n = len(passage.split())
        assert inside(docs, rows, passage, 2 * i + 1, got) == n, n
        assert inside(docs, rows, passage, 2 * i, got) >= 25
        own = [r for r in got if r["doc_id"] == 2 * i + 1]
        assert all((r["group_doc"], r["group_paragraph"], r["paragraph"], r["copies"], r["removed"]) == (2 * i, 0, 1, 2, True) for r in own)
    texts = {r["doc_id"]: r["text"] for r in dedup.without_repeats(docs, found).collect()}
    for i in range(len(passages)):
        assert texts[2 * i] == rows[2 * i][1]
        assert texts[2 * i + 1] == f" {prose(400 + i, 10)}\n{prose(500 + i, 70)} {prose(600 + i, 120)}\n{prose(700 + i, 5)}"


def test_words_repeated_over_and_over_stay_once(documents):
    docs = documents([(1, "ha " * 100 + "end"), (2, "a b c d e f g h " * 30)])
    texts = {r["doc_id"]: r["text"].split() for r in dedup.without_repeats(docs, dedup.repeated_passages(docs)).collect()}
    assert 25 <= len(texts[1]) < 60 and set(texts[1]) == {"ha", "end"}
    assert 25 <= len(texts[2]) < 100 and set(texts[2]) == set("abcdefgh")


def test_passage_in_short_lines(documents, prose):
    wrap = lambda words, n, end="\n": end.join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    passage, edited = prose(1, 60).split(), prose(2, 240).split()
    copy = [*edited]
    copy[45], copy[130] = "changed", "changed"
    rows = [(1, f"{prose(3, 30)}\n{wrap(passage, 12)}\n{prose(4, 40)}"), (2, f"{prose(5, 33)}\n\n{wrap(passage, 24)}\n{prose(6, 50)}")]
    rows += [(3, f"{prose(7, 30)}\n{wrap(edited, 6)}"), (4, f"short line\n{wrap(copy, 6)}\n{prose(8, 40)}")]
    docs = documents(rows)
    found = dedup.repeated_passages(docs)
    got = found.collect()
    assert inside(docs, rows, prose(1, 60), 2, got) == 60
    assert inside(docs, rows, " ".join(copy), 4, got) > 200
    # an edited copy of joined lines is found as a whole
    assert any(r["first_word"] is None and "changed" in " ".join(rows[3][1].split("\n")[i] for i in r["lines"]) for r in got if r["doc_id"] == 4)
    texts = {r["doc_id"]: r["text"] for r in dedup.without_repeats(docs, found).collect()}
    assert texts[1] == rows[0][1] and texts[3] == rows[2][1]
    assert [line for line in texts[2].split("\n") if line] == [prose(5, 33), prose(6, 50)]


@pytest.mark.parametrize(
    ("counts", "ends", "want"),
    [
        ([30, 5, 5, 30], [True] * 4, []),
        ([10, 10, 10, 3, 30, 9], [False] * 6, [[0, 1, 2, 3]]),
        ([10, 0, 10, 10, 0, 0, 3, 30], [False] * 8, [[0, 2, 3, 6]]),
        ([20, 20, 20, 20], [False, True, False, True], [[0, 1], [2, 3]]),
        ([20, 20, 0, 20, 20], [False] * 5, [[0, 1], [3, 4]]),
        ([], [], []),
    ],
)
def test_short_lines_joined(counts, ends, want):
    assert list(_blocks(counts, ends, 25)) == want


def test_tables_of_steps_that_are_done_take_no_disk(spark, tmp_path, monkeypatch):
    from corpusloom import session

    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} {i}\n" + "\n".join([f"short line {i}"] * 9)) for i in range(8)], "doc_id long, text string")
    found = dedup.repeated_passages(docs)
    left = {p.name.rsplit("-", 5)[0].split("-")[0] for p in tmp_path.glob("*/*")}
    assert found.where("removed").count() >= 7 and "paragraphs" in left
    assert not left & {"signed", "classes", "members", "sets", "joined", "items", "places", "anchors"}


def test_buckets_of_the_same_classes_come_once(spark):
    one, two, three = (np.arange(n, n + 140, dtype=np.uint16) for n in (0, 1000, 2000))
    two[10:] = one[10:]  # all bands but the first two, as two of the other table
    three[:5] = one[:5]  # the first band with one only
    rows = [(n, 60, s.tobytes()) for n, s in enumerate((one, two, three, np.arange(5000, 5140, dtype=np.uint16)))]
    classes = spark.createDataFrame(rows, "node long, size long, signature binary")
    members = near_groups._members(classes, 28, 5).collect()
    assert sorted((r["band"], r["id"], r["n"], r["shingles"]) for r in members) == [(0, 0, 2, 120), (0, 2, 2, 120), (2, 0, 2, 120), (2, 1, 2, 120)]


def test_equal_words_beside_two_copies_are_counted_row_by_row():
    hashes = [[], [1], [1, 2, 3], [1, 2, 3], [9, 2, 3], [4, 5]], [[1], [1], [1, 2, 3, 4], [1, 9, 9], [1, 2, 3], []]
    one, two = (pa.array([np.array(h, np.uint64).tobytes() for h in rows], pa.binary()) for rows in hashes)
    assert anchors._equal(one, two).tolist() == [0, 1, 3, 1, 0, 0]
    assert anchors._equal(one.slice(2, 3), two.slice(2, 3)).tolist() == [3, 1, 0]
    assert anchors._equal(one.slice(0, 1), two.slice(5, 1)).tolist() == [0]


def test_texts_of_documents_are_cut_into_paragraphs_once(spark, monkeypatch):
    calls = []
    cut = dedup.paragraphs
    monkeypatch.setattr(dedup, "paragraphs", lambda *a: calls.append(1) or cut(*a))
    names, write = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: names.append((name, "MapInArrow" in df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    long, short = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(13))
    docs = spark.createDataFrame([(i, f"{long}\n\n{short}\n{short} x\n") for i in range(3)], "doc_id long, text string")
    rows = dedup.repeated_paragraphs(docs, 25, 5, (80, 100)).collect()
    found = sorted((r["doc_id"], r["paragraph"], r["n_words"], r["lines"], r["copies"]) for r in rows)
    assert found == [(d, *row, 3) for d in range(3) for row in ((0, 30, [0]), (2, 27, [2, 3]))]
    assert len(calls) == 1 and [n for n, python in names if python] == ["all_paragraphs"]
