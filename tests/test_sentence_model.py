from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.catalog import derived as D
from corpusloom.operators import corpus, sentence_model
from corpusloom.operators.sentence_model import SentenceModel, learn_sentence_model


def documents(spark, texts):
    return spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "source string, doc_id long, text string")


def cut(spark, model, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", model.sentence_array(F.col("t")).alias("s"))
    return [r["s"] for r in sorted(rows.collect())]


def prose(k):
    who = ["Smith", "Jones", "Brown", "Meyer"][k % 4]
    what = ["walked home", "wrote a letter", "met old friends", "closed the shop", "sang"][k % 5]
    return f"Yesterday Dr. {who} {what}. The weather was fine, as always. He paid 5 dollars, approx. half of it. The end came soon! Was it late? The river ran. At home he ran on, sang in the shop and always wrote of friends and of a letter."


def test_a_title_ends_no_sentence(spark):
    model = learn_sentence_model(documents(spark, [prose(k) for k in range(60)]))
    assert "dr" in model.abbreviations and "the" in model.starters and "home" not in model.abbreviations
    made = cut(spark, model, "I saw Dr. Smith today. The Dr. is in. (Dr. Meyer left.) Who knows? We do! ok")
    assert made == [["I saw Dr. Smith today.", "The Dr. is in.", "(Dr. Meyer left.) Who knows?", "We do!", "ok"]]
    assert cut(spark, model, "He met the dr. The end.") == [["He met the dr.", "The end."]]


def test_pairs_that_belong_together(spark):
    model = SentenceModel(("no",), ("the", "five"), ("no five",))
    assert cut(spark, model, "See no. Five here. Say no. The end. no. the end") == [["See no. Five here.", "Say no.", "The end.", "no. the end"]]


def test_without_abbreviations_it_cuts_like_the_pattern(spark):
    docs = D.paragraph_documents(spark, SMALL)
    for filtered in (True, False):
        a = corpus.sentences(docs, SentenceModel(), filtered=filtered)
        b = corpus.sentences(docs, filtered=filtered)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_odd_paragraphs(spark):
    model = SentenceModel(("a",), ("b",))
    assert cut(spark, model, "", None, " . ", "a. B", "x.\n\ty.  z", "a. b") == [[""], None, ["."], ["a.", "B"], ["x.", "y.", "z"], ["a. b"]]
    assert learn_sentence_model(documents(spark, ["", None, "..."])) == SentenceModel()


def test_scores_are_those_of_the_published_formula(spark):
    import math

    counts = spark.createDataFrame([("dr", 50, 50), ("u.s", 20, 18), ("home", 100, 10), ("x", 1000, 0)], "word string, n long, stops long")
    got = {r["word"]: r["score"] for r in sentence_model.abbreviation_scores(counts).collect()}
    p = 78 / 1170

    def score(n, k, letters, periods):
        ratio = -2 * (k * math.log(p) + (n - k) * math.log(1 - p) - k * math.log(0.99) - (n - k) * math.log(0.01))
        return ratio * math.exp(-letters) * (periods + 1) * letters ** -(n - k)

    assert set(got) == {"dr", "u.s", "home"}
    for word, args in {"dr": (50, 50, 2, 0), "u.s": (20, 18, 2, 1), "home": (100, 10, 4, 0)}.items():
        assert abs(got[word] - score(*args)) < 1e-9 * abs(score(*args)) + 1e-12


def test_the_text_is_counted_once(spark, monkeypatch):
    made = sentence_model.written
    names = []
    monkeypatch.setattr(sentence_model, "written", lambda df, name: names.append(name) or made(df, name))
    docs = documents(spark, ["He met Dr. Who. He met Dr. Who. (The End.) the end"])
    pairs = sentence_model.word_pairs(docs)
    assert names == ["counted_words"] and "ExplodeMode" not in pairs._jdf.queryExecution().toString() and "explode" not in pairs._jdf.queryExecution().toString()
    got = sorted((r["word"], r["stop"], r["ends"], r["following"] or "", r["times"]) for r in pairs.collect())
    assert got == [
        ("dr", True, True, "who", 2), ("end", False, False, "", 1), ("end.", False, False, "", 1), ("he", False, False, "", 2),
        ("met", False, False, "", 2), ("the", False, False, "", 1), ("the", False, False, "", 1), ("who", True, True, "he", 1), ("who", True, True, "the", 1),
    ]


def cut_rows(rows):
    return sorted((r["doc_id"], r["para"], r["pos"], r["sent"]) for r in rows.collect())


def test_lists_too_long_for_an_expression_stay_whole(spark):
    texts = [prose(k) for k in range(60)] + ["See no. Five. No. The end is near no. five.\n\nWho? Dr. Meyer. The U.S. The end.", "", None, " . ", "Dr.\n\n\n\nDr. The. a. ok"] * 6
    docs = documents(spark, texts).select("source", (F.col("doc_id") % 7).alias("doc_id"), "text")
    small = learn_sentence_model(docs)
    assert min(len(small.abbreviations), len(small.starters), len(small.collocations)) > 1
    want = cut_rows(corpus.sentences(docs, small, filtered=False))
    pairs = corpus.adjacent_pairs(docs, small).collect()
    large = learn_sentence_model(docs, most=1)
    assert cut_rows(corpus.sentences(docs, large, filtered=False)) == want
    assert sorted(corpus.adjacent_pairs(docs, large).collect()) == sorted(pairs)
    assert large.joins and not small.joins
    for field in ("abbreviations", "starters", "collocations"):
        known = getattr(large, field)
        assert sorted(r["known"] for r in known.collect()) == list(getattr(small, field))
        one = SentenceModel(**{f: getattr(large if f == field else small, f) for f in ("abbreviations", "starters", "collocations")})
        assert cut_rows(corpus.sentences(docs, one, filtered=False)) == want
    assert want != cut_rows(corpus.sentences(docs, SentenceModel(), filtered=False))


def test_given_tables_cut_like_given_tuples(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, " . ", "a. B", "x.\n\ty.  z", "a. b", "Hm! a. \"B c.\" a. B. (a. D! a. C) a.", "no. Five no. four 1. Five"])], "i int, t string")
    lists = {"abbreviations": ("a", "no", "1"), "starters": ("b", "five"), "collocations": ("no five",)}
    want = sorted(SentenceModel(**lists).with_sentences(rows, "t", "s").collect())
    assert [r["s"] for r in want][4:] == [["x.", "y.", "z"], ["a. b"], ["Hm!", "a.", "\"B c.\" a.", "B.", "(a. D!", "a. C) a."], ["no. Five no. four 1.", "Five"]]
    tables = {f: spark.createDataFrame([(w,) for w in words], "known string") for f, words in lists.items()}
    for some in (tables, *({**lists, f: t} for f, t in tables.items())):
        assert sorted(SentenceModel(**some).with_sentences(rows, "t", "s").collect()) == want


def test_starters_are_told_with_all_abbreviations(spark):
    """After a title no sentence starts, however many titles there are."""
    sure = [("home", "the"), ("shop", "then")]
    titles = [("dr", "smith"), ("mr", "jones"), ("st", "paul")]
    rows = [(w, True, True, b, 300) for w, b in sure + titles]
    rows += [(w, False, False, None, 900) for w, _ in sure] + [(w, False, False, None, 310) for w in ("the", "then", "smith", "jones", "paul")]
    pairs = spark.createDataFrame([*rows, ("filler", False, False, None, 9000)], "word string, stop boolean, ends boolean, following string, times long")
    counts = sentence_model.word_counts(pairs)
    for most in (1, 20_000):
        model = sentence_model.learn_from_pairs(pairs, most=most)
        scores = sentence_model.starter_scores(pairs, counts, model.abbreviations).where(F.col("score") >= sentence_model.STARTER)
        assert sorted(r["word"] for r in scores.collect()) == ["the", "then"]
