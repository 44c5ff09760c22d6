import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X

ODD = [
    "Hé 中x", " hi  there", "", "  ", "áb", "각a", "ﬁ İ", "\xa0A\x1c b　", "ΑΣ", "́",
    "Hello the Café's  naïve world\n\n x", "日本語のthing 12345 ½²", "emoji 👩‍👩‍👧 the ", "नमस्ते दुनिया", "IT'S we'LL",
]


def table(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(spark, values, expr):
    return [r["x"] for r in table(spark, values).select("i", expr.alias("x")).orderBy("i").collect()]


def test_strip_and_collapse_are_those_of_python(spark):
    values = [*ODD, "\x1c a \x85b  c \x1f", "a\tb  c\r\nd"]
    assert column(spark, values, X.strip(F.col("t"))) == [v.strip() for v in values]
    assert column(spark, values, X.collapse(F.col("t"))) == [" ".join(v.split()) for v in values]


def test_normalize_answer(spark):
    given = ['The  "Cat\'s" a-hat', "an", "éa an", "A  THE\xa0dog", ""]
    assert column(spark, given, X.normalize_answer(F.col("t"))) == ["cats ahat", "", "éa", "dog", ""]


def test_bytes_round_trip(spark):
    assert column(spark, ODD, X.from_byte_symbols(X.to_byte_symbols(F.col("t")))) == ODD


def test_byte_ids_follow_code_points():
    assert sorted(X.byte_ids()) == list(range(5, 261))
    assert X.byte_ids()[ord(" ")] == 225 and X.byte_ids()[ord("!")] == 5


def test_pieces_and_folding_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    norm = tokenizers.normalizers
    fold = norm.Sequence([norm.NFD(), norm.StripAccents(), norm.Lowercase()])
    cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert column(spark, ODD, X.fold(F.col("t"))) == [fold.normalize_str(v) for v in ODD]
    symbols = column(spark, ODD, F.transform(X.pieces(F.col("t")), X.to_byte_symbols))
    assert symbols == [[p for p, _ in cut.pre_tokenize_str(fold.normalize_str(v))] for v in ODD]


def test_folding_every_letter(spark):
    tokenizers = pytest.importorskip("tokenizers")
    norm = tokenizers.normalizers
    fold = norm.Sequence([norm.NFD(), norm.StripAccents(), norm.Lowercase()])
    letters = [chr(c) for c in range(0x21, 0x3000)] + [chr(c) for c in range(0xAC00, 0xD7A4, 7)]
    got = column(spark, letters, X.fold(F.col("t")))
    # Marks that the library's older Unicode tables do not know yet are dropped here.
    differ = [c for c, g in zip(letters, got) if g != fold.normalize_str(c)]
    assert all(g == "" or len(g) == 1 for c, g in zip(letters, got) if c in differ) and len(differ) < 120
    assert not [c for c in differ if ord(c) < 0x7F0 or ord(c) >= 0xAC00]
