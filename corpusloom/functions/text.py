"""Text expressions: white space, answer normalisation, accent folding, word pieces, byte symbols."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# The characters that str.split() and str.strip() treat as white space, as a character-class body.
PY_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The Unicode White_Space property, which leaves out U+001C to U+001F.
UNICODE_SPACE = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The ASCII punctuation an answer loses before it is compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The articles an answer loses before it is compared.
ARTICLES = r"(?U)\b(a|an|the)\b"

# Reserved tokens and their ids.
SPECIAL_IDS = {"<pad>": 0, "<unk>": 1, "<eos>": 2, "<sos>": 3, "<mask>": 4}
SPECIAL_TOKENS = tuple(SPECIAL_IDS)
N_SPECIAL = len(SPECIAL_IDS)
PAD = SPECIAL_IDS["<pad>"]
EOS = SPECIAL_IDS["<eos>"]
SOS = SPECIAL_IDS["<sos>"]
MASK = SPECIAL_IDS["<mask>"]
SPECIAL_PATTERN = "|".join(SPECIAL_IDS)

# The public word-piece pattern of byte-level encoders, with white space spelt out.
PIECE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+"
    r"| ?\p{N}+"
    rf"| ?[^{UNICODE_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])"
    rf"|[{UNICODE_SPACE}]+"
)

_HANGUL = "[가-힣]"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space; the look-behind keeps long inner runs linear."""
    return F.regexp_replace(c, rf"\A[{PY_SPACE}]+|(?<![{PY_SPACE}])[{PY_SPACE}]+\z", "")


def collapse(c: Column) -> Column:
    """One space for every run of white space, none at the ends. Runs that are one space already do not match."""
    return F.trim(F.regexp_replace(c, rf" [{PY_SPACE}]+|[{PY_SPACE}&&[^ ]][{PY_SPACE}]*", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, then no punctuation, then no articles, then single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, ARTICLES, " "))


def answer_tokens(normalized: Column) -> Column:
    """Words of a normalised answer; an empty answer has none."""
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


# ---------------------------------------------------------------- accent folding


@functools.cache
def _fold_table(lowercase: bool) -> tuple[str, str]:
    """Arguments for ``translate``: characters that change, and what they become.

    Built by rule from the Unicode database: decompose, drop marks, lower-case each character. Without marks nothing is
    left to reorder, so folding works character by character. Hangul syllables, the only ones that become several, are
    left to :func:`_decompose_hangul`. Dropped characters come last, which is how ``translate`` drops them.
    """
    source, target, dropped = [], [], []
    # Beyond these two ranges nothing is cased, marked or decomposable.
    for cp in (*range(0x41, 0xAC00), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)):
        c = chr(cp)
        kept = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
        if lowercase:
            kept = "".join(x.lower() for x in kept)
            kept = "".join(x for x in kept if unicodedata.category(x)[0] != "M")
        if kept == c:
            continue
        if kept:
            source.append(c)
            target.append(kept)
        else:
            dropped.append(c)
    return "".join(source + dropped), "".join(target)


def _decompose_hangul(c: Column) -> Column:
    """Each precomposed syllable as its two or three conjoining letters, by the arithmetic rule of the standard."""
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(*[F.lit("" if i == 0 else chr(0x11A7 + i)) for i in range(28)])

    def letters(ch: Column) -> Column:
        at = F.ascii(ch) - 0xAC00
        return F.when(
            (F.ascii(ch) >= 0xAC00) & (F.ascii(ch) <= 0xD7A3),
            F.concat(
                F.get(lead, F.floor(at / 588).cast("int")),
                F.get(vowel, F.floor(F.pmod(at, F.lit(588)) / 28).cast("int")),
                F.get(tail, F.pmod(at, F.lit(28)).cast("int")),
            ),
        ).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), letters), "")


def fold(c: Column, lowercase: bool = True) -> Column:
    """Decompose, strip accents and optionally lower-case, all in the JVM; ASCII text takes the short way."""
    ascii_only = F.octet_length(c) == F.length(c)
    source, target = _fold_table(lowercase)
    folded = F.translate(c, source, target)
    return (
        F.when(ascii_only, F.lower(c) if lowercase else c)
        .when(c.rlike(_HANGUL), _decompose_hangul(folded))
        .otherwise(folded)
    )


def fold_is_one_to_one(c: Column) -> Column:
    """Whether folding keeps every character position."""
    return (F.octet_length(c) == F.length(c)) | ~c.rlike(rf"[\p{{M}}]|{_HANGUL}")


# ---------------------------------------------------------------- pieces and byte symbols


def with_prefix_space(c: Column) -> Column:
    """A leading space for text that has none; empty text stays empty."""
    return let(c, lambda v: F.when(v.startswith(" ") | (v == ""), v).otherwise(F.concat(F.lit(" "), v)))


def split_pieces(c: Column) -> Column:
    """Word pieces of already folded and prefixed text."""
    return F.regexp_extract_all(c, F.lit(PIECE_PATTERN), F.lit(0))


def segments(c: Column) -> Column:
    """Text cut before and after each reserved token that occurs in it literally."""
    return F.filter(
        F.split(c, f"(?={SPECIAL_PATTERN})|(?<={SPECIAL_PATTERN})"), lambda s: F.length(s) > 0
    )


def is_special(c: Column) -> Column:
    return c.isin(*SPECIAL_TOKENS)


def has_special(c: Column) -> Column:
    """Whether a reserved token occurs literally. Few texts hold their first character, so few are searched by the pattern."""
    return F.contains(c, F.lit("<")) & c.rlike(SPECIAL_PATTERN)


def pieces(c: Column, lowercase: bool = True) -> Column:
    """Word pieces for training: reserved tokens are ordinary text."""
    return split_pieces(with_prefix_space(fold(c, lowercase)))


def pieces_for_encoding(c: Column, lowercase: bool = True) -> Column:
    """Word pieces for encoding: a reserved token is one piece, the text around it is cut independently."""
    cut = F.flatten(
        F.transform(segments(c), lambda s: F.when(is_special(s), F.array(s)).otherwise(pieces(s, lowercase)))
    )
    return F.when(has_special(c), cut).otherwise(pieces(c, lowercase))


def uncut_for_encoding(c: Column, lowercase: bool = True) -> Column:
    """:func:`pieces_for_encoding` end to end: reserved tokens and the text between them, for a vocabulary without merges."""

    def whole(s: Column) -> Column:
        return F.make_valid_utf8(with_prefix_space(fold(s, lowercase)))

    cut = F.transform(segments(c), lambda s: F.when(is_special(s), s).otherwise(whole(s)))
    return F.when(has_special(c), cut).otherwise(F.array(F.coalesce(whole(c), F.lit(""))))


def prefixed(c: Column, lowercase: bool = True) -> Column:
    """For each of :func:`pieces_for_encoding`, whether a space that the text does not have was put in front of it; null for
    text without reserved tokens, where only the first piece can be."""

    def flags(s: Column) -> Column:
        rest = F.array_repeat(F.lit(False), F.greatest(F.size(pieces(s, lowercase)) - 1, F.lit(0)))
        first = fold(s, lowercase).rlike(r"\A[^ ]")
        return F.filter(F.concat(F.array(F.when(fold(s, lowercase) != "", first)), rest), lambda f: f.isNotNull())

    cut = F.flatten(
        F.transform(segments(c), lambda s: F.when(is_special(s), F.array(F.lit(False))).otherwise(flags(s)))
    )
    return F.when(has_special(c), cut)


def origins(c: Column, lowercase: bool = True) -> Column:
    """For each character of the folded text, the position of the character it came from; null where none has moved."""
    moved = F.flatten(
        F.transform(
            F.filter(F.split(c, ""), lambda ch: F.length(ch) > 0),
            lambda ch, i: F.array_repeat(i.cast("int"), F.length(fold(ch, lowercase))),
        )
    )
    return F.when(~fold_is_one_to_one(c), moved)


@functools.cache
def byte_symbols() -> str:
    """The visible character of each byte value, by the public byte-level rule: printable bytes stand for themselves,
    the others take the code points from 256 on, in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(hidden)) for b in range(256))


@functools.cache
def byte_ids() -> list[int]:
    """Vocabulary id of each byte value: after the reserved tokens, in code-point order of the visible characters."""
    order = {s: i for i, s in enumerate(sorted(byte_symbols()))}
    return [N_SPECIAL + order[s] for s in byte_symbols()]


_LATIN1 = "".join(chr(b) for b in range(256))


def _one_char_per_byte(c: Column) -> Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def to_byte_symbols(c: Column) -> Column:
    """Text as one visible character per UTF-8 byte."""
    return F.translate(_one_char_per_byte(c), _LATIN1, byte_symbols())


def bytes_of_symbols(token: str) -> str:
    """A token's byte symbols as one character up to U+00FF for each byte."""
    return token.translate(str.maketrans(byte_symbols(), _LATIN1))


def from_bytes(c: Column) -> Column:
    """Text of a string with one character up to U+00FF for each byte; bytes that are not UTF-8 become the replacement character."""
    return F.make_valid_utf8(F.encode(c, "ISO-8859-1").cast("string"))


def from_byte_symbols(c: Column) -> Column:
    """Inverse of :func:`to_byte_symbols`; bytes that are not UTF-8 become the replacement character."""
    return from_bytes(F.translate(c, byte_symbols(), _LATIN1))
