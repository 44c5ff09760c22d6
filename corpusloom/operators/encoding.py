"""Text to ids and back.

The JVM folds the text and cuts it into pieces; an Arrow function then merges each distinct piece of a batch once and hands
the ids back by position. Nothing is shuffled, so no frequent piece can become a hot key, and the merge rules that travel to
the tasks are bounded by the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.merging import examples_function, id_pairs_function, ids_function, spans_function
from ..functions.text import (
    EOS,
    N_SPECIAL,
    PAD,
    SOS,
    SPECIAL_TOKENS,
    byte_ids,
    from_bytes,
    origins,
    pieces_for_encoding,
    prefixed,
    uncut_for_encoding,
)
from .vocabulary import Vocabulary

_SPECIAL_IDS = {t: i for i, t in enumerate(SPECIAL_TOKENS)}


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a text. A reserved token that occurs literally keeps its reserved id. Null counts as empty."""
    run = ids_function(vocabulary.merges, byte_ids(), _SPECIAL_IDS)
    return run(_pieces(text, vocabulary))


def encode_both(first: Column, second: Column, vocabulary: Vocabulary) -> Column:
    """``struct(first, second)``: the ids of two texts of a row, from one worker a task."""
    run = id_pairs_function(vocabulary.merges, byte_ids(), _SPECIAL_IDS)
    return run(_pieces(first, vocabulary), _pieces(second, vocabulary))


def _pieces(text: Column, vocabulary: Vocabulary) -> Column:
    """What is encoded on its own. Without merges every byte is, so the text need not be cut into words."""
    return (pieces_for_encoding if vocabulary.merges else uncut_for_encoding)(text, vocabulary.lowercase)


def encode_with_offsets(text: Column, vocabulary: Vocabulary) -> Column:
    """``struct(ids array<int>, offsets array<struct(s, e)>)``: the span of each id in the raw text, in characters.

    Spans are not trimmed: a piece's leading space belongs to its first token.
    """
    run = spans_function(vocabulary.merges, byte_ids(), _SPECIAL_IDS)
    return run(*_spanned(text, vocabulary))


def encode_example(question: Column, context: Column, vocabulary: Vocabulary) -> Column:
    """``struct(question, ids, offsets)``: :func:`encode` of a question and :func:`encode_with_offsets` of its context, from
    one worker a task."""
    run = examples_function(vocabulary.merges, byte_ids(), _SPECIAL_IDS)
    return run(_pieces(question, vocabulary), *_spanned(context, vocabulary))


def _spanned(text: Column, vocabulary: Vocabulary) -> tuple[Column, ...]:
    """What ids and spans of a text are made from."""
    low = vocabulary.lowercase
    return pieces_for_encoding(text, low), prefixed(text, low), origins(text, low), F.length(text)


def decode(ids: Column, vocabulary: Vocabulary, skip_special_tokens: bool = True) -> Column:
    """Text of an array of ids; ids outside the vocabulary are left out. The space put in front of the text stays.

    Symbols are taken back to bytes once in each token of the vocabulary, not in each text.
    """
    tokens = vocabulary.bytes_literal()
    last = len(vocabulary) - 1
    lowest = N_SPECIAL if skip_special_tokens else 0
    known = F.filter(ids, lambda i: i.between(lowest, last))
    return from_bytes(F.array_join(F.transform(known, lambda i: F.get(tokens, i)), ""))


def to_seq(
    ids: Column, seq_len: int | None = None, with_eos: bool = False, with_sos: bool = False, with_len: bool = False
) -> Column:
    """Ids with optional end and start marks, padded or cut on the right to ``seq_len``.

    With ``with_len`` a ``struct(seq, length)``, the length being that before padding or cutting.
    """
    parts = ([F.array(F.lit(SOS))] if with_sos else []) + [ids] + ([F.array(F.lit(EOS))] if with_eos else [])
    marked = F.concat(*parts) if len(parts) > 1 else ids
    marks = len(parts) - 1
    length = F.size(ids) + marks
    seq = marked
    if seq_len is not None:
        seq = F.slice(pad(marked, length, seq_len), 1, seq_len)
    return F.struct(seq.alias("seq"), length.alias("length")) if with_len else seq


def pad(ids: Column, length: Column, seq_len: int, value: int = PAD) -> Column:
    """``ids`` of the given length followed by ``value`` up to ``seq_len``."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(seq_len) - length, F.lit(0))))


def join_words(words: Column) -> Column:
    """A list of words as the sentence that is encoded."""
    return F.array_join(words, " ")


def from_seq(seq: Column, vocabulary: Vocabulary, with_pad: bool = False) -> Column:
    """Tokens of an array of ids: an unknown id is shown as ``<id>``, pads are dropped unless asked for."""
    tokens = vocabulary.tokens_literal()
    kept = seq if with_pad else F.filter(seq, lambda i: i != PAD)
    return F.transform(
        kept,
        lambda i: F.coalesce(
            F.when(i >= 0, F.get(tokens, i)), F.concat(F.lit("<"), i.cast("string"), F.lit(">"))
        ),
    )


def from_seq_text(seq: Column, vocabulary: Vocabulary, with_pad: bool = False) -> Column:
    """Joined form of :func:`from_seq`: decoded text, with reserved tokens only when pads are kept."""
    return decode(seq, vocabulary, skip_special_tokens=not with_pad)
