"""SQL for DuckDB that computes what each query should return, written without looking at how Spark gets there: adjacency by a
window instead of arrays, sampling and masking by one draw per token, spans by joins, running values by one window.
"""

from __future__ import annotations

import math

from ..functions.draws import threshold
from ..functions.permutation import ROUNDS, SIDES
from ..functions.text import PUNCTUATION, PY_SPACE, SPECIAL_TOKENS
from ..operators.corpus import TEST_RATIO
from ..operators.sentence_model import ABBREVIATION, CLOSING, COLLOCATION, LEAST, OPENING, STARTER, STOP_SHARE
from . import derived as D
from .queries import ACCUMULATION, BATCH, CAP, SEED

ORACLES: dict[str, str] = {}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- documents to pairs

DOCS = "docs AS (SELECT 'wiki' AS source, doc_id, coalesce(text, '') AS text FROM documents)"
ALL_DOCS = f"""{DOCS},
all_docs AS (SELECT * FROM docs UNION ALL SELECT 'books', item_id, coalesce(text, '') FROM benchmark)"""
PARA_DOCS = f"""{ALL_DOCS},
para_docs AS (SELECT source, doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM all_docs)"""


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{PY_SPACE}]+', ' ', 'g'))"


def sentence_ctes(docs: str) -> str:
    return f"""
parts AS (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS para,
                 unnest(string_split(text, chr(10) || chr(10))) AS part FROM {docs}),
cut AS (SELECT source, doc_id, para, string_split(regexp_replace({collapsed('part')}, '([.!?]) ', '\\1' || chr(10), 'g'),
               chr(10)) AS sents FROM parts),
raw AS (SELECT source, doc_id, para, generate_subscripts(sents, 1) AS ord, unnest(sents) AS sent FROM cut),
found AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, para ORDER BY ord) - 1 AS pos FROM raw WHERE sent <> ''),
kept AS (SELECT source, doc_id, para, sent, row_number() OVER (PARTITION BY source, doc_id, para ORDER BY ord) - 1 AS pos
         FROM raw WHERE length(sent) >= 16 AND len(string_split(sent, ' ')) >= 4),
pairs AS (SELECT * FROM (SELECT source, doc_id, para::INTEGER AS para, pos::INTEGER AS pos, sent AS s1,
            lead(sent) OVER (PARTITION BY source, doc_id, para ORDER BY pos) AS s2 FROM kept) WHERE s2 IS NOT NULL)"""


def split_of(ratio: float) -> str:
    drawn = "substr(md5(concat_ws('|', 'split', 42, source, doc_id, para, pos)), 1, 8)"
    return f"CASE WHEN {drawn} < '{threshold(ratio)}' THEN 'test' ELSE 'train' END AS split"


ROUTED = f"{PARA_DOCS}, {sentence_ctes('para_docs')}, routed AS (SELECT *, {split_of(D.TEST_RATIO)} FROM pairs)"
INDEXED = f"""{ROUTED},
indexed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY source, doc_id, para, pos) - 1 AS idx FROM routed)"""

ORACLES["a1_document_scan"] = f"WITH {DOCS} SELECT * FROM docs"
ORACLES["a2_source_cap"] = f"WITH {DOCS} SELECT * FROM docs ORDER BY doc_id LIMIT {CAP}"
ORACLES["a2_large_source_cap"] = f"""WITH {ALL_DOCS}, placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM all_docs)
SELECT source, doc_id, text FROM placed WHERE r <= n // 2"""
ORACLES["a3_source_union"] = f"WITH {ALL_DOCS} SELECT * FROM all_docs"

LINES = f"""{ALL_DOCS},
lines AS (SELECT replace(unnest(string_split(text, chr(10))), ', ', chr(9)) AS line FROM all_docs)"""
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_PAIRS = f"""{LINES},
fields AS (SELECT string_split(trim(line, {_WS}), chr(9)) AS f FROM lines),
line_pairs AS (SELECT trim(f[1], {_WS}) AS s1, trim(f[2], {_WS}) AS s2 FROM fields WHERE len(f) >= 2)"""
ORACLES["a4_pair_corpus"] = f"WITH {LINE_PAIRS} SELECT s1, s2 FROM line_pairs WHERE s1 <> '' AND s2 <> ''"
ORACLES["a4_pair_corpus_index"] = f"""WITH {LINE_PAIRS}
SELECT 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS n FROM line_pairs WHERE s1 <> '' AND s2 <> ''"""
ORACLES["a5_training_text"] = f"""WITH {LINES},
halves AS (SELECT CASE WHEN instr(line, chr(9)) = 0 THEN line ELSE left(line, instr(line, chr(9)) - 1) END AS text FROM lines
  UNION ALL SELECT substr(line, instr(line, chr(9)) + 1) FROM lines WHERE instr(line, chr(9)) > 0)
SELECT text FROM halves WHERE text <> ''"""
ORACLES["a7_pair_sink"] = f"WITH {ROUTED} SELECT split, count(*) AS n_pairs FROM routed GROUP BY split"

ORACLES["b1_paragraphs"] = f"""WITH {PARA_DOCS}, {sentence_ctes('para_docs')}
SELECT source, doc_id, para::INTEGER AS para, trim(part, {_WS}) AS paragraph FROM parts WHERE trim(part, {_WS}) <> ''"""
ORACLES["b2_sentences"] = f"""WITH {PARA_DOCS}, {sentence_ctes('para_docs')}
SELECT source, doc_id, para::INTEGER AS para, pos::INTEGER AS pos, sent FROM found"""


def _word(c: str) -> str:
    """Type of a word: lower case, without what wraps it and without a full stop at its end."""
    core = f"ltrim({c}, {_lit(OPENING)})"
    return f"lower(CASE WHEN ends_with({core}, '.') THEN left({core}, length({core})::INTEGER - 1) ELSE rtrim({core}, {_lit(CLOSING)}) END)"


def _ratio(k: str, a: str, b: str, n: str) -> str:
    """Log-likelihood ratio of ``k`` meetings of what occurs ``a`` and ``b`` times among ``n``."""

    def of(k: str, n: str, p: str) -> str:
        return f"(CASE WHEN {k} > 0 THEN ({k}) * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - ({k})) * ln(1 - {p}) ELSE 0 END)"

    p, p1, p2 = f"(({b}) / ({n}))", f"(({k}) / ({a}))", f"(({b} - {k}) / ({n} - {a}))"
    return f"-2 * ({of(k, a, p)} + {of(f'({b} - {k})', f'({n} - {a})', p)} - {of(k, a, p1)} - {of(f'({b} - {k})', f'({n} - {a})', p2)})"


LEARNT = f"""{PARA_DOCS},
lines AS (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS para,
                 unnest(string_split(text, chr(10) || chr(10))) AS part FROM para_docs),
split_lines AS (SELECT source, doc_id, para, string_split({collapsed('part')}, ' ') AS w FROM lines),
tokens AS (SELECT source, doc_id, para, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM split_lines),
followed AS MATERIALIZED (SELECT *, lead(a) OVER (PARTITION BY source, doc_id, para ORDER BY i) AS b FROM tokens),
met AS MATERIALIZED (SELECT {_word('a')} AS word, ends_with(ltrim(a, {_lit(OPENING)}), '.') AS stop, regexp_matches(a, '[.!?]$') AS ends, {_word('b')} AS following
  FROM followed WHERE lower({_word('a')}) <> upper({_word('a')})),
word_counts AS MATERIALIZED (SELECT word, count(*) AS n, count(*) FILTER (stop) AS stops FROM met GROUP BY word),
sums AS (SELECT sum(n)::DOUBLE AS total, sum(stops)::DOUBLE AS total_stops FROM word_counts),
lettered AS (SELECT *, length(replace(word, '.', '')) AS l, n - stops AS free FROM word_counts, sums WHERE stops >= {LEAST}),
abbreviation_scores AS (SELECT word, n, stops, -2 * (stops * ln(total_stops / total) + free * ln(1 - total_stops / total)
    - stops * ln({STOP_SHARE}::DOUBLE) - free * ln(1 - {STOP_SHARE}::DOUBLE)) * exp(-l) * (length(word) - l + 1) * pow(l::DOUBLE, -free) AS score
  FROM lettered WHERE l > 0),
abbreviations AS MATERIALIZED (SELECT * FROM abbreviation_scores WHERE score >= {ABBREVIATION}),
starts AS (SELECT following AS word, count(*) AS starts FROM met
  WHERE ends AND following IS NOT NULL AND NOT (stop AND word IN (SELECT word FROM abbreviations)) GROUP BY following),
all_starts AS (SELECT sum(starts)::DOUBLE AS ends FROM starts),
starter_scores AS (SELECT word, n, starts, {_ratio('starts', 'ends', 'n', 'total')} AS score FROM starts JOIN word_counts USING (word), sums, all_starts
  WHERE starts * total > n * ends AND ends < total AND starts <= n),
starters AS MATERIALIZED (SELECT * FROM starter_scores WHERE score >= {STARTER}),
pairs_met AS (SELECT word, following, count(*) AS together FROM met
  WHERE stop AND following IS NOT NULL AND word IN (SELECT word FROM abbreviations) GROUP BY ALL HAVING count(*) > 1),
collocation_scores AS (SELECT p.word, p.following, together, {_ratio('together', 'c.stops', 'f.n', 'total')} AS score
  FROM pairs_met p JOIN word_counts c ON c.word = p.word JOIN word_counts f ON f.word = p.following, sums
  WHERE together * total > c.stops * f.n AND c.stops < total),
collocations AS MATERIALIZED (SELECT * FROM collocation_scores WHERE score >= {COLLOCATION})"""
ORACLES["b2_abbreviations"] = f"WITH {LEARNT} SELECT word, n, stops, round(score, 6) AS score FROM abbreviations"
ORACLES["b2_sentence_starters"] = f"WITH {LEARNT} SELECT word, n, starts, round(score, 6) AS score FROM starters"
ORACLES["b2_collocations"] = f"WITH {LEARNT} SELECT word, following, together, round(score, 6) AS score FROM collocations"
ORACLES["b2_learnt_sentences"] = f"""WITH {LEARNT},
judged AS (SELECT *, regexp_matches(a, '[.!?]$') AND b IS NOT NULL AND NOT (ends_with(a, '.')
    AND EXISTS (FROM abbreviations x WHERE x.word = {_word('a')})
    AND (NOT (EXISTS (FROM starters x WHERE x.word = {_word('b')}) AND lower(left(ltrim(b, {_lit(OPENING)}), 1)) <> left(ltrim(b, {_lit(OPENING)}), 1))
      OR EXISTS (FROM collocations x WHERE x.word = {_word('a')} AND x.following = {_word('b')}))) AS last FROM followed),
grouped AS (SELECT *, coalesce(sum(last::INTEGER) OVER (PARTITION BY source, doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM judged)
SELECT source, doc_id, para::INTEGER AS para, g::INTEGER AS pos, string_agg(a, ' ' ORDER BY i) AS sent FROM grouped
GROUP BY source, doc_id, para, g HAVING string_agg(a, ' ' ORDER BY i) <> ''"""
ORACLES["b3_collapsed_text"] = f"WITH {ALL_DOCS} SELECT source, doc_id, {collapsed('text')} AS text FROM all_docs"
ORACLES["b4_kept_sentences"] = f"""WITH {PARA_DOCS}, {sentence_ctes('para_docs')}
SELECT source, doc_id, para::INTEGER AS para, pos::INTEGER AS pos, sent FROM kept"""
ORACLES["b5_adjacent_pairs"] = f"WITH {ALL_DOCS}, {sentence_ctes('all_docs')} SELECT * FROM pairs"
ORACLES["b5_paragraph_pairs"] = f"WITH {PARA_DOCS}, {sentence_ctes('para_docs')} SELECT * FROM pairs"
ORACLES["b6_split_routing"] = f"""WITH {ALL_DOCS}, {sentence_ctes('all_docs')}
SELECT source, doc_id, para, pos, {split_of(TEST_RATIO)} FROM pairs"""
ORACLES["b7_pair_counts"] = f"""WITH {ROUTED}
SELECT source, split, count(*) AS n_pairs FROM routed GROUP BY ROLLUP (source, split)"""

# ---------------------------------------------------------------- pieces and ids

FOLDED = "lower(strip_accents({0}))"


def prefixed(c: str) -> str:
    folded = FOLDED.format(c)
    return f"CASE WHEN {c} = '' OR starts_with({folded}, ' ') THEN {folded} ELSE ' ' || {folded} END"


# RE2 has no look-ahead, so a mark is put before the last white space of a run that text follows.
_RE2_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+"


def pieces_of(c: str) -> str:
    marked = f"regexp_replace({prefixed(c)}, '(\\s)(\\s[^\\s])', '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_extract_all({marked}, {_lit(_RE2_PIECES)})"


BYTE_MAP = """
bytes AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS visible FROM range(256) t(b)),
numbered AS (SELECT b, visible, row_number() OVER (PARTITION BY visible ORDER BY b) - 1 AS r FROM bytes),
byte_ids AS (SELECT b, 5 + r + CASE WHEN visible THEN 0 ELSE 188 END AS id,
                    CASE WHEN visible THEN chr(b::INTEGER) ELSE chr((256 + r)::INTEGER) END AS token FROM numbered),
byte_map AS (SELECT list(id::INTEGER ORDER BY b) AS m FROM byte_ids)"""


def bytes_of(c: str) -> str:
    return f"regexp_extract_all(hex(encode({c})), '..')"


def ids_of(c: str) -> str:
    """Ids of a text, one per byte; the statement around it reads ``byte_map``."""
    return f"list_transform({bytes_of(prefixed(c))}, lambda x: m[('0x' || x)::INTEGER + 1])"


ORACLES["c1_normalized_text"] = f"WITH {ALL_DOCS} SELECT source, doc_id, {FOLDED.format('text')} AS text FROM all_docs"
ORACLES["c1_accents_only"] = f"WITH {ALL_DOCS} SELECT source, doc_id, strip_accents(text) AS text FROM all_docs"
PIECE_CTES = f"""
cut_docs AS (SELECT source, doc_id, {pieces_of('text')} AS p FROM all_docs),
pieces AS (SELECT source, doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, unnest(p) AS piece FROM cut_docs)"""
PIECES = f"{ALL_DOCS}, {PIECE_CTES}"
ORACLES["c2_pieces"] = f"WITH {PIECES} SELECT source, doc_id, pos, piece FROM pieces"
ORACLES["c3_piece_frequencies"] = f"WITH {PIECES} SELECT piece, count(*) AS freq FROM pieces GROUP BY piece"
ORACLES["c3_frequent_pieces"] = f"""WITH {PIECES}, counted AS (SELECT piece, count(*) AS freq FROM pieces GROUP BY piece)
SELECT piece, freq FROM counted WHERE freq * 1000 >= (SELECT sum(freq) FROM counted)"""
ORACLES["c4_byte_symbol_usage"] = f"""WITH {ALL_DOCS}, {BYTE_MAP},
used AS (SELECT unnest({bytes_of(prefixed('text'))}) AS x FROM all_docs),
counted AS (SELECT ('0x' || x)::INTEGER AS b, count(*) AS n FROM used GROUP BY x)
SELECT id::INTEGER AS id, token, false AS is_special, n FROM counted JOIN byte_ids USING (b)"""
WORDS = f"""{PIECES}, {BYTE_MAP},
words AS (SELECT piece, count(*) AS freq FROM pieces GROUP BY piece),
coded AS (SELECT piece, freq, list_transform({bytes_of('piece')},
                 lambda x: m[('0x' || x)::INTEGER + 1]) ::BIGINT[] AS ids FROM words, byte_map),
neighbours AS (SELECT unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, freq FROM coded WHERE len(ids) > 1),
pair_counts AS (SELECT l::INTEGER AS "left", r::INTEGER AS "right", sum(freq)::BIGINT AS n FROM neighbours GROUP BY l, r)"""
ORACLES["c5_pair_counts"] = f"WITH {WORDS} SELECT * FROM pair_counts"
ORACLES["c6_next_merges"] = f'WITH {WORDS} SELECT * FROM pair_counts ORDER BY n DESC, "left", "right" LIMIT 50'
ORACLES["c7_merged_words"] = f"""WITH {WORDS.replace("coded AS (", "coded AS MATERIALIZED (")},
best AS MATERIALIZED (SELECT '<' || "left" || '><' || "right" || '>' AS pair FROM pair_counts ORDER BY n DESC, "left", "right" LIMIT 1),
spelt AS (SELECT '<' || array_to_string(ids, '><') || '>' AS w, freq FROM coded),
merged AS (SELECT replace(w, pair, '<261>') AS w, freq FROM spelt CROSS JOIN best)
SELECT replace(w[2:-2], '><', ' ') AS ids, freq FROM merged"""
_RESERVED = ", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(SPECIAL_TOKENS))
ORACLES["c9_reserved_ids"] = f"""WITH reserved(id, token) AS (VALUES {_RESERVED}),
swapped AS (SELECT CASE token WHEN '<eos>' THEN 3 WHEN '<sos>' THEN 2 ELSE id END AS id, token AS found FROM reserved)
SELECT id::INTEGER AS id, token AS expected, found FROM reserved JOIN swapped USING (id) WHERE token <> found"""
ORACLES["c10_encode_bytes"] = f"""WITH {ALL_DOCS}, {BYTE_MAP}
SELECT source, doc_id, array_to_string({ids_of('text')}, ' ') AS ids FROM all_docs, byte_map"""


def shift_of(c: str) -> str:
    """1 where a space is put in front of the text."""
    return f"CASE WHEN starts_with({FOLDED.format(c)}, ' ') THEN 0 ELSE 1 END"


def spans_of(p: str, shift: str) -> str:
    """Span of each byte of the prefixed text ``p``: a prefixed space shares the first character's."""
    one = f"greatest(i - 1 - {shift}, 0)"
    span = f"{one} || ':' || ({one} + 1)"
    return f"flatten(list_transform(string_split({p}, ''), lambda ch, i: list_transform({bytes_of('ch')}, lambda x: {span})))"


ORACLES["c11_offsets_bytes"] = f"""WITH {ALL_DOCS}, {BYTE_MAP},
prep AS (SELECT source, doc_id, {ids_of('text')} AS ids, {prefixed('text')} AS p, {shift_of('text')} AS shift
  FROM all_docs, byte_map)
SELECT source, doc_id, array_to_string(ids, ' ') AS ids, array_to_string({spans_of('p', 'shift')}, ' ') AS offsets FROM prep"""
ORACLES["c12_decode"] = f"WITH {ALL_DOCS} SELECT source, doc_id, {prefixed('text')} AS text FROM all_docs"


def padded(ids: str, n: int) -> str:
    return f"list_resize(({ids})[:{n}], {n}, 0)"


TURNS = f"""{BYTE_MAP.strip()},
turns AS (SELECT conv_id, turn, {ids_of('text')} AS ids FROM conversations, byte_map)"""
ORACLES["c13_to_seq"] = f"""WITH {TURNS}
SELECT conv_id, turn, array_to_string({padded('[3] || ids || [2]', 256)}, ' ') AS seq, (len(ids) + 2)::INTEGER AS length
FROM turns"""
ORACLES["c14_from_seq"] = f"""WITH {TURNS},
seqs AS (SELECT conv_id, turn, list_filter({padded('[3] || ids', 256)}, lambda i: i <> 0) || [1000 + turn] AS seq FROM turns),
tokens AS (SELECT id, token FROM byte_ids UNION ALL VALUES {_RESERVED}),
spread AS (SELECT conv_id, turn, generate_subscripts(seq, 1) AS place, unnest(seq) AS id FROM seqs)
SELECT conv_id, turn, string_agg(coalesce(token, '<' || spread.id || '>'), ' ' ORDER BY place) AS tokens
FROM spread LEFT JOIN tokens ON tokens.id = spread.id GROUP BY conv_id, turn"""

# Whole training by recursion: every step counts all pairs of all words and replaces the most frequent one. Pieces of other
# texts are carried along uncounted, so that the last step also holds their encoding.
_STEPS = D.VOCAB_SIZE - 261
_NO_PIECES = "SELECT NULL::VARCHAR AS piece WHERE false"


def trained_ctes(extra: str = _NO_PIECES) -> str:
    """Training on ``pieces``, with the pieces of the statement ``extra`` carried along."""
    return f"""{PIECE_CTES}, {BYTE_MAP},
all_pieces AS (SELECT source, piece FROM pieces UNION ALL SELECT NULL, piece FROM ({extra})),
words AS (SELECT piece, count(source) AS freq FROM all_pieces GROUP BY piece),
coded AS (SELECT piece, freq, list_transform({bytes_of('piece')},
                 lambda x: m[('0x' || x)::INTEGER + 1])::BIGINT[] AS ids FROM words, byte_map),
train AS (SELECT 0 AS step, 0::BIGINT AS l, 0::BIGINT AS r, piece, ids, freq FROM coded
  UNION ALL
  SELECT step + 1, best.l, best.r, piece, string_split(replace(array_to_string(list_transform(ids, lambda i: '<' || i || '>'),
      ''), '<' || best.l || '><' || best.r || '>', '<' || (261 + step) || '>')[2:-2], '><')::BIGINT[], freq
  FROM train, (SELECT l, r FROM (SELECT unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, freq FROM train WHERE len(ids) > 1)
    GROUP BY l, r ORDER BY sum(freq) DESC, l, r LIMIT 1) best
  WHERE step < {_STEPS}),
steps AS MATERIALIZED (SELECT DISTINCT step, l, r FROM train WHERE step > 0),
spelt AS (SELECT 0 AS step, (SELECT list(token ORDER BY id) FROM (VALUES {_RESERVED} UNION ALL SELECT id, token FROM byte_ids)
    t(id, token)) AS tokens
  UNION ALL
  SELECT s.step, tokens || [tokens[s.l + 1] || tokens[s.r + 1]] FROM spelt JOIN steps s ON s.step = spelt.step + 1),
vocab AS (SELECT unnest(range(len(tokens))) AS id, unnest(tokens) AS token FROM spelt WHERE step = {_STEPS}),
learnt AS (SELECT piece, ids FROM train WHERE step = {_STEPS}),
encoded AS (SELECT source, doc_id, pos, ids FROM pieces JOIN learnt USING (piece))"""


TRAINED = f"RECURSIVE {ALL_DOCS}, {trained_ctes()}"
ORACLES["c8_trained_merges"] = f"""WITH {TRAINED}
SELECT (step - 1)::INTEGER AS rank, l::INTEGER AS "left", r::INTEGER AS "right", (260 + step)::INTEGER AS merged FROM steps"""
ORACLES["c8_trained_vocabulary"] = f"WITH {TRAINED} SELECT id::INTEGER AS id, token, id < 5 AS is_special FROM vocab"
ORACLES["a8_vocabulary_store"] = ORACLES["c8_trained_vocabulary"]
ORACLES["c15_vocabulary_size"] = f"WITH {TRAINED} SELECT count(*) AS size, count(*) FILTER (id < 5) AS n_special FROM vocab"
ORACLES["c11_offsets"] = f"""WITH {TRAINED},
flat AS (SELECT source, doc_id, pos, generate_subscripts(ids, 1) AS k, unnest(ids) AS id FROM encoded),
sized AS (SELECT flat.*, length(token) AS n FROM flat JOIN vocab USING (id)),
placed AS (SELECT *, sum(n) OVER (PARTITION BY source, doc_id ORDER BY pos, k) AS past FROM sized),
prep AS (SELECT source, doc_id, {prefixed('text')} AS p, {shift_of('text')} AS shift FROM all_docs),
byte_spans AS (SELECT source, doc_id, {spans_of('p', 'shift')} AS spans FROM prep),
joined AS (SELECT source, doc_id, string_agg(id::VARCHAR, ' ' ORDER BY pos, k) AS ids,
    string_agg(split_part(spans[(past - n + 1)::BIGINT], ':', 1) || ':' || split_part(spans[past::BIGINT], ':', 2), ' ' ORDER BY pos, k) AS offsets
  FROM placed JOIN byte_spans USING (source, doc_id) GROUP BY source, doc_id)
SELECT source, doc_id, coalesce(ids, '') AS ids, coalesce(offsets, '') AS offsets FROM all_docs LEFT JOIN joined USING (source, doc_id)"""
ORACLES["c10_encode"] = f"""WITH {TRAINED},
joined AS (SELECT source, doc_id, string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos) AS ids FROM encoded GROUP BY ALL)
SELECT source, doc_id, coalesce(ids, '') AS ids FROM all_docs LEFT JOIN joined USING (source, doc_id)"""
ORACLES["c15_token_usage"] = f"""WITH {TRAINED}, used AS (SELECT unnest(ids) AS id FROM encoded)
SELECT id::INTEGER AS id, token, id < 5 AS is_special, count(*) AS n FROM used JOIN vocab USING (id) GROUP BY ALL"""


# ---------------------------------------------------------------- samples

IDS = f"""{INDEXED}, {BYTE_MAP},
pair_ids AS (SELECT split, idx, {ids_of('s1')} AS i1, {ids_of('s2')} AS i2 FROM indexed, byte_map)"""
NSP = f"""{INDEXED},
sizes AS (SELECT split, count(*) AS n FROM indexed GROUP BY split),
drawn AS (SELECT indexed.*, n, md5(concat_ws('|', 'nsp', {SEED}, 0, split, idx)) AS h FROM indexed JOIN sizes USING (split)),
chosen AS (SELECT *, CASE WHEN substr(h, 1, 8) < '{threshold(0.5)}' THEN idx
    ELSE (idx + 1 + ('0x' || substr(h, 9, 15))::BIGINT % greatest(n - 1, 1)) % n END AS other,
    (substr(h, 1, 8) < '{threshold(0.5)}')::INTEGER AS is_next FROM drawn),
sampled AS (SELECT c.split, c.idx, c.is_next, c.s1, o.s2 FROM chosen c JOIN indexed o ON o.split = c.split AND o.idx = c.other)"""


# The multipliers of the public 64-bit hash that draws for tokens.
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
_LOW64 = "18446744073709551615::UHUGEINT"


def hash_ctes(source: str, number: str, out: str, keep: str = "*") -> str:
    """The 64-bit hash ``x`` of a whole number, one line per step."""

    def mul(a: str, by: int) -> str:
        return f"(({a}) * {by}::UHUGEINT) & {_LOW64}"

    def rotated(a: str, by: int) -> str:
        return f"(({a} << {by}) & {_LOW64}) + ({a} >> {64 - by})"

    def folded(by: int) -> str:
        return f"xor(x, x >> {by})"

    steps = [
        rotated("x", 31),
        f"xor({mul('x', _P1)}, {42 + _P5 + 8}::UHUGEINT)",
        rotated("x", 27),
        f"(({mul('x', _P1)}) + {_P4}::UHUGEINT) & {_LOW64}",
        mul(folded(33), _P2),
        mul(folded(29), _P3),
        folded(32),
    ]
    names = [f"{out}{i}" for i in range(len(steps))] + [out]
    first = f"{names[0]} AS (SELECT {keep}, {mul(f'({number})::UHUGEINT', _P2)} AS x FROM {source})"
    rest = [f"{b} AS (SELECT * REPLACE ({e} AS x) FROM {a})" for a, b, e in zip(names, names[1:], steps)]
    return ",\n".join([first, *rest])


def masked_ctes(source: str, sides: int, replacements: int = 256) -> str:
    """``masked(split, idx, side, i, input, label)`` of ``source(split, idx, i1, i2)``, a row per token."""
    row = f"('0x' || substr(md5(concat_ws('|', 'mask', {SEED}, 0, split, idx, side)), 1, 15))::BIGINT"
    lists = " UNION ALL ".join(f"SELECT split, idx, {k} AS side, i{k} AS ids FROM {source}" for k in range(1, sides + 1))
    low, high = "x & 4294967295::UHUGEINT", "x >> 32"
    return f"""sides AS ({lists}),
tokens AS (SELECT split, idx, side, {row} AS row_key, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS id FROM sides),
{hash_ctes('tokens', 'row_key + i', 'h')},
picked AS (SELECT split, idx, side, i, id, x, id >= 5 AND ({low}) < {math.floor(0.15 * 2**32)}::UHUGEINT AS picked FROM h),
{hash_ctes('(SELECT split, idx, side, i, x AS y FROM picked WHERE picked)',
           'y', 'g', 'split, idx, side, i')},
masked AS (SELECT p.split, p.idx, p.side, p.i, CASE WHEN NOT picked THEN id WHEN (g.{low}) < {math.floor(0.8 * 2**32)}::UHUGEINT THEN 4
    WHEN (g.{low}) < {math.floor(0.9 * 2**32)}::UHUGEINT THEN (5 + (g.{high}) % {replacements}::UHUGEINT)::INTEGER ELSE id END AS input,
    CASE WHEN picked THEN id ELSE 0 END AS label
  FROM picked p LEFT JOIN g ON g.split = p.split AND g.idx = p.idx AND g.side = p.side AND g.i = p.i)"""


ORACLES["d1_dense_index"] = f"WITH {INDEXED} SELECT split, idx, source, doc_id, para, pos FROM indexed"

def permuted_ctes(source: str, n: str, start: str, key: str, name: str, back: bool = False) -> str:
    """CTE ``<name>_told``: for each number ``start`` of ``source`` its place ``x`` in the keyed permutation of the numbers below
    ``n``, which is the same in all rows; with ``back`` the number at that place. Rounds are written out, for three passes."""
    side = f"(SELECT unnest(range(s, s + {SIDES})) AS a, n FROM (SELECT ceil(sqrt({n}))::BIGINT AS s, {n} AS n FROM {source} LIMIT 1))"
    ctes = [
        f"{name}_grid AS (SELECT a, (n + a - 1) // a AS b, n FROM {side} ORDER BY a * ((n + a - 1) // a), a LIMIT 1)",
        f"{name}_0 AS (SELECT {start} AS start, {start} AS x, g.a, g.b, g.n FROM {source} CROSS JOIN {name}_grid g)",
    ]
    sign = "-" if back else "+"
    for walk in range(3):
        ctes.append(f"{name}_{walk}_0 AS (SELECT start, x, x // b AS r, x % b AS c, a, b, n FROM {name}_{walk})")
        for i in range(ROUNDS):
            k = ROUNDS - 1 - i if back else i
            told, changed, size = ("r", "c", "b") if k % 2 else ("c", "r", "a")
            drawn = f"('0x' || substr(md5(concat_ws('|', {key}, {k}, {told})), 1, 15))::BIGINT"
            new = f"(({changed} {sign} {drawn} % {size}) + {size}) % {size}"
            cells = f"{new} AS r, c" if changed == "r" else f"r, {new} AS c"
            ctes.append(f"{name}_{walk}_{i + 1} AS (SELECT start, x, {cells}, a, b, n FROM {name}_{walk}_{i})")
        landed = "r * b + c" if walk == 0 else "CASE WHEN x < n THEN x ELSE r * b + c END"
        ctes.append(f"{name}_{walk + 1} AS (SELECT start, {landed} AS x, a, b, n FROM {name}_{walk}_{ROUNDS})")
    return ",\n".join([*ctes, f"{name}_told AS (SELECT start, x FROM {name}_3)"])


def _followed(split: str) -> str:
    """CTE ``<split>_followed``: of each pair the one behind it in the permutation of its split."""
    own = f"{split}_rows AS (SELECT idx, count(*) OVER () AS n FROM indexed WHERE split = '{split}')"
    key = f"'nsp', {SEED}, 0, '{split}'"
    there = permuted_ctes(f"{split}_rows", "n", "idx", key, f"{split}_to")
    behind = f"{split}_behind AS (SELECT start, (x + 1) % (SELECT count(*) FROM {split}_rows) AS place, (SELECT count(*) FROM {split}_rows) AS n FROM {split}_to_told)"
    back = permuted_ctes(f"{split}_behind", "n", "place", key, f"{split}_from", back=True)
    return f"""{own}, {there}, {behind}, {back},
{split}_followed AS (SELECT '{split}' AS split, b.start AS idx, f.x AS other FROM {split}_behind b JOIN {split}_from_told f ON f.start = b.place)"""


ORACLES["d2_distinct_negatives"] = f"""WITH {INDEXED}, {_followed('train')}, {_followed('test')},
followed AS (SELECT * FROM train_followed UNION ALL SELECT * FROM test_followed),
drawn AS (SELECT *, substr(md5(concat_ws('|', 'nsp', {SEED}, 0, split, idx)), 1, 8) < '{threshold(0.5)}' AS kept FROM indexed)
SELECT d.split, d.idx, d.kept::INTEGER AS is_next, d.s1, CASE WHEN d.kept THEN d.s2 ELSE o.s2 END AS s2
FROM drawn d JOIN followed f ON f.split = d.split AND f.idx = d.idx JOIN indexed o ON o.split = d.split AND o.idx = f.other"""
ORACLES["d2_next_sentence"] = f"WITH {NSP} SELECT split, idx, is_next, s1, s2 FROM sampled"
MASKED_BOTH = f"{IDS}, {masked_ctes('pair_ids', 2)}"
ORACLES["d3_masked_tokens"] = f"""WITH {MASKED_BOTH}
SELECT split, idx, side, string_agg(input::VARCHAR, ' ' ORDER BY i) AS input, string_agg(label::VARCHAR, ' ' ORDER BY i) AS label
FROM masked GROUP BY split, idx, side"""
ORACLES["d4_replacements"] = f"""WITH {MASKED_BOTH}
SELECT input AS id, count(*) AS n FROM masked WHERE label <> 0 AND input <> label AND input <> 4 GROUP BY 1"""
_BUDGET = D.SEQ_LEN - 3


def lengths(l1: str, l2: str) -> str:
    """Lengths after popping: the longer gives until both are equal, then they take turns and the first one starts."""
    half, rest = _BUDGET // 2, _BUDGET - _BUDGET // 2
    return f"""CASE WHEN {l1} + {l2} <= {_BUDGET} THEN {l1} WHEN {l2} <= {rest} AND {l2} <= {_BUDGET} - {half}
      THEN {_BUDGET} - {l2} WHEN {l1} <= {half} THEN {l1} ELSE {half} END AS n1,
    CASE WHEN {l1} + {l2} <= {_BUDGET} THEN {l2} WHEN {l2} <= {rest} AND {l2} <= {_BUDGET} - {half}
      THEN {l2} WHEN {l1} <= {half} THEN {_BUDGET} - {l1} ELSE {rest} END AS n2"""


ORACLES["d5_truncated_lengths"] = f"""WITH {IDS}, short AS (SELECT split, idx, {lengths('len(i1)', 'len(i2)')} FROM pair_ids)
SELECT split, idx, n1::INTEGER AS n1, n2::INTEGER AS n2 FROM short"""


def assembled(a: str, b: str, start: int, end: int) -> str:
    return f"array_to_string({padded(f'[{start}] || {a}[:n1] || [{end}] || {b}[:n2] || [{end}]', D.SEQ_LEN)}, ' ')"


_SEGMENT = f"""array_to_string({padded('list_resize(CAST([] AS INTEGER[]), n1 + 2, 1) || '
    'list_resize(CAST([] AS INTEGER[]), n2 + 1, 2)', D.SEQ_LEN)}, ' ')"""
ORACLES["d6_assembled"] = f"""WITH {IDS}, short AS (SELECT *, {lengths('len(i1)', 'len(i2)')} FROM pair_ids)
SELECT split, idx, 1 AS is_next, {assembled('i1', 'i2', 3, 2)} AS bert_input, {_SEGMENT} AS segment_label FROM short"""


def sample_ctes(replacements: int) -> str:
    """``samples`` from ``pair_ids``."""
    return f"""{masked_ctes('pair_ids', 2, replacements)},
parted AS (SELECT split, idx, any_value(is_next) AS is_next, coalesce(list(input ORDER BY i) FILTER (side = 1), []) AS x1,
    coalesce(list(label ORDER BY i) FILTER (side = 1), []) AS y1, coalesce(list(input ORDER BY i) FILTER (side = 2), []) AS x2,
    coalesce(list(label ORDER BY i) FILTER (side = 2), []) AS y2 FROM masked JOIN pair_ids USING (split, idx) GROUP BY split, idx),
short AS (SELECT *, {lengths('len(x1)', 'len(x2)')} FROM parted),
samples AS (SELECT split, idx, is_next, {assembled('x1', 'x2', 3, 2)} AS bert_input, {assembled('y1', 'y2', 0, 0)} AS bert_label,
    {_SEGMENT} AS segment_label FROM short)"""


SAMPLES = f"""{NSP}, {BYTE_MAP},
pair_ids AS (SELECT split, idx, is_next, {ids_of('s1')} AS i1, {ids_of('s2')} AS i2 FROM sampled, byte_map),
{sample_ctes(256)}"""
ORACLES["d7_samples"] = f"WITH {SAMPLES} SELECT * FROM samples"
ORACLES["d7_epoch_samples"] = ORACLES["d7_samples"]

_SIDES = " UNION ALL ".join(f"SELECT split, idx, {k} AS side, {pieces_of(f's{k}')} AS p FROM sampled" for k in (1, 2))
SUBWORD_SAMPLES = f"""RECURSIVE {NSP},
side_lists AS ({_SIDES}),
side_pieces AS (SELECT split, idx, side, generate_subscripts(p, 1) AS pos, unnest(p) AS piece FROM side_lists),
{trained_ctes('SELECT piece FROM side_pieces')},
side_ids AS (SELECT split, idx, side, flatten(list(ids ORDER BY pos)) AS ids FROM side_pieces JOIN learnt USING (piece)
  GROUP BY split, idx, side),
pair_ids AS (SELECT s.split, s.idx, s.is_next, a.ids AS i1, b.ids AS i2 FROM sampled s
  JOIN side_ids a ON a.split = s.split AND a.idx = s.idx AND a.side = 1
  JOIN side_ids b ON b.split = s.split AND b.idx = s.idx AND b.side = 2),
{sample_ctes(D.VOCAB_SIZE - 5)}"""
ORACLES["d7_subword_samples"] = f"WITH {SUBWORD_SAMPLES} SELECT * FROM samples"

TRAIN_BATCHES = f"""{INDEXED},
train AS (SELECT idx, count(*) OVER () AS n FROM indexed WHERE split = 'train'),
{permuted_ctes('train', 'n', 'idx', f"'shuffle', {SEED}, 0", 'p')},
ranked AS (SELECT train.idx, n, x AS r FROM train JOIN p_told ON p_told.start = train.idx),
batches AS (SELECT idx, r // {BATCH} AS batch_id, (r % {BATCH})::INTEGER AS in_batch FROM ranked WHERE r < n // {BATCH} * {BATCH})"""
ORACLES["d8_shuffled_batches"] = f"WITH {TRAIN_BATCHES} SELECT * FROM batches"
ORACLES["d8_ordered_batches"] = f"""WITH {INDEXED}
SELECT idx, idx // {BATCH} AS batch_id, (idx % {BATCH})::INTEGER AS in_batch FROM indexed WHERE split = 'test'"""
ORACLES["d9_step_plan"] = f"""WITH {TRAIN_BATCHES}, n AS (SELECT greatest(count(DISTINCT batch_id), 1) AS b FROM batches)
SELECT b AS batches_per_epoch, ((b + {ACCUMULATION - 1}) // {ACCUMULATION}) AS steps_per_epoch,
  3 * ((b + {ACCUMULATION - 1}) // {ACCUMULATION}) AS total_steps, {BATCH * ACCUMULATION} AS effective_batch FROM n"""
ORACLES["d9_step_boundaries"] = f"""WITH {TRAIN_BATCHES}, b AS (SELECT batch_id, count(*) AS n FROM batches GROUP BY batch_id)
SELECT batch_id, n, (batch_id + 1) % {ACCUMULATION} = 0 OR batch_id = (SELECT max(batch_id) FROM b) AS is_boundary,
  batch_id // {ACCUMULATION} + 1 AS step FROM b"""
LABELS = f"""{SAMPLES}, labels_at AS (SELECT split, idx, string_split(bert_label, ' ') AS y FROM samples),
positions AS (SELECT split, idx, (generate_subscripts(y, 1) - 1)::INTEGER AS position, unnest(y)::INTEGER AS label FROM labels_at)"""
ORACLES["d10_masked_positions"] = f"WITH {LABELS} SELECT * FROM positions WHERE label <> 0"
ORACLES["d11_padding_mask"] = f"""WITH {SAMPLES}
SELECT split, idx, array_to_string(list_transform(string_split(bert_input, ' '), lambda x: (x <> '0')::INTEGER), '') AS mask
FROM samples"""

# ---------------------------------------------------------------- question-answering features

QA = """turns AS (SELECT q.conv_id, q.turn, q.conv_id || '-' || q.turn AS qid, q.text AS question, a.text AS context,
    string_split(a.text, ' ') AS w, substr(md5(concat_ws('|', 'answer', q.conv_id, q.turn)), 1, 1) AS draw
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'),
answered AS (SELECT *, CASE WHEN draw = '0' OR len(w) < 5 THEN NULL WHEN draw = '1' THEN array_to_string(w[-3:], ' ')
    ELSE array_to_string(w[3:5], ' ') END AS answer FROM turns),
examples AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS ex_idx, conv_id, turn, qid, question, context, answer,
    CASE WHEN answer IS NULL THEN NULL WHEN draw = '1' THEN length(context) - length(answer)
    ELSE length(w[1]) + length(w[2]) + 2 END::INTEGER AS answer_start, CASE WHEN draw < '8' THEN split_part(answer, ' ', 1) END AS also
  FROM answered)"""
ORACLES["a6_qa_examples"] = f"""WITH {QA}
SELECT ex_idx, qid, question, context, concat_ws('|', answer, also) AS answers, answer_start FROM examples"""
ORACLES["a6_split_object"] = ORACLES["a6_qa_examples"]
ORACLES["e1_first_examples"] = f"WITH {QA} SELECT ex_idx, qid FROM examples ORDER BY ex_idx LIMIT {CAP}"
# Features of examples whose ids and spans are in ``enc``.
_FIT = """queried AS (SELECT *, q0[:64] AS q_ids, 381 - least(len(q0), 64) AS budget FROM enc),
fitted AS (SELECT *, c0[:budget] AS c_ids, o0[:budget] AS offs FROM queried),
spread AS (SELECT ex_idx, generate_subscripts(offs, 1) - 1 AS place, unnest(offs) AS o FROM fitted),
spans AS (SELECT ex_idx, place, split_part(o, ':', 1)::INTEGER AS s, split_part(o, ':', 2)::INTEGER AS e FROM spread),
located AS (SELECT ex_idx, min(place) FILTER (s <= answer_start AND answer_start < e) AS tok_start,
    min(place) FILTER (s < answer_start + length(answer) AND answer_start + length(answer) <= e) AS tok_end
  FROM examples LEFT JOIN spans USING (ex_idx) GROUP BY ex_idx),
judged AS (SELECT fitted.*, tok_start, tok_end, CASE WHEN budget <= 0 THEN 'overflow' WHEN answer IS NULL THEN 'no_answer'
    WHEN tok_start IS NULL OR tok_end IS NULL OR tok_end < tok_start THEN 'overflow' ELSE 'kept' END AS outcome
  FROM fitted JOIN located USING (ex_idx))"""
FITTED = f"""{QA}, {BYTE_MAP},
prep AS (SELECT *, {prefixed('context')} AS p, {shift_of('context')} AS shift FROM examples, byte_map),
enc AS (SELECT *, {ids_of('question')} AS q0, {ids_of('context')} AS c0, {spans_of('p', 'shift')} AS o0 FROM prep),
{_FIT}"""
_INPUT = f"array_to_string({padded('[3] || q_ids || [2] || c_ids || [2]', 384)}, ' ') AS input_ids"
_QA_SEGMENT = f"""array_to_string({padded('list_resize(CAST([] AS INTEGER[]), len(q_ids) + 2, 1) || '
    'list_resize(CAST([] AS INTEGER[]), len(c_ids) + 1, 2)', 384)}, ' ') AS segment_ids"""
ORACLES["e2_query_budget"] = f"""WITH {FITTED}
SELECT ex_idx, array_to_string(q_ids, ' ') AS q_ids, budget::INTEGER AS budget FROM fitted"""
ORACLES["e3_context_cut"] = f"""WITH {FITTED}
SELECT ex_idx, array_to_string(c_ids, ' ') AS c_ids, array_to_string(offs, ' ') AS offsets FROM fitted"""
ORACLES["e4_assembled"] = f"""WITH {FITTED}
SELECT ex_idx, {_INPUT}, {_QA_SEGMENT}, (len(q_ids) + 2)::INTEGER AS context_start FROM fitted"""
ORACLES["e5_answer_span"] = f"""WITH {FITTED}
SELECT ex_idx, tok_start::INTEGER AS tok_start, tok_end::INTEGER AS tok_end FROM located"""
ORACLES["e6_drop_counts"] = f"WITH {FITTED} SELECT outcome, count(*) AS n FROM judged GROUP BY outcome"
ORACLES["e7_train_features"] = f"""WITH {FITTED}
SELECT ex_idx AS example_index, {_INPUT}, (len(q_ids) + 2 + tok_start)::INTEGER AS start_position,
  (len(q_ids) + 2 + tok_end)::INTEGER AS end_position FROM judged WHERE outcome = 'kept'"""

# The same with merged tokens: the pieces of questions and contexts are carried along in training, uncounted.
_ASKED = " UNION ALL ".join(f"SELECT ex_idx, '{c}' AS kind, {pieces_of(c)} AS p FROM examples" for c in ("question", "context"))
SUBWORD_FITTED = f"""RECURSIVE {ALL_DOCS}, {QA},
asked AS ({_ASKED}),
asked_pieces AS MATERIALIZED (SELECT ex_idx, kind, generate_subscripts(p, 1) AS pos, unnest(p) AS piece FROM asked),
{trained_ctes('SELECT piece FROM asked_pieces')},
asked_flat AS (SELECT ex_idx, kind, pos, generate_subscripts(ids, 1) AS k, unnest(ids) AS id FROM asked_pieces JOIN learnt USING (piece)),
asked_sized AS (SELECT f.*, length(token) AS n FROM asked_flat f JOIN vocab USING (id)),
asked_placed AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY ex_idx, kind ORDER BY pos, k) AS past FROM asked_sized),
asked_texts AS MATERIALIZED (SELECT ex_idx, kind, list(id::INTEGER ORDER BY pos, k) AS ids, list((past - n + 1)::BIGINT ORDER BY pos, k) AS firsts,
    list(past::BIGINT ORDER BY pos, k) AS lasts FROM asked_placed GROUP BY ex_idx, kind),
context_prep AS (SELECT ex_idx, {prefixed('context')} AS p, {shift_of('context')} AS shift FROM examples),
context_spans AS MATERIALIZED (SELECT ex_idx, {spans_of('p', 'shift')} AS spans FROM context_prep),
enc AS (SELECT e.*, coalesce(q.ids, []) AS q0, coalesce(c.ids, []) AS c0, list_transform(list_zip(coalesce(c.firsts, []), coalesce(c.lasts, [])),
    lambda z: split_part(s.spans[z[1]], ':', 1) || ':' || split_part(s.spans[z[2]], ':', 2)) AS o0
  FROM examples e JOIN context_spans s USING (ex_idx) LEFT JOIN asked_texts q ON q.ex_idx = e.ex_idx AND q.kind = 'question'
  LEFT JOIN asked_texts c ON c.ex_idx = e.ex_idx AND c.kind = 'context'),
{_FIT}"""
ORACLES["e7_subword_features"] = f"""WITH {SUBWORD_FITTED}
SELECT ex_idx AS example_index, {_INPUT}, (len(q_ids) + 2 + tok_start)::INTEGER AS start_position,
  (len(q_ids) + 2 + tok_end)::INTEGER AS end_position FROM judged WHERE outcome = 'kept'"""
ORACLES["d8_qa_batches"] = f"""WITH {FITTED}, r AS (SELECT ex_idx, row_number() OVER (ORDER BY ex_idx) - 1 AS r FROM fitted WHERE budget > 0)
SELECT ex_idx AS example_index, r // {BATCH} AS batch_id, (r % {BATCH})::INTEGER AS in_batch FROM r"""
ORACLES["d8_qa_training_batches"] = f"""WITH {FITTED}, k AS (SELECT ex_idx, count(*) OVER () AS n FROM judged WHERE outcome = 'kept'),
r AS (SELECT ex_idx, n, row_number() OVER (ORDER BY md5(concat_ws('|', 'shuffle', {SEED}, 0, ex_idx))) - 1 AS r FROM k)
SELECT ex_idx AS example_index, r // {BATCH} AS batch_id, (r % {BATCH})::INTEGER AS in_batch FROM r WHERE r < n // {BATCH} * {BATCH}"""
ORACLES["e7_eval_features"] = f"""WITH {FITTED}
SELECT ex_idx AS feature_index, (len(q_ids) + 2)::INTEGER AS context_start, {_INPUT}, {_QA_SEGMENT}, array_to_string(offs, ' ') AS offsets
FROM fitted WHERE budget > 0"""

# ---------------------------------------------------------------- question-answering evaluation


def _drawn(kind: str, at: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{kind}', ex_idx, {at})), 1, 2))::INTEGER - 128)"


SCORES = f"""{FITTED},
scores AS (SELECT ex_idx, qid, context, place, s, e, {_drawn('start', 'len(q_ids) + 2 + place')} AS ss,
    {_drawn('end', 'len(q_ids) + 2 + place')} AS es FROM fitted JOIN spans USING (ex_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ex_idx ORDER BY ss DESC, place) - 1 AS sr,
    row_number() OVER (PARTITION BY ex_idx ORDER BY es DESC, place) - 1 AS er FROM scores)"""
ORACLES["f1_context_scores"] = f"""WITH {SCORES}
SELECT ex_idx AS feature_index, string_agg(ss::VARCHAR, ' ' ORDER BY place) AS start_scores,
  string_agg(es::VARCHAR, ' ' ORDER BY place) AS end_scores FROM scores GROUP BY ex_idx"""
ORACLES["f2_top_candidates"] = f"""WITH {SCORES}
SELECT ex_idx AS feature_index, sr::INTEGER AS rank, place::INTEGER AS position, ss / 16.0::DOUBLE AS score FROM ranked WHERE sr < 20"""


def best(longest: int) -> str:
    return f"""{SCORES},
legal AS (SELECT a.ex_idx, a.place AS s, b.place AS e, a.s AS from_char, b.e AS to_char, a.ss + b.es AS score,
    row_number() OVER (PARTITION BY a.ex_idx ORDER BY a.ss + b.es DESC, a.sr, b.er) AS rn
  FROM ranked a JOIN ranked b ON a.ex_idx = b.ex_idx AND a.sr < 20 AND b.er < 20 AND b.place >= a.place AND b.place - a.place + 1 <= {longest}),
best AS (SELECT fitted.ex_idx, qid, context, l.s, l.e, from_char, to_char, score
  FROM fitted LEFT JOIN legal l ON l.ex_idx = fitted.ex_idx AND rn = 1)"""


_TEXT = f"coalesce(trim(substr(context, from_char + 1, to_char - from_char), {_WS}), '') AS text"
ORACLES["f3_best_span"] = f"""WITH {best(30)}
SELECT ex_idx AS feature_index, s::INTEGER AS s, e::INTEGER AS e, score / 16.0::DOUBLE AS score FROM best"""
ORACLES["f4_without_legal_span"] = f"WITH {best(1)} SELECT ex_idx AS feature_index, qid, {_TEXT} FROM best"
ORACLES["f5_span_text"] = f"WITH {best(30)} SELECT ex_idx AS feature_index, qid, {_TEXT} FROM best"
ORACLES["f6_predictions"] = f"WITH {best(30)} SELECT qid, {_TEXT} FROM best"


def answer_words(c: str) -> str:
    """Words left of an answer: no punctuation, no articles."""
    bare = f"translate(lower({c}), {_lit(PUNCTUATION)}, '')"
    return f"list_filter(string_split({collapsed(bare)}, ' '), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


ORACLES["f7_normalized_answers"] = f"""
SELECT conv_id, turn, array_to_string({answer_words('text')}, ' ') AS text FROM conversations"""
PREDICTED = f"""{QA},
golds AS (SELECT qid, 1 AS k, coalesce(answer, '') AS gold FROM examples UNION ALL SELECT qid, 2, also FROM examples WHERE also IS NOT NULL),
pred_draw AS (SELECT qid || '#' || k AS gk, coalesce(answer, 'the') AS g, gold,
    substr(md5(concat_ws('|', 'prediction', qid)), 1, 1) AS p FROM examples JOIN golds USING (qid)),
predicted AS (SELECT split_part(gk, '#', 1) AS qid, gk, gold, CASE WHEN p < '6' THEN g WHEN p < '9' THEN 'The ' || translate(g, 'abcdefghijklmnopqrstuvwxyz',
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!'
    WHEN p < 'c' THEN regexp_replace(g, '^[^ ]* ', '') WHEN p < 'e' THEN '' END AS text FROM pred_draw WHERE p < 'e')"""


def overlap(table: str, key: str, pred: str, gold: str) -> str:
    """F1 per key by counting words on both sides and joining the counts."""
    return f"""
tok AS (SELECT {key}, {answer_words(pred)} AS pt, {answer_words(gold)} AS gt FROM {table}),
pc AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(pt) AS w FROM tok) GROUP BY ALL),
gc AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(gt) AS w FROM tok) GROUP BY ALL),
common AS (SELECT pc.{key}, sum(least(pc.n, gc.n)) AS same FROM pc JOIN gc ON pc.{key} = gc.{key} AND pc.w = gc.w GROUP BY 1),
scored AS (SELECT tok.{key}, (array_to_string(pt, ' ') = array_to_string(gt, ' '))::INTEGER::DOUBLE AS em,
    CASE WHEN len(pt) = 0 OR len(gt) = 0 THEN (len(pt) = len(gt))::INTEGER::DOUBLE WHEN same IS NULL THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * same / (len(pt) + len(gt)) END AS f1 FROM tok LEFT JOIN common ON common.{key} = tok.{key})"""


# Of several golds the one that fits best counts.
SCORED = f"""{PREDICTED}, {overlap('predicted', 'gk', 'text', 'gold')},
questions AS (SELECT split_part(gk, '#', 1) AS qid, max(em) AS em, max(f1) AS f1 FROM scored GROUP BY 1)"""
METRICS = f"""{SCORED}
SELECT round(coalesce(avg(em) * 100, 0), 6) AS exact_match, round(coalesce(avg(f1) * 100, 0), 6) AS f1, count(*) AS "count"
FROM questions"""
_GOLD = "split_part(gk, '#', 1) AS qid, split_part(gk, '#', 2)::INTEGER - 1 AS gold_number"
ORACLES["f8_exact_match"] = f"WITH {SCORED} SELECT {_GOLD}, em FROM scored"
ORACLES["f9_token_f1"] = f"WITH {SCORED} SELECT {_GOLD}, round(f1, 6) AS f1 FROM scored"
ORACLES["f9_turn_overlap"] = f"""WITH {QA}, {overlap('turns', 'qid', 'question', 'context')}
SELECT qid, round(f1, 6) AS f1 FROM scored"""
ORACLES["f10_qa_metrics"] = f"WITH {METRICS}"
ORACLES["a10_evaluation_sink"] = f"WITH {METRICS}"
ORACLES["a10_evaluation_lines"] = f"""WITH {PREDICTED} SELECT to_json({{'qid': qid, 'text': text}})::VARCHAR AS value FROM predicted WHERE ends_with(gk, '#1')"""
ORACLES["a10_evaluation_event"] = f"""SELECT 'evaluation' AS run, 'epoch' AS event, -1 AS epoch, 'dev' AS split, * FROM (WITH {METRICS}) m"""
ORACLES["a10_predictions"] = f"WITH {PREDICTED} SELECT qid, text FROM predicted WHERE ends_with(gk, '#1')"

# ---------------------------------------------------------------- training events

STEPS = """steps AS (SELECT event_type AS run, (dayofyear(ts) - 1)::INTEGER AS epoch, event_id AS step,
    value::DECIMAL(12, 2) AS batch_loss, user_id, ts FROM events),
epochs AS (SELECT run, epoch, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split,
    sum(batch_loss)::DOUBLE / count(*) AS avg_loss, max(ts) AS ts FROM steps GROUP BY ALL)"""
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS _ts"
ORACLES["a9_metric_log"] = f"""WITH {STEPS}
SELECT run, 'step' AS event, epoch, step, NULL::VARCHAR AS split, batch_loss::DOUBLE AS batch_loss, NULL::DOUBLE AS avg_loss,
  {_STAMP} FROM steps
UNION ALL SELECT run, 'epoch', epoch, NULL, split, NULL, round(avg_loss, 6), {_STAMP} FROM epochs"""
ORACLES["a9_repeated_batches"] = ORACLES["a9_metric_log"]
ORACLES["g1_nsp_accuracy"] = """WITH l AS (SELECT quality, ('0x' || substr(md5(concat_ws('|', 'nsp-logits', doc_id)), 1, 2))::INTEGER AS x,
    ('0x' || substr(md5(concat_ws('|', 'nsp-logits', doc_id)), 3, 2))::INTEGER AS y FROM labels)
SELECT round(coalesce(avg(((y > x)::INTEGER = quality)::INTEGER) * 100, 0), 6) AS nsp_acc, count(*) AS n FROM l"""
ORACLES["g2_mlm_accuracy"] = f"""WITH {LABELS}
SELECT round(count(*) FILTER (substr(md5(concat_ws('|', 'mlm', split, idx, position)), 1, 1) < '9')
  / greatest(1, count(*)) * 100, 6) AS mlm_acc, count(*) AS n FROM positions WHERE label <> 0"""


def loss_of(logits: str, label: str) -> str:
    total = f"list_sum(list_transform({logits}, lambda v: exp(v::DOUBLE)))"
    return f"ln({total}) - {logits}[{label} + 1]::DOUBLE"


ORACLES["g3_pretraining_losses"] = f"""WITH r AS (SELECT vec_id // 16 AS batch_id, embedding AS x, label FROM embeddings),
nsp AS (SELECT batch_id, avg({loss_of('x[:2]', 'label % 2')}) AS nsp_loss FROM r GROUP BY 1),
mlm AS (SELECT batch_id, avg({loss_of('x', 'label')}) AS mlm_loss FROM r WHERE label <> 0 GROUP BY 1)
SELECT batch_id, round(nsp_loss, 6) AS nsp_loss, round(coalesce(mlm_loss, 0), 6) AS mlm_loss,
  round(nsp_loss + coalesce(mlm_loss, 0), 6) AS loss FROM nsp LEFT JOIN mlm USING (batch_id)"""
ORACLES["g3_qa_losses"] = f"""WITH r AS (SELECT vec_id // 16 AS batch_id, embedding AS x, label FROM embeddings)
SELECT batch_id, round((avg({loss_of('x', 'label')}) + avg({loss_of('x', '(label + 3)')})) / 2, 6) AS loss FROM r GROUP BY 1"""
_OVER = "OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING)"
ORACLES["g4_running_loss"] = f"""WITH {STEPS}
SELECT run, epoch, step, count(*) {_OVER} - 1 AS i, (sum(batch_loss) {_OVER})::DOUBLE / count(*) {_OVER} AS running_loss FROM steps"""
ORACLES["g4_running_accuracy"] = f"""WITH {STEPS}
SELECT run, epoch, step, (sum(user_id % 5) {_OVER})::DOUBLE / (count(*) {_OVER} * 4) * 100 AS running_acc FROM steps"""
ORACLES["g5_epoch_summary"] = f"""WITH {STEPS}, b AS (SELECT run, epoch, step // 16 AS batch, avg(batch_loss::DOUBLE) AS loss,
    avg((batch_loss * 2)::DOUBLE) AS mlm, avg((batch_loss * 3)::DOUBLE) AS nsp, count(*) FILTER (user_id % 3 = 0) AS mc,
    count(*) FILTER (user_id % 3 < 2) AS mt, count(*) FILTER (user_id % 2 = 0) AS nc, count(*) AS nt FROM steps GROUP BY 1, 2, 3)
SELECT run, epoch, round(avg(loss), 6) AS avg_loss, round(avg(mlm), 6) AS avg_mlm_loss, round(avg(nsp), 6) AS avg_nsp_loss,
  round(sum(mc)::DOUBLE / greatest(1, sum(mt)) * 100, 6) AS mlm_acc, round(sum(nc)::DOUBLE / greatest(1, sum(nt)) * 100, 6) AS nsp_acc
FROM b GROUP BY run, epoch"""
ORACLES["g6_logged_steps"] = f"""WITH {STEPS}, n AS (SELECT run, epoch, step, count(*) {_OVER} - 1 AS i,
    count(*) OVER (PARTITION BY run, epoch) - 1 AS last FROM steps)
SELECT run, epoch, step, i FROM n WHERE i % 50 = 0 OR i = last"""
TEST_EPOCHS = f"{STEPS}, t AS (SELECT run, epoch, avg_loss FROM epochs WHERE split = 'test')"
ORACLES["g7_improvements"] = f"""WITH {TEST_EPOCHS}
SELECT run, epoch, NOT EXISTS (SELECT 1 FROM t p WHERE p.run = t.run AND p.epoch < t.epoch AND p.avg_loss <= t.avg_loss) AS is_best
FROM t"""
ORACLES["g7_streamed_improvements"] = ORACLES["g7_improvements"]
ORACLES["g7_highest_improvements"] = f"""WITH {TEST_EPOCHS}
SELECT run, epoch, avg_loss > -1 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.run = t.run AND p.epoch < t.epoch
  AND p.avg_loss >= t.avg_loss) AS is_best FROM t"""
ORACLES["g7_best_epoch"] = f"""WITH {TEST_EPOCHS}, m AS (SELECT run, min(avg_loss) AS low FROM t GROUP BY run)
SELECT t.run, min(epoch) AS epoch FROM t JOIN m ON m.run = t.run AND t.avg_loss = m.low GROUP BY t.run"""
ORACLES["g8_final_metrics"] = f"""WITH {TEST_EPOCHS}
SELECT run, epoch, round(avg_loss, 6) AS avg_loss FROM t WHERE epoch = (SELECT max(epoch) FROM t x WHERE x.run = t.run)"""
ORACLES["g8_epoch_curve"] = f"WITH {STEPS} SELECT run, split, epoch, round(avg_loss, 6) AS avg_loss FROM epochs"

# ---------------------------------------------------------------- streams

ORACLES["h1_streamed_pairs"] = f"""WITH {ALL_DOCS}, {sentence_ctes('all_docs')}
SELECT source, doc_id, para, pos, s1, s2, {split_of(TEST_RATIO)} FROM pairs"""
ORACLES["h2_dashboard"] = f"""WITH {STEPS}
SELECT run, split, max(epoch) AS last_epoch, round(arg_max(avg_loss, epoch), 6) AS last_loss, round(min(avg_loss), 6) AS best_loss,
  count(*) AS n_epochs FROM epochs GROUP BY run, split"""
ORACLES["h2_step_rate"] = f"""WITH {STEPS}, w AS (SELECT run, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n_steps,
    round(avg(batch_loss::DOUBLE), 6) AS mean_loss FROM steps GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT date_trunc('second', max(ts)) - INTERVAL 1 DAY FROM steps)"""
