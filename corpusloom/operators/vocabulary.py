"""The sub-word vocabulary: tables, lookups, checks and storage.

A vocabulary is bounded by the size it was trained for (tens of thousands of entries), whatever the corpus. It is therefore
held on the driver and goes into plans as one literal array, which needs no join.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MASK, N_SPECIAL, PAD, SPECIAL_TOKENS, byte_ids, byte_symbols, bytes_of_symbols

# Above this the driver-held form is refused.
MAX_VOCABULARY = 1_000_000

VOCAB_SCHEMA = "id int, token string, is_special boolean"
MERGES_SCHEMA = "rank int, left int, right int, merged int"


def seed_tokens() -> list[str]:
    """Reserved tokens, then the byte symbols in code-point order."""
    return list(SPECIAL_TOKENS) + sorted(byte_symbols())


def validate_specials(tokens: list[str]) -> None:
    leading = tuple(tokens[:N_SPECIAL])
    if leading != SPECIAL_TOKENS:
        raise ValueError(f"a vocabulary starts with {' '.join(SPECIAL_TOKENS)}, this one with {' '.join(leading) or 'nothing'}")


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, and merges ``(left, right, merged)`` in rank order."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[int, int, int], ...] = ()
    lowercase: bool = True

    def __post_init__(self):
        if len(self.tokens) > MAX_VOCABULARY:
            raise ValueError(f"{len(self.tokens)} tokens exceed the bound of {MAX_VOCABULARY}")
        validate_specials(list(self.tokens))

    def __len__(self) -> int:
        return len(self.tokens)

    @functools.cached_property
    def stoi(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @property
    def itos(self) -> tuple[str, ...]:
        return self.tokens

    @property
    def special_indices(self) -> set[int]:
        return set(range(N_SPECIAL))

    @property
    def mask_index(self) -> int:
        return MASK

    @property
    def pad_index(self) -> int:
        return PAD

    def tokens_literal(self) -> Column:
        """All tokens as one array literal; it is folded once, not per row."""
        return F.from_json(F.lit(json.dumps(self.tokens)), "array<string>")

    def bytes_literal(self) -> Column:
        """All tokens with one character up to U+00FF for each byte, as one array literal."""
        return F.from_json(F.lit(json.dumps([bytes_of_symbols(t) for t in self.tokens])), "array<string>")

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, i < N_SPECIAL) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def merges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, *m) for r, m in enumerate(self.merges)], MERGES_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Replace the tables below ``path``."""
        self.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        self.merges_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        options = spark.createDataFrame([(self.lowercase,)], "lowercase boolean")
        options.coalesce(1).write.mode("overwrite").parquet(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        vocab = spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab").collect()
        merges = spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges").collect()
        lowercase = spark.read.parquet(f"{path}/options").first()["lowercase"]
        tokens = [r["token"] for r in sorted(vocab, key=lambda r: r["id"])]
        ranked = [(r["left"], r["right"], r["merged"]) for r in sorted(merges, key=lambda r: r["rank"])]
        return cls(tuple(tokens), tuple(ranked), lowercase)

    def to_tokenizer_json(self) -> str:
        """The vocabulary as the JSON artefact of the public tokenizer library: byte-level pieces, accents folded."""
        added = [
            {"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
            for i, t in enumerate(SPECIAL_TOKENS)
        ]
        folding = [{"type": "NFD"}, {"type": "StripAccents"}, *([{"type": "Lowercase"}] if self.lowercase else [])]
        byte_level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
        model = {
            "type": "BPE",
            "unk_token": "<unk>",
            "fuse_unk": False,
            "byte_fallback": False,
            "vocab": {t: i for i, t in enumerate(self.tokens)},
            "merges": [[self.tokens[a], self.tokens[b]] for a, b, _ in self.merges],
        }
        made = {"version": "1.0", "added_tokens": added, "normalizer": {"type": "Sequence", "normalizers": folding}}
        return json.dumps({**made, "pre_tokenizer": byte_level, "decoder": byte_level, "model": model}, ensure_ascii=False)

    @classmethod
    def from_tokenizer_json(cls, text: str) -> Vocabulary:
        """A vocabulary from such an artefact; its ids must be dense and start with the reserved tokens."""
        told = json.loads(text)
        model = told["model"]
        if model.get("type") != "BPE":
            raise ValueError(f"a model of type {model.get('type')} holds no merges")
        ids = {**{x["content"]: x["id"] for x in told.get("added_tokens") or []}, **model["vocab"]}
        if sorted(ids.values()) != list(range(len(ids))):
            raise ValueError("the ids of the vocabulary are not dense")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranked = tuple((ids[a], ids[b], ids[a + b]) for a, b in merges)
        steps = (told.get("normalizer") or {}).get("normalizers") or [told.get("normalizer") or {}]
        lowercase = any(step.get("type") == "Lowercase" for step in steps)
        return cls(tuple(sorted(ids, key=ids.get)), ranked, lowercase)

    def save_tokenizer(self, spark: SparkSession, path: str) -> None:
        """Replace ``path`` by a folder with the artefact as its one text file."""
        artefact = spark.createDataFrame([(self.to_tokenizer_json(),)], "value string")
        artefact.coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load_tokenizer(cls, spark: SparkSession, path: str) -> Vocabulary:
        """Read such an artefact, a file or the folder that :meth:`save_tokenizer` made."""
        return cls.from_tokenizer_json(spark.read.text(path, wholetext=True).first()["value"])


def byte_vocabulary(lowercase: bool = True) -> Vocabulary:
    """The vocabulary before any merge: reserved tokens and byte symbols."""
    return Vocabulary(tuple(seed_tokens()), (), lowercase)


def byte_id_table(spark: SparkSession) -> DataFrame:
    """``byte, symbol, id`` of the 256 byte values."""
    rows = list(zip(range(256), byte_symbols(), byte_ids(), strict=True))
    return spark.createDataFrame(rows, "byte int, symbol string, id int")


def special_mismatches(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    """Reserved ids whose token is missing or wrong; a sound vocabulary gives no row."""
    expected = spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id int, expected string")
    held = vocab.filter(F.col("id") < N_SPECIAL)
    wrong = expected.join(held, "id", "left").filter(~F.col("expected").eqNullSafe(F.col("token")))
    return wrong.select("id", "expected", F.col("token").alias("found"))


def token_usage(encoded: DataFrame, ids: str, vocabulary: Vocabulary) -> DataFrame:
    """How often each id occurs, with its token: counts are summed per task before the shuffle and before the lookup."""
    used = encoded.select(F.explode_outer(ids).alias("id")).filter(F.col("id").isNotNull())
    counts = used.groupBy("id").agg(F.count("*").alias("n"))
    vocab = F.broadcast(vocabulary.vocab_table(encoded.sparkSession))
    return counts.join(vocab, "id").select("id", "token", "is_special", "n")
