"""Pre-training samples: sentence order, masking, truncation, assembly, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.draws import DIGITS, below, digest, high_integer, integer, low_below, position_draw, row_key
from ..functions.permutation import Permutation
from ..functions.text import EOS, MASK, N_SPECIAL, PAD, SOS
from ..session import written
from .encoding import encode_both
from .indexing import Indexed, dense_index, shuffled_rank
from .vocabulary import Vocabulary

# Shares of pairs kept, of tokens selected, and of selected tokens masked and (up to) replaced.
KEEP_PAIR = 0.5
MASK_PROB = 0.15
MASKED = 0.8
MASKED_OR_REPLACED = 0.9


def sample_second_sentences(
    pairs: Indexed, seed: int = 0, epoch: int = 0, group: str | None = "split", second: str = "s2", repeat: bool = True
) -> DataFrame:
    """Adds ``is_next``; half of the rows get the second sentence of another pair of their group instead of their own.

    The other pair is drawn uniformly, so the join key has no hot value. Rows that keep their sentence take no part in the
    join. A lone pair keeps its own sentence but is marked as not next. ``second`` may hold text or ids. Draws are
    independent, so a sentence may be drawn several times; without ``repeat`` it is drawn once at most, by a permutation
    in which every pair is followed by another one.
    """
    same = [group] if group else []
    scope = [F.col(group)] if group else []
    rows = pairs.rows
    draw = digest("nsp", seed, epoch, *scope, F.col("idx"))
    kept = rows.filter(below(draw, KEEP_PAIR)).withColumn("is_next", F.lit(1))
    n = pairs.size_of_group(F.col(group) if group else None)
    step = integer(draw, F.greatest(n - 1, F.lit(1)), at=DIGITS + 1) + F.lit(1)
    other = F.pmod(F.col("idx") + step, n) if repeat else _followers(pairs, seed, epoch, group)
    left = rows.filter(~below(draw, KEEP_PAIR)).drop(second).withColumn("other", other)
    seconds = rows.select(*same, F.col("idx").alias("other"), second)
    replaced = left.join(seconds, [*same, "other"]).drop("other").withColumn("is_next", F.lit(0))
    return kept.unionByName(replaced)


def _followers(pairs: Indexed, seed: int, epoch: int, group: str | None) -> Column:
    """Of each row the one behind it in a keyed permutation of its group."""
    other = F.lit(None).cast("bigint")
    for name, n in pairs.counts.items():
        if group is None:
            return Permutation(pairs.total, ("nsp", seed, epoch)).next(F.col("idx"))
        other = F.when(F.col(group) == name, Permutation(n, ("nsp", seed, epoch, name)).next(F.col("idx"))).otherwise(other)
    return other


def mask_codes(ids: Column, vocab_size: int, *key: Column | str | int, mask_prob: float = MASK_PROB) -> Column:
    """For each id 0 if it is not selected, else the id it is shown as: the mask, a random one or itself.

    A token's draws depend on the key and its position only. Reserved tokens are neither selected nor drawn as a replacement.
    """

    def shown(token: Column, h: Column) -> Column:
        replacement = (high_integer(h, vocab_size - N_SPECIAL) + N_SPECIAL).cast("int")
        return F.when(low_below(h, MASKED), F.lit(MASK)).when(low_below(h, MASKED_OR_REPLACED), replacement).otherwise(token)

    def code_of(row: Column) -> Callable[[Column, Column], Column]:
        def code(token: Column, i: Column) -> Column:
            drawn = position_draw(row, i)
            selected = low_below(drawn, mask_prob) & (token >= N_SPECIAL)
            return F.when(selected, let(F.xxhash64(drawn), lambda h: shown(token, h))).otherwise(F.lit(PAD))

        return code

    return let(row_key(*key), lambda row: F.transform(ids, code_of(row)))


def masked_input(ids: Column, codes: Column) -> Column:
    """Ids with the selected ones replaced by their code."""
    return F.zip_with(ids, codes, lambda token, code: F.when(code == PAD, token).otherwise(code))


def masked_label(ids: Column, codes: Column) -> Column:
    """Original ids of the selected tokens, 0 everywhere else."""
    return F.zip_with(ids, codes, lambda token, code: F.when(code == PAD, F.lit(PAD)).otherwise(token))


def pair_lengths(n1: Column, n2: Column, seq_len: int) -> tuple[Column, Column]:
    """Lengths left when the longer sentence (the first among equals) loses its last token until both fit."""
    budget = F.lit(seq_len - 3)
    second = F.least(n2, F.greatest(F.ceil(budget / 2).cast("int"), budget - n1))
    return F.least(n1, budget - second), second


def truncate_pair(samples: DataFrame, seq_len: int) -> DataFrame:
    """Cuts the ids ``i1`` and ``i2`` so that they fit with three marks."""
    n1, n2 = pair_lengths(F.size("i1"), F.size("i2"), seq_len)
    lengths = samples.withColumns({"n1": n1, "n2": n2})
    cut = {"i1": F.slice("i1", 1, F.col("n1")), "i2": F.slice("i2", 1, F.col("n2"))}
    return lengths.withColumns(cut).drop("n1", "n2")


def framed(first: Column, second: Column, start: int, end: int, room: Column) -> Column:
    """Both parts between a start and two end marks, padded."""
    mark = F.array(F.lit(end))
    return F.concat(F.array(F.lit(start)), first, mark, second, mark, F.array_repeat(F.lit(PAD), room))


def assemble(samples: DataFrame, seq_len: int) -> DataFrame:
    """``bert_input, bert_label, segment_label`` of length ``seq_len`` from truncated ``i1``, ``i2`` and their codes."""
    n1, n2 = F.size("i1"), F.size("i2")
    room = F.lit(seq_len - 3) - n1 - n2
    shown = [masked_input(F.col(f"i{k}"), F.col(f"codes{k}")) for k in (1, 2)]
    labels = [masked_label(F.col(f"i{k}"), F.col(f"codes{k}")) for k in (1, 2)]
    segment = F.concat(
        F.array_repeat(F.lit(1), n1 + 2), F.array_repeat(F.lit(2), n2 + 1), F.array_repeat(F.lit(PAD), room)
    )
    return samples.select(
        "split",
        "idx",
        "is_next",
        framed(*shown, SOS, EOS, room).alias("bert_input"),
        framed(*labels, PAD, PAD, room).alias("bert_label"),
        segment.alias("segment_label"),
    )


def encoded_pairs(pairs: Indexed, vocabulary: Vocabulary) -> Indexed:
    """Pairs with ids in place of their sentences, written once so that every epoch can draw from them."""
    return Indexed(written(pair_ids(pairs.rows, vocabulary, "split", "idx"), "encoded-pairs"), pairs.counts)


def pair_ids(pairs: DataFrame, vocabulary: Vocabulary, *keep: str | Column) -> DataFrame:
    """``keep`` and the ids ``i1`` and ``i2`` of both sentences."""
    both = pairs.select(*keep, encode_both(F.col("s1"), F.col("s2"), vocabulary).alias("_ids"))
    return both.withColumns({"i1": F.col("_ids.first"), "i2": F.col("_ids.second")}).drop("_ids")


def pretraining_samples(
    pairs: Indexed, vocabulary: Vocabulary, seq_len: int = 128, seed: int = 0, epoch: int = 0, mask_prob: float = MASK_PROB
) -> DataFrame:
    """One sample per pair and epoch: ``split, idx, is_next, bert_input, bert_label, segment_label``.

    Another epoch draws other negatives and other masks. The only shuffle is the join that fetches the negatives; sentences
    are encoded after it, once per sample. For many epochs encode first and use :func:`epoch_samples`, which gives the same.
    """
    drawn = sample_second_sentences(pairs, seed, epoch)
    ids = pair_ids(drawn, vocabulary, "split", "idx", "is_next")
    return samples_from_ids(ids, len(vocabulary), seq_len, seed, epoch, mask_prob)


def epoch_samples(
    encoded: Indexed, vocab_size: int, seq_len: int = 128, seed: int = 0, epoch: int = 0, mask_prob: float = MASK_PROB
) -> DataFrame:
    """The samples of one epoch from :func:`encoded_pairs`, without running the encoder again."""
    drawn = sample_second_sentences(encoded, seed, epoch, second="i2")
    return samples_from_ids(drawn, vocab_size, seq_len, seed, epoch, mask_prob)


def samples_from_ids(
    ids: DataFrame, vocab_size: int, seq_len: int, seed: int, epoch: int, mask_prob: float = MASK_PROB
) -> DataFrame:
    """Masks, cuts and assembles encoded sentences ``i1`` and ``i2``.

    Sentences are masked as a whole and cut afterwards. A token's draws do not depend on its neighbours, so cutting first
    gives the same samples and spares the draws of tokens that are lost.
    """
    key = ("mask", seed, epoch, F.col("split"), F.col("idx"))
    codes = {
        f"codes{k}": mask_codes(F.col(f"i{k}"), vocab_size, *key, k, mask_prob=mask_prob) for k in (1, 2)
    }
    return assemble(truncate_pair(ids, seq_len).withColumns(codes), seq_len)


def epoch_batches(
    rows: DataFrame, n: int, batch_size: int, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = True, key: str = "idx", dense: bool = True
) -> DataFrame:
    """Adds ``batch_id`` and the place ``in_batch``: shuffled by a keyed permutation of ``key``, or in the order of ``key``.

    ``key`` numbers the rows from 0: a row finds its place on its own, without a shuffle or a look at other rows. If the key has
    gaps (``dense=False``), as that of features after some were dropped, rows are ranked by a hash of it or by its order.
    """
    if shuffle and dense:
        # The outer form keeps the optimizer from computing the place a second time in a filter.
        place = Permutation(n, ("shuffle", seed, epoch)).of(F.col(key))
        ranked = rows.select("*", F.explode_outer(F.array(place)).alias("rank"))
    elif shuffle:
        ranked = shuffled_rank(rows, n, "shuffle", seed, epoch, F.col(key))
    elif not dense:
        ranked = _ranked(rows, key)
    else:
        ranked = rows.withColumn("rank", F.col(key))
    if drop_last:
        ranked = ranked.filter(F.col("rank") < n // batch_size * batch_size)
    size = F.lit(batch_size).cast("bigint")
    return ranked.withColumns({"batch_id": F.expr(f"rank div {int(batch_size)}"), "in_batch": F.pmod("rank", size).cast("int")}).drop("rank")


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the ``rank`` of their ``key``."""
    free = dense_index(rows.withColumnRenamed(key, "_key"), ("_key",)).rows
    return free.withColumnRenamed("idx", "rank").withColumnRenamed("_key", key)


def step_plan(
    spark: SparkSession, n: int, batch_size: int, accumulation: int = 1, epochs: int = 1, drop_last: bool = True, at_least: int = 0
) -> DataFrame:
    """One row: batches and optimizer steps per epoch, total steps, effective batch size, of ``n`` rows.

    A set smaller than a batch has no batch and no step, unless ``at_least`` asks for some, as fine-tuning does.
    """
    a = max(1, accumulation)
    batches = max(at_least, batch_count(n, batch_size, drop_last))
    steps = -(-batches // a)
    row = (batches, steps, max(at_least, steps * epochs), batch_size * a)
    return spark.createDataFrame([row], "batches_per_epoch bigint, steps_per_epoch bigint, total_steps bigint, effective_batch int")


def batch_count(n: int, batch_size: int, drop_last: bool = True) -> int:
    """Batches that :func:`epoch_batches` makes of ``n`` rows."""
    return n // batch_size if drop_last else -(-n // batch_size)


def step_boundaries(batches: DataFrame, n_batches: int, accumulation: int = 1) -> DataFrame:
    """Per batch, its size, whether the optimizer steps after it, and the number of that step."""
    a = F.lit(max(1, accumulation))
    number = F.col("batch_id") + 1
    boundary = (F.pmod(number, a) == 0) | (number == n_batches)
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("n"))
    return sizes.select("batch_id", "n", boundary.alias("is_boundary"), F.ceil(number / a).cast("bigint").alias("step"))


def masked_positions(samples: DataFrame, *keep: str) -> DataFrame:
    """One row per labelled position: ``position, label``."""
    rows = samples.select(*keep, F.posexplode_outer("bert_label").alias("position", "label"))
    return rows.filter(F.col("label") != PAD)


def padding_mask(ids: Column) -> Column:
    """Which positions hold a token."""
    return F.transform(ids, lambda i: i != PAD)
