"""Texts to token pieces, and hierarchical best-fit packing of pieces into sequences of fixed length."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from ..session import written
from .common import map_batches, runs

SEQUENCE = 4096
#: A bin with no more room than this is emitted as nearly full.
SLACK = 8
#: Partitions whose underfull bins meet in one task of the next round.
FAN_IN = 8
#: Pieces that a task packs at a time where they carry their tokens, and where they are thin. So many of the emptiest underfull
#: bins at most wait for the next window or round, which bounds what a task holds.
WINDOW, THIN_WINDOW = 2_000, 50_000
#: Words whose ids a worker remembers.
_REMEMBERED = 1_400_000

_PIECES = "piece int, start long, length long, ids binary"
_PLACED = ("sequence_id", "offset", "closed", "part")
_PLACES = ", sequence_id long, offset long, closed boolean, part long"


class _Encoder:
    """Ids of texts by a tokenizer file. Words repeat, so each distinct one is encoded once and remembered.

    Texts are cut at spaces and line ends only, where a tokenizer of this kind (white space dropped, words by pattern, word
    ends marked) cuts anyway; a file of another kind is used on whole texts. Most words are letters with some signs behind:
    these are two tokens' runs of their own for the tokenizer, and letters count in lower case, as it lowers them first.
    """

    def __init__(self, path: str | None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            told = json.load(file)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        drops_space = any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in steps)
        suffix = (told.get("model") or {}).get("end_of_word_suffix")
        self.by_word = drops_space and suffix == "</w>"
        self.lowers = any(x.get("type") == "Lowercase" for x in (told.get("normalizer") or {}).get("normalizers", []))
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn_runs(self, runs: list[str]) -> None:
        """Runs of letters only or of signs only: encoded side by side, told apart by the word ends."""
        for at in range(0, len(runs), 4096):
            part = runs[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            past = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            data = ids.tobytes()
            if len(past) == len(part) and past[-1] == len(ids):
                self.runs.update(zip(part, (data[4 * a : 4 * z] for a, z in zip([0, *past], past))))
            else:
                self.runs.update(zip(part, self._ids(part)))

    def _learn(self, words: set[str]) -> None:
        simple, other, needed = [], [], set()
        for word in words:
            found = _SIMPLE.fullmatch(word)
            if not found:
                other.append(word)
                continue
            letters, signs = found.groups()
            if self.lowers and (letters.isascii() or max(letters) < "\u0300"):
                letters = letters.lower()
            simple.append((word, letters, signs))
            needed.add(letters)
            if signs:
                needed.add(signs)
        if len(self.runs) > _REMEMBERED:
            self.runs.clear()
        self._learn_runs(list(needed.difference(self.runs)))
        runs = self.runs
        for word, letters, signs in simple:
            self.known[word] = runs[letters] + runs[signs] if signs else runs[letters]
        self.known.update(zip(other, self._ids(other)))

    def forget(self) -> None:
        """Frees the remembered words: workers outlive their tasks."""
        self.known.clear()
        self.runs.clear()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        if new:
            self.known[""] = b""
            new.discard("")
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in cut]


#: Letters, then signs that stand in no shorthand of the tokenizer and start none of its special tokens.
_SIMPLE = re.compile(r"([^\W\d_]+)([.,;:!?*%$#&]*)")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_encoders: dict[str | None, _Encoder] = {}


def _tokenize(path: str | None, end_id: int, longest: int, carried: int, schema: pa.Schema, remember: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        encode = _encoders[path]
        try:
            yield from cut(encode, batches)
        finally:
            if not remember:
                encode.forget()

    def cut(encode: _Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for i, own in enumerate(encode(pc.fill_null(batch.column(carried), "").to_pylist())):
                    own += end
                    for n, first in enumerate(range(0, len(own) // 4, longest)):
                        part = own[4 * first : 4 * (first + longest)]
                        rows.append(i)
                        pieces.append(n)
                        starts.append(first)
                        lengths.append(len(part) // 4)
                        ids.append(part)
                taken = [batch.column(c).take(pa.array(rows)) for c in range(carried)]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    schema=schema,
                )

    return tokenize


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, longest: int = SEQUENCE, carry: list[str] | None = None, remember: bool = True
) -> DataFrame:
    """Token ids of every text, with ``end_id`` behind, cut into pieces of at most ``longest``.

    Columns: ``carry`` (all but text by default), ``piece`` from 0, ``start`` (ids of the text before it), ``length``, ``ids``
    (little-endian unsigned 32-bit). Null and empty texts have one piece that holds the end only. ``tokenizer`` is the path
    of a tokenizer file on every executor; by default the public word-level one that is installed. A column that is called
    like an added one gives way to it. With ``remember`` a worker keeps the ids of words from task to task (up to 0.4 GB).
    """
    carry, schema, arrow = _piece_schema(docs, carry, "")
    return map_batches(docs.select(*carry, "text"), _tokenize(tokenizer, end_id, longest, len(carry), arrow, remember), schema)


def _piece_schema(docs: DataFrame, carry: list[str] | None, more: str) -> tuple[list[str], str, pa.Schema]:
    """Carried columns, and the columns of pieces (with ``more`` behind) for Spark and Arrow."""
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    carry = [c for c in carry if c not in ("piece", "start", "length", "ids", *_PLACED)]
    told = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    schema = ", ".join([*told, _PIECES]) + more
    return carry, schema, to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)


def pack_texts(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = SEQUENCE, carry: list[str] | None = None, deal: bool = False
) -> DataFrame:
    """:func:`token_pieces` and :func:`pack` of texts in one pass: each task packs the pieces it makes, 2,000 at a time.

    Long and short texts should lie mixed, as after a join by id; where they may lie apart, ``deal`` deals the rows anew
    first, which shuffles the texts once.
    """
    carry, schema, arrow = _piece_schema(docs, carry, _PLACES)
    tokenize = _tokenize(tokenizer, end_id, capacity, len(carry), pa.schema(list(arrow)[: -len(_PLACED)]), remember=False)
    local = _pack(capacity, 0, False, WINDOW)
    texts = docs.select(*carry, "text")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokenize(batches):
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            closed = pa.array(np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, zero, zero, closed, zero], schema=arrow)

    texts = _dealt(texts) if deal else texts
    return _rounds(map_batches(texts, lambda batches: local(placed(batches)), schema), capacity, WINDOW)


class _Bins:
    """Best fit by remaining room: one stack of bins for each amount of room, and a bit for each stack that holds any."""

    def __init__(self, capacity: int):
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0

    def put(self, room: int, number: int) -> None:
        self.stacks[room].append(number)
        self.filled |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that still holds ``size``."""
        fitting = self.filled >> size
        if not fitting:
            return None
        room = size + (fitting & -fitting).bit_length() - 1
        number = self.stacks[room].pop()
        if not self.stacks[room]:
            self.filled ^= 1 << room
        return room, number


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of the items by decreasing size: each item's bin and offset, and how full each bin is."""
    bin_of, offset, full = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    bins = _Bins(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = bins.take(size)
        room, number = found if found else (capacity, len(full))
        if not found:
            full.append(0)
        bin_of[i], offset[i] = number, capacity - room
        full[number] += size
        if room > size:
            bins.put(room - size, number)
    return bin_of, offset, np.array(full, np.int64)


class _Packer:
    """Packs rows window by window; the emptiest underfull bins are the first items of the next window."""

    def __init__(self, capacity: int, prefix: int, waiting: int):
        self.capacity, self.prefix, self.waiting, self.made = capacity, prefix, waiting, 0
        self.open: pa.Table | None = None

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        """``rows`` with ``sequence_id`` (equal ones stay together), ``offset`` and ``length``; yields rows of closed bins."""
        if self.open is not None:
            rows = pa.concat_tables([self.open, rows])
        bins, first, item = np.unique(rows["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        length = rows["length"].to_numpy()
        sizes = np.zeros(len(bins), np.int64)
        np.add.at(sizes, item, length)
        number, place, full = best_fit(sizes, self.capacity)
        ids = self.prefix + self.made + number
        self.made += len(full)
        rows = rows.set_column(rows.column_names.index("sequence_id"), "sequence_id", pa.array(ids[item]))
        rows = rows.set_column(rows.column_names.index("offset"), "offset", pa.array(rows["offset"].to_numpy() + place[item]))
        done = (self.capacity - full) <= SLACK
        order = np.argsort(full, kind="stable")  # the emptiest stay open
        done[order[~done[order]][self.waiting :]] = True
        closed = done[number[item]]
        self.open = rows.filter(pa.array(~closed))
        yield rows.filter(pa.array(closed))


def _pack(capacity: int, level: int, last: bool, window: int) -> Callable:
    """Task function over rows that end in (length, sequence_id, offset, closed, part)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, names, schema = _Packer(capacity, (level << 54) + (task << 30), window), 0, None
        groups = runs(batches, ["part"]) if level else _gathered(batches, window)
        group = None
        for table in groups:
            schema = table.schema
            table = pa.Table.from_arrays(table.columns, names=table.column_names)  # all columns nullable, as new ones are
            part = table["part"][0].as_py() if level else task
            if group is not None and part != group:
                yield from _out([packer.open], schema, last, group)
                packer.open = None
            group = part
            step = table.num_rows if level else window  # rows of a bin stay together
            for at in range(0, table.num_rows, step):
                rows = table.slice(at, step)
                if not level:  # each piece is an item of its own
                    rows = rows.set_column(rows.column_names.index("sequence_id"), "sequence_id", pa.array(-1 - names - np.arange(rows.num_rows)))
                    names += rows.num_rows
                yield from _out(packer.add(rows), schema, True, part)
        if packer.open is not None:
            yield from _out([packer.open], schema, last, group)

    return pack


def _gathered(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.Table]:
    """Batches joined to tables of a window at least, but for the last."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= window:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _out(tables, schema: pa.Schema, closed: bool, part: int) -> Iterator[pa.RecordBatch]:
    for table in tables:
        if table is None or not table.num_rows:
            continue
        n = table.num_rows
        table = table.set_column(table.column_names.index("closed"), "closed", pa.array(np.full(n, closed)))
        table = table.set_column(table.column_names.index("part"), "part", pa.array(np.full(n, part // FAN_IN, np.int64)))
        yield from table.cast(schema).to_batches(max_chunksize=10_000)


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Places every row of ``pieces`` (column ``length``, 1 to ``capacity``) in a sequence of at most ``capacity``.

    Added: ``sequence_id`` (any number) and ``offset`` (gapless from 0). Rows are dealt evenly first, so that every partition
    has its share of long and short ones, in whatever order they come. Each partition then packs windows of 50,000 of its own
    rows (2,000 if they carry an array or binary column) by best fit of decreasing size and emits nearly full bins. Its
    underfull bins are items of the next window, and of the next round, where eight partitions meet in a task, and so on up
    to one task. As many bins as a window has rows wait at most, the emptiest ones: after best fit all bins of a task but one
    are more than half full and can't be joined with each other, so between rounds no more are needed than there are
    partitions. Only waiting bins move, and their rows are bounded in every task. Rounds are written tables, so a lost
    executor costs its tasks of one round. Other columns are carried; an empty table stays empty.
    """
    kept = [c for c in pieces.columns if c not in _PLACED]
    wide = any(isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in pieces.select(*kept).schema)
    window = WINDOW if wide else THIN_WINDOW
    zero = F.lit(0).cast("bigint")
    rows = _dealt(pieces.select(*kept, zero.alias("sequence_id"), zero.alias("offset"), F.lit(False).alias("closed"), zero.alias("part")))
    return _rounds(map_batches(rows, _pack(capacity, 0, False, window), rows.schema), capacity, window)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt one by one to the session's number of shuffle partitions; equal ones are dealt too, so none is overfull."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rounds(local: DataFrame, capacity: int, window: int) -> DataFrame:
    """The rounds after the partitions' own."""
    spark, schema = local.sparkSession, local.schema
    packed = written(local, "packed")
    level, done = 0, []
    while True:
        done.append(packed.where("closed"))
        left = packed.where("not closed")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        dealt = left.repartition(min(parts + 1, spark.sparkContext.defaultParallelism * 4), "part").sortWithinPartitions("part", "sequence_id")
        packed = written(map_batches(dealt, _pack(capacity, level, parts == 0, window), schema), "packed")
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out.drop("closed", "part")


def sequence_rows(placed: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``length`` and its parts in order (a struct of ``offset`` and ``columns``)."""
    part = F.struct("offset", *columns)
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))
    return grouped
