"""Packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from string import ascii_letters, digits

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folioflow.llm.common import bound_batches, discard, materialize, ranges, table, together, words

CAPACITY, END = 4096, 1
#: Bins that a task keeps open at a time, and pieces that it gets.
OPEN_BINS, PIECES_A_TASK = 4096, 100_000
#: Distinct words that a Python worker remembers.
REMEMBERED_WORDS = 1 << 19
TOGETHER_BYTES = 4 << 20
#: Signs that a word ends with and that no tokenizer of words joins to a letter before them. Signs of special tokens and the apostrophe are not among them.
TAIL = ".,;:!?%*&$#)]}\""
#: Letters, ASCII digits and Latin letters that take no mark when they are lower-cased, behind which such signs are cut off.
ENDS = {*ascii_letters, *digits, *(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1)}


class Lists:
    """Lists of ids by number, one after another in one array."""

    def __init__(self) -> None:
        self.n, self.first, self.ids = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def add(self, count: np.ndarray, ids: np.ndarray) -> None:
        while self.n + len(count) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        used = int(self.first[self.n])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.first[self.n + 1 : self.n + len(count) + 1] = used + np.cumsum(count)
        self.ids[used : used + len(ids)] = ids
        self.n += len(count)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each list, their ids one after another)."""
        count = self.first[numbers + 1] - self.first[numbers]
        return count, self.ids[ranges(self.first[numbers], count)]


class WordIds:
    """The ids of words, each tokenised once.

    A tokenizer that neither joins nor remembers anything across white space gives a text the ids of
    its words one after another; and one that cuts off signs behind letters gives a word those of its
    letters and those of its signs. Words are known by 64-bit hashes; what is remembered is bounded.
    """

    def __init__(self, definition: str, most: int = REMEMBERED_WORDS):
        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        self.plain = self.plain_letters()
        self.forget()

    def plain_letters(self) -> dict[int, str]:
        """What becomes of each ASCII letter, if the tokenizer changes each for itself and leaves a run of them whole; else nothing."""
        normal = self.tokenizer.normalizer.normalize_str(ascii_letters) if self.tokenizer.normalizer else ascii_letters
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else []
        whole = len(normal) == len(ascii_letters) and normal.isascii() and [x[0] for x in split] == [normal]
        return dict(zip(map(ord, ascii_letters), normal, strict=True)) if whole else {}

    def forget(self) -> None:
        self.words, self.parts = Lists(), Lists()
        self.number: dict[int, int] = {}
        self.seen = np.zeros(0, np.int64)
        self.forget_parts()

    def forget_parts(self) -> None:
        self.parts, self.part = Lists(), {"": 0}
        self.parts.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def make_room(self) -> None:
        """Keep the words that several batches had, if they are not too many as well."""
        kept = np.flatnonzero(self.seen > 1)
        values, (count, ids) = np.fromiter(self.number, np.uint64, len(self.number))[kept].tolist(), self.words.take(kept)
        self.forget()
        if len(kept) <= self.most // 2:
            self.words.add(count, ids)
            self.number, self.seen = dict(zip(values, range(len(values)), strict=True)), np.ones(len(values), np.int64)

    def ids_of(self, parts: list[str]) -> list[list[int]]:
        """The ids of words or parts of words; runs of ASCII letters go to the tokenizer's model as they are."""
        plain = [bool(self.plain) and p.isascii() and p.isalpha() for p in parts]
        model, table_ = self.tokenizer.model, self.plain
        rest = iter(self.tokenizer.encode_batch_fast([p for p, own in zip(parts, plain, strict=True) if not own], add_special_tokens=False))
        return [[t.id for t in model.tokenize(p.translate(table_))] if own else next(rest).ids for p, own in zip(parts, plain, strict=True)]

    def learn(self, values: list[int], texts: list[str]) -> None:
        stems = [b if b and b[-1] in ENDS else t for t, b in zip(texts, [t.rstrip(TAIL) for t in texts], strict=True)]
        tails = [t[len(s) :] for s, t in zip(stems, texts, strict=True)]
        if new := [p for p in dict.fromkeys((*stems, *tails)) if p not in self.part]:
            found = self.ids_of(new)
            self.part.update(zip(new, range(self.parts.n, self.parts.n + len(new)), strict=True))
            self.parts.add(np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32))
        both = np.empty((len(texts), 2), np.int64)
        both[:, 0], both[:, 1] = [self.part[s] for s in stems], [self.part[t] for t in tails]
        count, ids = self.parts.take(both.ravel())
        self.number.update(zip(values, range(self.words.n, self.words.n + len(values)), strict=True))
        self.words.add(count[::2] + count[1::2], ids)
        if len(self.part) > self.most // 4:
            self.forget_parts()

    def of(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text's followed by the id `end`, and where each text's begin."""
        w = words(column)
        distinct, place, inverse = np.unique(w.value, return_index=True, return_inverse=True)
        values = distinct.tolist()
        numbers = np.fromiter((self.number.get(v, -1) for v in values), np.int64, len(values))
        if self.words.n and self.words.n + np.count_nonzero(numbers < 0) > self.most:
            self.make_room()
            numbers = np.fromiter((self.number.get(v, -1) for v in values), np.int64, len(values))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            data, at = w.data.tobytes(), place[unknown]
            numbers[unknown] = np.arange(self.words.n, self.words.n + len(unknown))
            self.learn([values[k] for k in unknown.tolist()], [data[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            self.seen = np.concatenate([self.seen, np.zeros(len(unknown), np.int64)])
        self.seen[numbers] += 1
        count, ids = self.words.take(numbers[inverse]) if len(values) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        through = np.concatenate([[0], np.cumsum(count)])
        per_text = through[w.first[1:]] - through[w.first[:-1]]
        first = np.concatenate([[0], np.cumsum(per_text + 1)])
        out, own = np.full(int(first[-1]), end, np.uint32), np.ones(int(first[-1]), bool)
        own[first[1:] - 1] = False
        out[own] = ids
        return out, first


def remembered(definition: str) -> WordIds:
    """The words of a Python worker, which keeps them from one task to the next: they hang by a module that all its tasks share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    known = vars(tokenizers).setdefault("_known_words", {})
    if definition not in known:
        known.clear()
        known[definition] = WordIds(definition)
    return known[definition]


def added(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with piece, start, length and ids, a row for each piece of a document.

    A document is its ids by the tokenizer of the file `tokenizer` (without special tokens of its
    own), then the id `end`; `ids` are little-endian unsigned 32-bit integers. Only a document of more
    than `capacity` ids is cut, and only its last piece may be shorter. The tokenizer must treat words
    apart by white space each for itself, and a word's letters apart from signs behind them. Its definition, a few MB,
    is broadcast, so that executors need no copy of the file. A null or empty text is the id `end`
    alone; texts of any length are taken whole; repeated rows give their pieces each. Columns of docs
    named piece, start, length or ids can't be kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([*docs.select(*keep).schema, *added("piece int, start long, length long, ids binary")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(definition.value)
        for b in together(batches, TOGETHER_BYTES):
            ids, first = known.of(b.column(b.num_columns - 1), end)
            pieces = -(-np.diff(first) // capacity)
            row = np.repeat(np.arange(b.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(np.diff(first)[row] - start, capacity)
            at = np.append((first[:-1][row] + start) * 4, len(ids) * 4)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            kept = [b.column(k).take(pa.array(row)) for k in range(b.num_columns - 1)]
            names = [*b.schema.names[:-1], "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """(bin, offset) of each length as it arrives, and the free space of the bins that stay open.

    A piece goes to the open bin whose free space is the least that holds it. Bins hang by their free
    space, and one integer holds a bit for each free space that some bin has: the lowest bit from the
    length on is the best fit, and the lowest of all the fullest bin. That is the one to close when a
    new bin is needed and `open_bins` are open. A full bin closes at once.
    """
    bits, hung, opened, closed = 0, [[] for _ in range(capacity + 1)], 0, set()
    bins, offsets, bin_ = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def unhang(free: int) -> int:
        nonlocal bits
        taken = hung[free].pop()
        if not hung[free]:
            bits &= ~(1 << free)
        return taken

    for k, length in enumerate(lengths):
        if fitting := bits >> length:
            free = (fitting & -fitting).bit_length() - 1 + length
            at = unhang(free)
        else:
            if opened - len(closed) == open_bins:
                closed.add(unhang((bits & -bits).bit_length() - 1))
            at, free = opened, capacity
            opened += 1
        bins[k], offsets[k] = at, capacity - free
        if free == length:
            closed.add(at)
        else:
            hung[free - length].append(at)
            bits |= 1 << (free - length)
    return bins, offsets, {b: free for free, there in enumerate(hung) for b in there}


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """pieces, which have a column length of 1 to `capacity`, with sequence_id and offset.

    Bounded-space online best fit, in rounds. In each, rows are dealt at random to tasks of about
    `pieces_a_task`, and a task packs its own as they come. What lies in bins that are still open and
    not nearly full at its end is dealt anew in the next round, so that tasks leave no bins half empty
    behind. Once all that is left fits into as many bins as may be open, it comes longest first and
    every bin is closed, also if a round settled too little. A task holds its rows' places and no
    ids; nothing but counts comes to the driver. Places are gapless from 0 in each sequence. Repeated
    rows are packed each; an empty table gives no rows. Extra columns are kept; those named
    sequence_id, offset or _deal can't be.
    """
    schema = T.StructType([*pieces.schema, *added("sequence_id long, offset long")])
    rest, before, done, turn = materialize(pieces, "pieces"), None, [], 0
    while True:
        n, total = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
        last = not n or -(-total // capacity) <= open_bins or (before is not None and n > 0.9 * before)
        groups = max(1, -(-n // pieces_a_task))
        ordered = last and groups == 1

        def fit(batches: Iterator[pa.RecordBatch], turn: int = turn, last: bool = last) -> Iterator[pa.RecordBatch]:
            if not (had := list(batches)):
                return
            rows = pa.Table.from_batches(had)
            bins, offsets, left = best_fit(rows["length"].to_pylist(), capacity, open_bins)
            unsettled = np.array([not last and left.get(b, 0) > capacity // 256 for b in range(int(bins.max(initial=-1)) + 1)], bool)[bins]
            ids = (((turn << 24) + TaskContext.get().partitionId()) << 32) + bins
            for name, values in (("sequence_id", ids), ("offset", offsets)):
                rows = rows.append_column(name, pa.array(values, mask=unsettled))
            yield from rows.drop_columns("_deal").to_batches()

        # Numbered as the written table is read, so that a task that runs again deals alike.
        dealt = rest.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(turn))).repartition(groups)
        dealt = dealt.sortWithinPartitions(F.desc("length"), "_deal") if ordered else dealt.sortWithinPartitions("_deal")
        placed = materialize(dealt.mapInArrow(fit, schema), "packed")
        if turn == 0:
            discard(rest)
        done.append(placed.where("sequence_id is not null"))
        if last:
            break
        rest, before, turn = placed.where("sequence_id is null").select(pieces.columns), n, turn + 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, **options) -> DataFrame:
    """(sequence_id, ids, pieces array<struct<doc_id, piece, offset, length>>): the packed sequences themselves.

    ids are little-endian unsigned 32-bit integers, at most `capacity`. They are written once and join
    their places by number; a sequence's pieces, at most as many as its ids, meet in one row.
    """
    cut = materialize(tokenized(docs, tokenizer, capacity, end).withColumn("_number", F.monotonically_increasing_id()), "pieces")
    places = pack(cut.select("_number", "length"), capacity, **options).select("_number", "sequence_id", "offset")
    rows = cut.join(places, "_number").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("rows"))
    ids = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["ids"])), ""))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["piece"].alias("piece"), r["offset"].alias("offset"), r["length"].alias("length"))).alias("pieces"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the tokenizer of words, ids told by their checksum."""
    pieces = tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
