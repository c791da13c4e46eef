"""Detection of periodic runs of words, and texts without their repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import WORD, bound_batches, mix, ranges, table, together, words

#: A run is at least so many times its period, and so many words.
EXPONENT, LEAST = 4, 6
#: Arrow batches are joined up to so many bytes, as each length is a step for all texts that are refined together.
TOGETHER_BYTES = 8 << 20
DEAD = -1


def breaks(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Partition:
    """Positions of words in classes of equal factors, refined from one factor length to the next.

    Positions are those of a batch of texts, each text followed by one place that equals nothing. Of
    length l, two positions are in one class if their factors of l words are equal. Their factors of
    l + 1 words are equal if also those of l words at the next positions are. So a class falls apart
    by the classes of its members' successors, and only where a successor's class is one that has just
    been split off. Of the parts of a split class all but the largest count as split off, whichever
    comes to keep its number: a position is looked at again only when its class has halved.

    A class lies in one piece of `order`, from `start`, `size` places long. Members are chained by
    position in `next` and `last`. A class of too few members for a run of the least exponent is dead:
    its members can't be in such a run with a period of l or more, nor then can their predecessors of
    length l + 1. So death passes on as a split does, and what can't matter isn't refined.
    """

    def __init__(self, key: np.ndarray, live: np.ndarray, most: np.ndarray, members: int):
        """key: of words; live: whether a place is one of a word; most: longest period that matters to each place."""
        n = len(key)
        self.most, self.members, self.length = most, members, 1
        self.cls, self.next, self.last, self.at = (np.full(n, DEAD) for _ in range(4))
        at = np.flatnonzero(live)
        at = at[np.argsort(key[at], kind="stable")]
        first = breaks(key[at])
        size = np.diff(np.append(first, len(at)))
        enough = size >= members
        self.order = at[np.repeat(enough, size)]
        self.size = size[enough]
        self.start = np.cumsum(self.size) - self.size
        self.used = len(self.size)
        self.at[self.order] = np.arange(len(self.order))
        self.cls[self.order] = np.repeat(np.arange(self.used), self.size)
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.chain(self.order, np.repeat(np.arange(self.used), self.size))
        self.moved, self.dying = self.order, np.flatnonzero(self.cls == DEAD)

    def chain(self, at: np.ndarray, group: np.ndarray) -> None:
        """Chain the members of groups, sorted by group and position."""
        with_next = group[1:] == group[:-1]
        self.next[at], self.last[at] = DEAD, DEAD
        self.next[at[:-1][with_next]] = at[1:][with_next]
        self.last[at[1:][with_next]] = at[:-1][with_next]
        self.await_length(at[:-1][with_next])

    def await_length(self, at: np.ndarray) -> None:
        """Neighbours in a class are looked at when factors have the length of their distance."""
        gap = self.next[at] - at
        matters = (gap >= self.length) & (gap <= self.most[at])
        at, gap = at[matters], gap[matters]
        if not len(at):
            return
        by = np.argsort(gap, kind="stable")
        at, gap = at[by], gap[by]
        first = breaks(gap)
        for g, part in zip(gap[first].tolist(), np.split(at, first[1:]), strict=True):
            self.waiting.setdefault(g, []).append(part)

    def squares(self) -> np.ndarray:
        """Sorted positions whose neighbour of the same class stands a factor's length on: there a square begins whose root repeats nothing shorter."""
        if not (parts := self.waiting.pop(self.length, None)):
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(parts))
        return at[(self.cls[at] != DEAD) & (self.next[at] - at == self.length)]

    def refine(self) -> bool:
        """Go on to factors of one more word; False if nothing changes any more."""
        successor = np.concatenate([self.moved, self.dying])
        at = successor - 1
        inside = at >= 0
        at, successor = at[inside], successor[inside]
        self.length += 1
        matters = (self.cls[at] != DEAD) & (self.most[at] >= self.length)
        at, label = at[matters], self.cls[successor[matters]]
        none = np.zeros(0, np.int64)
        if not len(at):
            self.moved = self.dying = none
            return False
        self.unchain(at)
        by = np.lexsort((at, label, self.cls[at]))
        at, label = at[by], label[by]
        old = self.cls[at]
        in_class, first = breaks(old), breaks(old, label)
        classes = old[in_class]
        moved_of = np.diff(np.append(in_class, len(at)))
        size = np.diff(np.append(first, len(at)))
        self.to_the_end(at, classes, in_class, moved_of)
        self.size[classes] -= moved_of
        rest = self.size[classes]
        # Parts that live on get numbers of their own.
        lives = (label[first] != DEAD) & (size >= self.members)
        new = np.full(len(first), DEAD)
        new[lives] = np.arange(self.used, self.used + int(lives.sum()))
        self.grow(int(lives.sum()))
        self.start[new[lives]], self.size[new[lives]] = self.at[at[first[lives]]], size[lives]
        self.cls[at] = np.repeat(new, size)
        # The largest part of a class is not looked at again, be it what is left or what moved.
        of = np.searchsorted(in_class, first, side="right") - 1
        weight = np.where(lives, size, 0)
        largest = np.maximum.reduceat(weight, np.flatnonzero(np.append(True, of[1:] != of[:-1])))
        moved_wins = largest > rest
        winner = np.zeros(len(first), bool)
        best = np.flatnonzero(lives & (weight == largest[of]) & moved_wins[of])
        winner[best[np.append(True, of[best][1:] != of[best][:-1])[: len(best)]]] = True
        goes_on = np.repeat(lives, size)
        few = (rest > 0) & (rest < self.members)
        again = moved_wins & ~few & (rest > 0)
        left = lambda which: self.order[ranges(self.start[classes[which]], rest[which])]
        starved = left(few)
        self.moved = np.concatenate([at[goes_on & ~np.repeat(winner, size)], left(again)])
        self.cls[starved] = DEAD
        self.dying = np.concatenate([at[~goes_on], starved])
        self.chain(at[goes_on], np.repeat(new, size)[goes_on])
        return True

    def unchain(self, at: np.ndarray) -> None:
        """Take members out of their chains, any number of neighbours at once."""
        at = at[np.lexsort((at, self.cls[at]))]
        linked = self.next[at[:-1]] == at[1:]
        before, after = self.last[at[np.append(True, ~linked)]], self.next[at[np.append(~linked, True)]]
        self.next[before[before != DEAD]] = after[before != DEAD]
        self.last[after[after != DEAD]] = before[after != DEAD]
        self.await_length(before[(before != DEAD) & (after != DEAD)])

    def to_the_end(self, at: np.ndarray, classes: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Move members, sorted by class and part, to the end of their class's places, in that order."""
        end = np.repeat(self.start[classes] + self.size[classes] - count, count)
        places = end + np.arange(len(at)) - np.repeat(first, count)
        there = self.order[places]
        from_ = self.at[at]
        self.at[at] = DEAD  # marks what moves
        stays = there[self.at[there] != DEAD]
        free = from_[from_ < end]
        self.order[free], self.at[stays] = stays, free
        self.order[places], self.at[at] = at, places

    def grow(self, more: int) -> None:
        while self.used + more > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x) + 16, np.int64)]) for x in (self.start, self.size))
        self.used += more


def periodic_runs(value: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of a batch of texts, by text, start and period.

    value: of all words; first: where each text's begin. Squares that begin at neighbouring positions
    and have one period make one run.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count + 1)
    began = first[:-1] + np.arange(len(count))
    live = np.ones(len(text), bool)
    live[began + count] = False
    key = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        key[live] = mix(value + mix(np.repeat(np.arange(len(count)), count).astype(np.uint64)))
    most = np.where(count >= least, count // exponent, 0)
    live &= most[text] > 0
    p = Partition(key, live, most[text], max(2, math.ceil(exponent) - 1))
    found = []
    while True:
        at = p.squares()
        if len(at):
            opens = np.flatnonzero(np.append(True, np.diff(at) != 1))
            starts, ends = at[opens], at[np.append(opens[1:] - 1, len(at) - 1)]
            length = ends - starts + 2 * p.length
            long = length >= max(least, exponent * p.length)
            found.append((starts[long], length[long], np.full(int(long.sum()), p.length)))
        if not p.refine():
            break
    start, length, period = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    return text[start], start - began[text[start]], length, period


def without_repeats(w, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The texts' words that no run holds after its first period, joined by one space: bytes, and where each text's begin."""
    cover = np.zeros(len(w.value) + 1, np.int64)
    np.add.at(cover, w.first[text] + start + period, 1)
    np.add.at(cover, w.first[text] + start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    starts, sizes = w.start[kept], w.end[kept] - w.start[kept] + 1  # a space after each
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(w.first), np.int64)
    out = np.append(w.data, np.uint8(32))[ranges(starts, sizes)]
    out[np.cumsum(sizes) - 1] = 32
    of = w.doc()[kept]
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes)[last] - 1] = False  # but for the last of a text
    sizes[last] -= 1
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(of, sizes, len(w.first) - 1).astype(np.int64))])


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The columns `keep` of docs with runs, by start and period, and collapsed, the text without their repeats.

    A run is a stretch of words with a smallest period, at least `exponent` times as long and `least`
    words, that can't be extended. Words are the contract's, numbered from 0 and compared by 64-bit
    hashes. All of a batch's texts are refined together: n words take some n log n steps, and there
    are as many rounds as the longest period in the batch that still matters. Collapsed texts keep of
    each run the first period. Null, empty and wordless texts have no run and collapse to the empty
    text; texts of any length are taken whole, in one task each; repeated rows are judged each. An
    empty table gives no rows. Columns named runs or collapsed can't be kept.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.select(*keep).schema, *T.StructType.fromDDL(RUNS)])
    kinds = T.StructType.fromDDL(RUNS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, TOGETHER_BYTES):
            w = words(b.column(b.num_columns - 1))
            of, *parts = periodic_runs(w.value, w.first, exponent, least)
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32()), rows)
            out, at = without_repeats(w, of, *parts)
            collapsed = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(at), pa.py_buffer(out)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], runs, collapsed], [*b.schema.names[:-1], *kinds.names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(find, schema)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of the contract, of which those of about a tenth of the ids are periodic from some word on. A null id leaves its text as it is."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words_ = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), words_.alias("_words")).withColumn("_n", F.size("_words").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1)
    word = lambda i: F.element_at("_words", (F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i) + 1).cast("int"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, told by their number, the one of the greatest exponent and digests."""
    found = find_runs(made_periodic(table(spark, sf_dir, "documents")))
    longer = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(longer(r, a), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Equal words of a text at a distance of up to a quarter of it, and their unbroken rows; of rows with one start and length the least period counts.
OP12_SQL = r"""
with recursive bits(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
remainders as (select list(c order by i) as m from bits where k = 8),
hashed as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::bigint)), lambda c, x: xor(c >> 8, m[(xor(c, x) & 255) + 1])), 4294967295) as h
  from documents, remainders),
sized as (select r, doc_id, ws, len(ws) as n, h, h // 10 as g from hashed),
shaped as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized),
periods as (select *, 1 + (n - a) // (3 + g % 8) as p from shaped),
words as (select r, n, i, ws[(case when i >= a then a + (i - a) % p else i end) + 1] as w from (select *, unnest(range(n)) as i from periods)),
pairs as (select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.w = y.w and y.i > x.i and y.i <= x.i + x.n // 4),
rows_ as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from pairs),
stretches as (select r, min(i) as s, count(*) + q as len_, q from rows_ group by r, q, k having count(*) + q >= greatest(6, 4 * q)),
runs as (select r, s, len_, min(q) as q from stretches group by r, s, len_),
dropped as (select distinct r, unnest(range(s + q, s + len_)) as i from runs),
collapsed as (select r, string_agg(w, ' ' order by i) as kept from words left join dropped using (r, i) where dropped.i is null group by r),
told as (select r, count(*) as n_runs, string_agg(s || ',' || len_ || ',' || q || chr(10), '' order by s, q) as lines, min({'x': -(len_::double / q), 's': s, 'q': q, 'len_': len_}) as best from runs group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s as start, best.len_ as length, best.q as period, 1000 * best.len_ // best.q as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from periods left join told using (r) left join collapsed using (r)
"""
