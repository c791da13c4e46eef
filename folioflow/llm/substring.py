"""Substring dedup by recompression: globally named token runs and pairs reveal long repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Words, bound_batches, discard, materialize, mix, table, u64, words

#: A run of more equal words is left as it is.
LONGEST_RUN = 16


def window_starts(w: Words, window: int) -> np.ndarray:
    """Indexes of the words that begin a window inside their text."""
    ok = np.zeros(len(w.value) + 1, np.int64)
    count = np.diff(w.first)
    full = count >= window
    np.add.at(ok, w.first[:-1][full], 1)
    np.add.at(ok, w.first[1:][full] - window + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:-1])


def fold(name: np.ndarray, at: np.ndarray, symbol: np.ndarray, salt: int) -> None:
    """Append a symbol, and in which round and on which side it was given up, to the names at `at`; both halves."""
    with np.errstate(over="ignore"):
        name[0, at] = mix(name[0, at] * u64(0x2545F4914F6CDD1D) + symbol + u64(salt))
        name[1, at] = mix((name[1, at] ^ symbol) * u64(0x9FB21C651E98DF25) + u64(salt))


def recompress(w: Words, window: int, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, name): for each window its first word, a symbol that lies inside it, and its 128-bit name, two rows.

    Each round names runs or pairs of neighbouring symbols by a hash of their
    parts alone, so a name stands for one sequence of words wherever it occurs,
    on any executor. A pair is formed where a left symbol precedes a right one;
    a hash of the symbol and the round decides which side it is on. What lies
    outside a window can change a name only at its ends: the first symbol if
    it is on the right side, the last if on the left, the first and last run.
    These are given up round by round, and all that is left is the same wherever
    the window occurs. A region of one symbol gives that up and larger ones
    shrink, so rounds end by themselves. The anchor is the first symbol left in
    the last round that leaves one. The name is that of the symbols that were
    given up, in order, on either side: together they spell the window, so
    windows are equal exactly if these are.
    """
    start = window_starts(w, window)
    n, value = len(w.value), w.value
    name = np.zeros((2, len(start) if names else 0), np.uint64)
    if not len(start):
        return start, np.zeros(0, np.uint64), name
    anchor = mix(value[start] ^ u64(0xA5))
    fresh = np.zeros(n, bool)
    fresh[w.first[:-1][np.diff(w.first) > 0]] = True

    # runs of equal words
    begins = fresh.copy()
    begins[1:] |= value[1:] != value[:-1]
    run_at = np.flatnonzero(begins)
    length = np.diff(np.append(run_at, n))
    run = np.cumsum(begins) - 1
    named = (length > 1) & (length <= LONGEST_RUN)
    keep = begins | ~named[run]
    with np.errstate(over="ignore"):
        symbol = np.where(named[run], mix(value + u64(0x51ED2701) * length[run].astype(np.uint64)), value)[keep]
    left = np.minimum((run_at + length)[run[start]], start + window)
    right = np.maximum(run_at[run[start + window - 1]], left)
    if names:
        every = np.arange(len(start))
        for edge, many, salt in ((value[start], left - start, 1), (value[start + window - 1], start + window - right, 2)):
            fold(name, every, mix(edge + many.astype(np.uint64)), salt)
    index = np.append(np.cumsum(keep) - 1, keep.sum())
    left, right, fresh = index[left], index[right], fresh[keep]
    alive = np.flatnonzero(left < right)
    left, right = left[alive], right[alive]
    anchor[alive] = symbol[left]

    r = 0
    while len(alive):
        is_left = (mix(symbol ^ u64(0x9E37 + 2 * r + 1)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(symbol), bool)
        joined[1:] = is_left[:-1] & ~is_left[1:] & ~fresh[1:]
        keep = ~joined
        from_left, from_right = ~is_left[left], is_left[right - 1]
        if names:
            fold(name, alive[from_left], symbol[left[from_left]], 4 * r + 5)
            fold(name, alive[from_right], symbol[right[from_right] - 1], 4 * r + 6)
        left, right = left + from_left, right - from_right
        left_in = left < right
        alive, left, right = alive[left_in], left[left_in], right[left_in]
        head = np.flatnonzero(joined) - 1
        with np.errstate(over="ignore"):
            symbol[head] = mix(symbol[head] * u64(0x2127599BF4325C37) + symbol[head + 1] + u64(r))
        index = np.append(np.cumsum(keep) - 1, keep.sum())
        symbol, fresh = symbol[keep], fresh[keep]
        left, right = index[left], index[right]
        anchor[alive] = symbol[left]
        r += 1
    return start, anchor, name


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, whole text (null: empty) and a 128-bit name of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("k2"))


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(symbol, doc_id, k, first, last): runs of neighbouring windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("text"))
            start, symbol, _ = recompress(w, window, names=False)
            if not len(start):
                continue
            change = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1] + 1)))
            to = np.append(change[1:], len(start)) - 1
            doc = np.searchsorted(w.first, start[change], side="right") - 1
            base = w.first[doc]
            ids, key = batch.column("doc_id").take(pa.array(doc)), batch.column("k").take(pa.array(doc))
            out = [pa.array(symbol[change].view(np.int64)), ids, key, pa.array((start[change] - base).astype(np.int32)), pa.array((start[to] - base).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["symbol", "doc_id", "k", "first", "last"])

    return docs.select("doc_id", "k", "text").mapInArrow(run, "symbol long, doc_id long, k long, first int, last int")


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, k, start) of the windows that the `runs` of each row name, by the names that their symbols give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("text"))
            begin, _, name = recompress(w, window)
            runs = batch.column("runs")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            first, last = (runs.flatten().field(c).to_numpy(zero_copy_only=False) + w.first[owner] for c in ("first", "last"))
            edge = np.zeros(len(w.value) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + 1, -1)
            wanted = np.flatnonzero(np.cumsum(edge)[begin] > 0)
            at = begin[wanted]
            doc = np.searchsorted(w.first, at, side="right") - 1
            ids = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "k")]
            yield pa.RecordBatch.from_arrays([*(pa.array(h[wanted].view(np.int64)) for h in name), *ids, pa.array((at - w.first[doc]).astype(np.int32))], names=["h1", "h2", "doc_id", "k", "start"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, k long, start int")


def remove_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of rows (doc_id, text, copy, starts): all words go from a copy of at least `window` words, else those of the windows at `starts`.

    Null texts are empty, null starts none; each row is judged for itself, whatever repeats, and
    other columns are not passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, copy, starts in zip(*(batch.column(c) for c in ("doc_id", "text", "copy", "starts")), strict=True):
                ws = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(ws)
                spans: list[dict] = []
                if copy.as_py() and n >= window:
                    spans, ws = [{"first": 0, "last": n - 1}], []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    s = np.asarray(starts.values)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                    ws = [x for x, g in zip(ws, gone, strict=True) if not g]
                out.append((doc.as_py(), n, n - len(ws), spans, b" ".join(ws).decode("utf-8")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) for each row: words in repeated windows go.

    A word goes if a window of `window` consecutive words that covers it also
    starts in a document with a smaller doc_id. Anchors of at least two
    different texts tell which windows may repeat; only these are compared, by
    the 128-bit names that their symbols give. Of equal texts only the smallest doc_id's
    takes part, the others go whole, so a group of copies adds nothing to the
    joins. Minima are partial aggregates; the joins that follow are between
    scans, so that a passage in very many documents is split at run time.

    Null text is empty. Rows with a null doc_id keep their words, and no other
    row loses words to them. Rows with one doc_id are not compared with each
    other; equal rows give equal results, each. Texts of any length are taken
    whole. Other columns are not read. An empty table gives no rows.

    Names are hashes of their parts, which every executor computes alike: the
    global step of a round is agreement on the hash, not a table of names. What
    crosses executors is the anchors, to find those that texts share, and then
    the names of the windows around them.
    """
    bound_batches(docs.sparkSession)
    docs = with_key(docs)
    known = docs.where("doc_id is not null")
    found = materialize(anchor_rows(known, window), "anchors")
    shared = found.groupBy("symbol").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x < y").select("symbol")
    shared = materialize(shared, "symbols")
    firsts = known.select("doc_id", "k", "k2").groupBy("k", "k2").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialize(firsts.select("doc_id", "k"), "first-texts")
    hits = found.join(shared, "symbol").groupBy("doc_id", "k").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hits = materialize(hits.join(firsts, ["doc_id", "k"], "left_semi"), "hits")
    discard(found, shared)
    candidates = materialize(window_rows(known.drop("k2").join(hits, ["doc_id", "k"]).select("doc_id", "k", "text", "runs"), window), "windows")
    repeated = candidates.groupBy("h1", "h2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).where("earliest < latest").drop("latest")
    repeated = materialize(repeated, "repeated")
    gone = candidates.join(repeated, ["h1", "h2"]).where("doc_id > earliest").groupBy("doc_id", "k").agg(F.collect_set("start").alias("starts"))
    discard(hits)
    info = materialize(firsts.join(gone, ["doc_id", "k"], "left").withColumn("first", F.lit(True)), "repeats")
    discard(firsts, candidates, repeated)
    full = docs.drop("k2").join(info, ["doc_id", "k"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return remove_words(full.select("doc_id", "text", copy.alias("copy"), "starts"), window)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from g),
r as (select doc_id, i, min(doc_id) over (partition by k) as earliest from h),
s as (select doc_id, list(i) as starts from r where earliest < doc_id group by doc_id),
c as (select doc_id, list_sort(list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50))))) as gone from s),
o as (select w.doc_id, ws, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed, gone from w left join c on c.doc_id = w.doc_id),
p as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from o),
q as (select doc_id, unnest(gone) as i from c),
k as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept from p left join q on q.doc_id = p.doc_id and q.i = p.i where q.i is null group by p.doc_id)
select o.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from o left join k on k.doc_id = o.doc_id
"""
