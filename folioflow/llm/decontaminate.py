"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import WORD, Words, bound_batches, discard, materialize, mix, runs_of, shingle_values, table, u64, words

FOUND = "found array<struct<item_id:bigint,n_shared:bigint,n_item:bigint>>"


def size_class(n: int) -> int:
    """Upper bound of the partition that a set of n shingles is in; bounds grow by the root of two."""
    k = max(0, math.ceil(2 * math.log2(n) - 1e-9))
    return math.ceil(2 ** (k / 2))


def exact_shingles(text: bytes, size: int) -> set[bytes]:
    ws = text.lower().split()
    return {b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


class Items:
    """A bounded block of test items with their MinHash tables, one for each size partition."""

    def __init__(self, ids: list[int], texts: list[str], size: int, hashes: int):
        column = pa.array(texts, pa.string())
        w = words(column, lower=True)
        value, first = shingle_values(w, size)
        self.size, self.ids, self.texts, count = size, ids, [t.encode() for t in texts], np.diff(w.first)
        #: Words of the shingles that an item is compared by: a short item is its only one.
        self.run = np.minimum(count, size)
        self.seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * u64(0x1F3D5B79))
        by_class: dict[int, list[int]] = {}
        sets = [np.unique(value[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        for i, s in enumerate(sets):
            if len(s) and count[i] >= size:
                by_class.setdefault(size_class(len(s)), []).append(i)
        self.tables = []
        for bound, members in sorted(by_class.items()):
            least = np.stack([[permuted(sets[i], s).min() for s in self.seeds] for i in members])
            order = least.argsort(0, kind="stable")
            self.tables.append((bound, np.take_along_axis(least, order, 0).T.copy(), np.array(members)[order].T.copy()))

        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(count[(count > 0) & (count < size)]):
            members = np.flatnonzero(count == n)
            order = value[first[members]].argsort(kind="stable")
            self.short[int(n)] = value[first[members]][order], members[order]

    def short_candidates(self, w: Words) -> set[tuple[int, int]]:
        """(text, item) where the whole of an item of fewer than `size` words has the value of a run of the text's words."""
        found: set[tuple[int, int]] = set()
        doc = w.doc()
        for n, (value, members) in self.short.items():
            with np.errstate(over="ignore"):
                x = mix(runs_of(w.value, n) + u64(n))
            a, b = np.searchsorted(value, x, "left"), np.searchsorted(value, x, "right")
            for k in np.flatnonzero((a < b) & (doc[: len(x)] == doc[n - 1 :])):
                found.update((int(doc[k]), int(i)) for i in members[a[k] : b[k]])
        return found

    def candidates(self, value: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) whose MinHash values agree somewhere, texts being cut into windows for each size partition.

        A window is two blocks of the partition's bound, and each block starts
        one, so that an item lies whole in some window, of a size that fits it.
        """
        found: set[tuple[int, int]] = set()
        if not len(value):
            return found
        n = np.diff(first)
        grids = []
        for bound, least, members in self.tables:
            blocks = -(-n // bound)
            doc = np.repeat(np.arange(len(n)), blocks)
            inside = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            grids.append((first[:-1][doc] + inside * bound, doc, np.append(doc[1:] == doc[:-1], False), least, members))
        for k, seed in enumerate(self.seeds):
            x = permuted(value, seed)
            for at, doc, goes_on, least, members in grids:
                low = np.minimum.reduceat(x, at)
                window = np.where(goes_on, np.minimum(low, np.append(low[1:], low[-1:])), low)
                a, b = np.searchsorted(least[k], window, "left"), np.searchsorted(least[k], window, "right")
                for w in np.flatnonzero(a < b):
                    found.update((int(doc[w]), int(i)) for i in members[k, a[w] : b[w]])
        return found


def permuted(value: np.ndarray, seed: np.uint64) -> np.ndarray:
    factor = u64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        x = (value ^ seed) * factor
        x ^= x >> np.uint64(32)
        return x * factor


def left_out(items: DataFrame, least_words: int = 1) -> DataFrame:
    """(item_id, text, n_words): the items that find_items doesn't search, as id or text is null or the words are fewer than least_words."""
    n = F.regexp_count("text", F.lit(WORD)).cast("bigint")
    return items.where(F.col("item_id").isNull() | (F.coalesce(n, F.lit(0)) < F.greatest(F.lit(1), F.lit(least_words)))).select("item_id", "text", n.alias("n_words"))


def searchable(items: DataFrame, least_words: int) -> DataFrame:
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return known.where(F.regexp_count("text", F.lit(WORD)) >= max(1, least_words))


def block_count(items: DataFrame, block_shingles: int, least_words: int) -> int:
    """Blocks of about block_shingles shingles that the items make, by the sum of their words."""
    total = searchable(items, least_words).agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    return -(-int(total) // block_shingles)


def blocks_of(items: DataFrame, size: int, hashes: int, n: int, least_words: int) -> Iterator[Items]:
    """The test items in n blocks, dealt by a hash, one at a time."""
    for k in range(n):
        rows = searchable(items, least_words).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if rows.num_rows:
            yield Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), size, hashes)


def find_items(docs: DataFrame, items: DataFrame, containment: float = 0.8, size: int = 5, hashes: int = 40, block_shingles: int = 1_000_000, least_words: int = 1) -> DataFrame:
    """docs with `found`: the test items whose distinct shingles are contained in the text by `containment` or more.

    Words are lower-cased (A-Z). Items are partitioned by size; for a partition
    each text is cut into windows of at most twice its bound, so that MinHash
    compares sets of like size. An item that a window holds by 0.8 has a Jaccard
    similarity of 0.26 at least with it and is missed by all of 40 hashes with
    a probability of 6e-6. Candidates are confirmed on the exact shingles of the
    whole text, so parts that lie far apart count together. An item of fewer
    than `size` words has its whole sequence as its only shingle: it is found
    where that occurs, by an exact search, with n_item 1. Items of fewer than
    `least_words` words are left out on request; left_out() lists them.

    Test items go to the executors in blocks of bounded size. One block is a
    pass over the documents in which nothing is shuffled. Of more, each is a
    pass of its own that writes what it found, so that the driver and a task
    hold one block at a time; what all found then joins the documents.

    Null and empty texts hold nothing, repeated rows and very long texts are
    searched each and whole; null item_ids are left out; an item_id with several
    texts is found by any. A column `found` of docs is replaced; all others are
    passed on. An empty table gives no rows, one without items empty lists.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("found")
    none = F.array().cast(T.StructType.fromDDL(FOUND)["found"].dataType)
    n = block_count(items, block_shingles, least_words)
    blocks = blocks_of(items, size, hashes, n, least_words)
    if n <= 1:
        return next((search(docs, block, containment) for block in blocks), docs.withColumn("found", none))
    key = [F.xxhash64("text").alias("_found_a"), F.xxhash64(F.lit(1), "text").alias("_found_b")]  # what is found depends on the text alone
    parts = []
    for block in blocks:
        hits = search(docs.select("text", *key), block, containment).drop("text").where(F.size("found") > 0)
        parts.append(materialize(hits.distinct().select("_found_a", "_found_b", F.explode("found").alias("f")), "items-found"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    every = materialize(every.groupBy("_found_a", "_found_b").agg(F.array_sort(F.collect_list("f")).alias("found")), "items-found")
    discard(*parts)
    return docs.select("*", *key).join(every, ["_found_a", "_found_b"], "left").select(*docs.columns, F.coalesce("found", none).alias("found"))


def search(docs: DataFrame, block: Items, containment: float) -> DataFrame:
    """docs with `found` for the items of one block."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("text"), lower=True)
            value, first = shingle_values(w, block.size)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            wanted: dict[int, list[int]] = {}
            for doc, item in sorted(block.candidates(value, first) | block.short_candidates(w)):
                wanted.setdefault(doc, []).append(item)
            for doc, some in wanted.items():
                text = w.text(doc)
                own = {k: exact_shingles(text, k) for k in {int(block.run[i]) for i in some}}
                for i in some:
                    asked = exact_shingles(block.texts[i], int(block.run[i]))
                    if (n := len(own[int(block.run[i])] & asked)) >= containment * len(asked) - 1e-9:
                        found[doc].append({"item_id": block.ids[i], "n_shared": n, "n_item": len(asked)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "found"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructType.fromDDL(FOUND)["found"]]))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    one = docs.select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.item_id").alias("item_id"), F.col("f.n_shared").alias("n_shared"), F.col("f.n_item").alias("n_item"))
    return one.withColumn("containment", F.col("n_shared") / F.col("n_item"))


OP2_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
v as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from benchmark),
k as (select unnest(range(1, 6)) as size),
s as (select distinct doc_id, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as g from w, k where len(ws) >= size),
b as (select distinct item_id, least(5, len(ws)) as size, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) as g from v where len(ws) >= 1),
n as (select item_id, count(*) as n_item from b group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from s join b using (size, g) group by all)
select doc_id, m.item_id, n_shared, n_item, n_shared / n_item as containment from m join n on n.item_id = m.item_id where n_shared >= 0.8 * n_item
"""
