"""Exact top-k search by KD-trees, one for each shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, materialize


class KDTree:
    """Median splits on the widest side, down to leaves, with the tight box of each node's vectors.

    Vectors are whole numbers, int64 or Python's own where these would not do.
    """

    def __init__(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = 64):
        self.rids, self.ids, self.vectors, self.largest = rids, ids, vectors, largest(vectors)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = vectors[rows]
            low, high = own.min(0), own.max(0)
            me = len(self.kids)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(ids[rows].min()))
            self.kids.append(None)
            self.rows.append(rows)
            if parent >= 0:
                pair = self.kids[parent] or (0, 0)
                self.kids[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            axis = int(np.argmax(high - low))
            if len(rows) <= leaf or high[axis] == low[axis]:
                continue
            order = rows[np.argsort(own[:, axis], kind="stable")]
            self.rows[me] = None
            todo += [(order[: len(order) // 2], me, 0), (order[len(order) // 2 :], me, 1)]

    def bound(self, node: int, up: np.ndarray, down: np.ndarray) -> int:
        """No vector in the node's box has a larger inner product; up and down are the query's positive and negative parts."""
        return int(up @ self.high[node] + down @ self.low[node])

    def search(self, rid: int, q: np.ndarray, k: int, kth: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of rows other than rid, best first; kth is the k-th best that is known already."""
        if len(q) * self.largest * largest(q) >= 1 << 62:
            q = q.astype(object)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[tuple[int, int]] = []
        floor = kth
        heap = [(-self.bound(0, up, down), 0)] if len(self.ids) else []
        while heap:
            minus, node = heapq.heappop(heap)
            if floor is not None and (-minus, -self.least[node]) <= floor:
                if -minus < floor[0]:
                    break
                continue
            if (kids := self.kids[node]) is not None:
                for kid in kids:
                    heapq.heappush(heap, (-self.bound(kid, up, down), kid))
                continue
            rows = self.rows[node]
            rows = rows[self.rids[rows] != rid]
            score, ids = self.vectors[rows] @ q, self.ids[rows]
            order = np.lexsort((ids, -score)) if score.dtype != object else sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
            for i in order[:k]:
                found = (int(score[i]), -int(ids[i]))
                if floor is not None and found <= floor:
                    break
                heapq.heappush(best, found)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    floor = max(best[0], floor) if floor is not None else best[0]
        return sorted(best, reverse=True)


def largest(x: np.ndarray) -> int:
    return int(max(-x.min(), x.max())) if x.size else 0


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: as int64, or as Python's whole numbers where a component is beyond 2^53."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if not scaled.size or np.abs(scaled).max() < 1 << 53:
        return scaled.astype(np.int64)
    each = [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in vectors.ravel().tolist()]
    return np.array(each, object).reshape(vectors.shape)


def stacked(rows: pd.DataFrame, scale: int) -> np.ndarray:
    return whole(np.stack(rows["v"].to_list()).astype(float), scale)


def tree_of(rows: pd.DataFrame, scale: int) -> KDTree:
    return KDTree(rows["rid"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), stacked(rows, scale))


def searched(tree: KDTree, asked: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    out = []
    for q, v in zip(asked.itertuples(index=False), stacked(asked, scale) if len(asked) else (), strict=True):
        kth = None if pd.isna(q.kth_score) else (int(q.kth_score), -int(q.kth_id))
        out += [(int(q.rid), int(q.vec_id), -i, s) for s, i in tree.search(int(q.rid), v, k, kth)]
    if any(abs(x[3]) >= 1 << 63 for x in out):
        raise OverflowError("an inner product does not fit 64 bits")
    return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"]).astype("int64")


class Splits:
    """The top of a KD-tree over a sample: axis and value of each inner node of a complete tree."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.value = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = {0: sample}
        for node in range(2**depth - 1):
            own = parts.pop(node)
            if len(own):
                self.axis[node] = a = int(np.argmax(own.max(0) - own.min(0)))
                self.value[node] = np.median(own[:, a])
            above = own[:, self.axis[node]] > self.value[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~above], own[above]

    def cell(self, v: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(v), np.int64), np.arange(len(v))
        for _ in range(self.depth):
            node = 2 * node + 1 + (v[rows, self.axis[node]] > self.value[node])
        return node - (2**self.depth - 1)


def sharded(rows: DataFrame, shard_rows: int, sample_rows: int, max_depth: int = 10) -> DataFrame:
    """rows with `shard`, a name of about shard_rows vectors of one length that lie together.

    Space is cut by the medians of a sample of at most sample_rows vectors, into
    1,024 cells at most for each of the sample's lengths; a cell of more than
    shard_rows is cut further by a hash of the row, so that equal or crowded
    vectors spread over shards.
    """
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("rid")).limit(sample_rows).select("d", "v").toPandas()
    splits = {}
    for d, own in sorted(sample.groupby("d"), key=lambda x: -len(x[1]))[:16]:
        depth = min(max_depth, max(0, math.ceil(math.log2(max(1, n / shard_rows * len(own) / len(sample))))))
        splits[int(d)] = Splits(np.stack(own["v"].to_list()).astype(float), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, cell = batch.column("d").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for length in np.unique(d):
                if int(length) in splits:
                    at = np.flatnonzero(d == length)
                    cell[at] = splits[int(length)].cell(batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = materialize(rows.mapInArrow(place, f"{ROW}, cell long"), "placed")
    parts = placed.groupBy(F.col("d").alias("cd"), F.col("cell").alias("cc")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    placed = placed.join(materialize(parts, "cells"), (F.col("d") == F.col("cd")) & (F.col("cell") == F.col("cc")))
    return materialize(placed.select(*ROW_NAMES, F.xxhash64("d", "cell", F.pmod(F.xxhash64("rid"), "parts")).alias("shard")), "shards")


ROW = "rid long, vec_id long, d int, asked boolean, v array<double>"
ROW_NAMES = [x.split()[0] for x in ROW.split(", ")]
PART = "q long, query_id long, vec_id long, score long"


def best_of(parts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def kth_of(parts: DataFrame, k: int) -> DataFrame:
    return best_of(parts, k).where(F.col("rank") == k).select(F.col("q").alias("kq"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))


def fresh(df: DataFrame) -> DataFrame:
    """The same with columns of its own: two sides of a join or cogroup may come from one table."""
    return df.toDF(*df.columns)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 2_000, query_rows: int = 2_000, sample_rows: int = 20_000, told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with other rows.

    Components become floor(scale * x). Rows are dealt to shards that lie
    together in space, and to each shard its KD-tree. A query is first searched
    in the shard it lives in, which gives its k-th score. Then queries meet the
    boxes of all shards (a row for each shard), in blocks of about query_rows:
    only pairs whose box-to-query bound exceeds the k-th score go on. Of these
    the shard with the largest bound comes first, and its k-th score prunes the
    rest once more, before any vector is sent, and from the first node on in the
    trees. Queries are sent in blocks, so a task holds one shard and one block.
    `told` receives the numbers of queries, shards, and pairs searched.

    Every row but the query's own is a candidate, whatever its vec_id: repeated
    rows count each, and are queries each. Vectors that are null or hold null or
    non-finite components take no part, nor rows with a null id. Only vectors of
    the query's length are compared. Ties go to the smaller vec_id. Arithmetic
    is exact at any size; a result that does not fit 64 bits is an error. Other
    columns are not read. An empty table gives no rows.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite & (F.size(x) > 0))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.size(x).alias("d"), F.coalesce(is_query, F.lit(False)).alias("asked"), x.cast("array<double>").alias("v"))
    rows = materialize(rows, "vectors")  # written once, so that the numbers stand
    placed = sharded(rows, shard_rows, sample_rows)
    discard(rows)

    def at_home(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = tree_of(part, scale)
        found = searched(tree, part[part["asked"]].assign(kth_score=None, kth_id=None), k, scale)
        box = pd.DataFrame([(key[0], key[1], part["v"].map(len).iloc[0], [str(a) for a in tree.low[0]], [str(a) for a in tree.high[0]], tree.least[0])], columns=["d", "shard", "n", "low", "high", "least"])
        return pd.concat([found.assign(d=key[0], shard=key[1], low=None, high=None, least=None), box.drop(columns="n").assign(q=None, query_id=None, vec_id=None, score=None)])[[c.split()[0] for c in HOME.split(", ")]].astype(object)

    HOME = f"{PART}, d int, shard long, low array<string>, high array<string>, least long"
    home = materialize(placed.groupBy("d", "shard").applyInPandas(at_home, HOME), "home")
    boxes = home.where("q is null").select("d", "shard", "low", "high", "least")
    found = home.where("q is not null").select("q", "query_id", "vec_id", "score")
    asked = placed.where("asked")
    queries, shards = asked.count(), boxes.count()
    blocks, box_blocks = max(1, -(-queries // query_rows)), max(1, -(-shards // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "rid"), F.lit(blocks)).cast("int")).drop("asked")
    asked = materialize(asked.join(kth_of(found, k), F.col("rid") == F.col("kq"), "left").drop("kq"), "queries")

    def reach(key: tuple, asked: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a query and another shard that may hold something better than its k-th. A bound beyond 64 bits becomes the last number there: no score that fits lies beyond."""
        if not len(asked) or not len(box):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("q", "int64"), ("to", "int64"), ("bound", "int64"), ("least", "int64"))})
        q = stacked(asked, scale)
        low, high = (np.array([[int(a) for a in row] for row in box[c]], object) for c in ("low", "high"))
        if q.shape[1] * largest(q) * max(largest(low), largest(high)) < 1 << 62:
            q, low, high = q.astype(np.int64), low.astype(np.int64), high.astype(np.int64)
        else:
            q = q.astype(object)
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        shard, least, out = box["shard"].to_numpy(), box["least"].to_numpy(), []
        for i, a in enumerate(asked.itertuples(index=False)):
            open_ = shard != a.shard
            if not pd.isna(a.kth_score):
                open_ &= (bound[i] > int(a.kth_score)) | ((bound[i] == int(a.kth_score)) & (least < int(a.kth_id)))
            j = np.flatnonzero(open_)
            out.append(pd.DataFrame({"q": a.rid, "to": shard[j], "bound": [min(max(int(x), -1 << 63), (1 << 63) - 1) for x in bound[i][j]], "least": least[j]}))
        return pd.concat(out)

    sides = fresh(asked.withColumn("boxes", F.explode(F.sequence(F.lit(0), F.lit(box_blocks - 1))))), fresh(boxes.withColumn("boxes", F.pmod(F.xxhash64("shard"), F.lit(box_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    pairs = sides[0].groupBy("d", "block", "boxes").cogroup(sides[1].groupBy("d", "block", "boxes")).applyInPandas(reach, "q long, to long, bound long, least long")
    pairs = materialize(pairs.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "to"))), "pairs")

    def abroad(key: tuple, asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in PART.split(", ")})
        return searched(tree_of(part, scale), asked, k, scale)

    def visit(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        sent = fresh(pairs.join(asked, F.col("q") == F.col("rid")).select("to", "block", "rid", "vec_id", "v", "kth_score", "kth_id"))
        where = fresh(sent.select("to", "block").distinct())
        met = placed.join(where, F.col("shard") == F.col("to")).select("to", "block", "rid", "vec_id", "v")
        return materialize(sent.groupBy("to", "block").cogroup(fresh(met).groupBy("to", "block")).applyInPandas(abroad, PART), "away")

    first = pairs.where("turn = 1").select("q", "to")
    found_ = found.union(visit(first, asked))
    better = materialize(asked.drop("kth_score", "kth_id").join(kth_of(found_, k), F.col("rid") == F.col("kq"), "left").drop("kq"), "queries")
    limit = better.select(F.col("rid").alias("r"), "kth_score", "kth_id")
    beats = F.col("kth_score").isNull() | (F.col("bound") > F.col("kth_score")) | ((F.col("bound") == F.col("kth_score")) & (F.col("least") < F.col("kth_id")))
    rest = materialize(pairs.where("turn > 1").join(limit, F.col("q") == F.col("r")).where(beats).select("q", "to"), "pairs-left")
    if told is not None:
        told |= {"queries": queries, "shards": shards, "first": first.count(), "rest": rest.count()}
    out = best_of(found_.union(visit(rest, better)), k).select("query_id", "rank", "vec_id", "score")
    return out


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid, a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.rid <> b.rid where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
