"""Near duplicates by a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bound_batches, discard, materialize, mix, shingle_values, table, u64, words
from folioflow.llm.graph import components

FIRST_DEPTH = 2


def tree_count(percent: int, depth: int, missed: float) -> int:
    """Trees in which a pair at the threshold is apart at the last depth of all with a probability of `missed` at most."""
    apart = 1 - (percent / 100) ** depth
    return max(1, math.ceil(math.log(missed) / math.log(apart))) if apart > 0 else 1


def chosen_paths(values: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text with shingles, its node at depths FIRST_DEPTH to depth of each tree.

    A node's name seeds the choice of the token that leads on: the one with the
    least hash under that name, so two sets go on together with their Jaccard
    similarity as the probability, at each level and tree anew.
    """
    sizes, starts = np.diff(first), first[:-1]
    out = []
    factor = u64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for t in range(trees):
            node = np.full(len(sizes), mix(np.array([u64(t + 1)]))[0])
            for level in range(1, depth + 1):
                x = (values ^ np.repeat(node, sizes)) * factor
                x ^= x >> np.uint64(29)
                x *= factor
                node = mix(node + np.minimum.reduceat(x, starts) * factor + u64(level))
                if level >= FIRST_DEPTH:
                    out.append(node)
    return np.stack(out, 1).view(np.int64) if out else np.zeros((len(sizes), 0), np.int64)


def signatures(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_a, set_b, paths): the set's size, its 128-bit name, its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first = shingle_values(words(batch.column("text"), lower=True), size)
            sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            paths: list = [None] * len(n)
            if len(full):
                flat, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])])
                with np.errstate(over="ignore"):
                    a[full], b[full] = np.add.reduceat(mix(flat ^ u64(11)), at[:-1]), np.add.reduceat(mix(flat ^ u64(13)), at[:-1])
                for i, p in zip(full, chosen_paths(flat, at, trees, depth), strict=True):
                    paths[i] = p
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(paths, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "paths"],
            )

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, paths array<long>")


def leaves(classes: DataFrame, trees: int, depth: int, node_limit: int, shingle_limit: int) -> DataFrame:
    """(rep, tree, cell, chunk, chunks, pivot): each set's leaf in each tree, where it is not alone.

    A node of at most node_limit sets and shingle_limit shingles is a leaf,
    larger ones branch on; the last depth is a leaf at any size, and is cut by a
    hash into chunks of about these limits. Only members of larger nodes go on.
    pivot is the leaf's smallest rep.
    """
    per = depth - FIRST_DEPTH + 1
    tree = F.sequence(F.lit(0), F.lit(trees - 1))
    rows = classes.select("rep", "n_shingles", F.explode(F.transform(tree, lambda t: F.struct(t.alias("tree"), F.slice(F.col("paths"), t * per + 1, per).alias("rest")))).alias("p")).select("rep", "n_shingles", "p.tree", "p.rest")
    out, spent = None, []
    for level in range(per):
        here = rows.select("rep", "n_shingles", "tree", F.col("rest")[0].alias("cell"), F.slice("rest", 2, per).alias("rest"))
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / node_limit, F.sum("n_shingles") / shingle_limit)).cast("int").alias("chunks")
        nodes = here.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("pivot"), parts).where("members > 1")
        nodes = materialize(nodes.withColumnRenamed("cell", "name").drop("members"), "nodes")
        met = materialize(here.join(nodes, F.col("cell") == F.col("name")).drop("name"), "members")
        spent += [nodes, met]
        ends = F.col("chunks") == 1 if level < per - 1 else F.lit(True)
        leaf = met.where(ends).select("rep", "tree", "cell", F.pmod(F.xxhash64("rep", "cell"), "chunks").cast("int").alias("chunk"), "chunks", "pivot")
        out = leaf if out is None else out.union(leaf)
        rows = met.where(~ends).select("rep", "n_shingles", "tree", "rest")
        if level < per - 1 and rows.isEmpty():
            break
    out = materialize(out, "leaves")
    discard(*spent)
    return out


def join_up(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of the first set of its component, by exact comparison of all; with sides, of sets on different sides only.

    Shared elements are counted through an inverted index, so sets without a
    common element cost nothing, and memory is that of the sets.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    new = np.append(True, flat[order][1:] != flat[order][:-1])
    group = np.empty(len(flat), np.int64)
    group[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(flat)))
    owner_of, first = owner[order], np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        g = group[first[i] : first[i + 1]]
        g = g[count[g] > 1]
        if not len(g):
            continue
        c = count[g]
        at = np.repeat(begin[g] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        common = np.bincount(owner_of[at], minlength=n)
        alike = 100 * common >= percent * (size[i] + size - common)
        if sides is not None:
            alike &= sides != sides[i]
        alike[i] = True
        met = np.unique(label[alike])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def linked(rows: DataFrame, size: int, percent: int, both_sides: bool = False) -> DataFrame:
    """(a, b): links that join what belongs together in each cell of rows (cell, rep, text[, side]); one less than the members of a component."""
    columns = ["cell", "rep", "text", *["side"] * both_sides]
    dealt = rows.select(columns).repartition("cell").sortWithinPartitions("cell", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> tuple[list[int], list[int]]:
            if len(held) < 2:
                return [], []
            ids = [h[0] for h in held]
            label = join_up([h[1] for h in held], percent, np.array([h[2] for h in held]) if both_sides else None)
            pairs = [(ids[r], ids[i]) for i, r in enumerate(label) if ids[r] != ids[i]]
            return [p[0] for p in pairs], [p[1] for p in pairs]

        cell = None
        for batch in batches:
            value, first = shingle_values(words(batch.column("text"), lower=True), size)
            cells, reps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "rep"))
            side = batch.column("side").to_numpy(zero_copy_only=False) if both_sides else np.zeros(len(cells), np.int64)
            a: list[int] = []
            b: list[int] = []
            for k in range(len(cells)):
                if cells[k] != cell:
                    x, y = settle()
                    a += x
                    b += y
                    held.clear()
                    cell = cells[k]
                held.append((reps[k], np.unique(value[first[k] : first[k + 1]]), side[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        x, y = settle()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def still_mixed(leaf: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(members of leaves where several components meet, with `label`; the tables behind them)."""
    if labels is None:
        return leaf.withColumn("label", F.col("rep")), []
    named = materialize(leaf.join(labels, F.col("rep") == F.col("v"), "left").drop("v").withColumn("label", F.coalesce("component", "rep")).drop("component"), "labelled")
    mixed = materialize(named.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cell"), "mixed")
    return named.join(mixed, "cell", "left_semi"), [named, mixed]


def rest_of_large(leaf: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Links that chunks may have missed: in leaves of several chunks where components still meet, all sets outside the largest component against all sets, chunk by chunk."""
    rows, spent = still_mixed(leaf.where("chunks > 1"), labels)
    large = materialize(rows, "large")
    if large.isEmpty():
        return None, [*spent, large]
    top = large.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max(F.struct("n", "label")).alias("top")).select("cell", F.col("top.label").alias("top"))
    marked = materialize(large.join(top, "cell").withColumn("few", F.col("label") != F.col("top")), "marked")
    some = marked.where("few").select("cell", F.col("chunk").alias("from")).distinct()
    each = F.sequence(F.lit(0), F.col("chunks") - 1)
    left = marked.where("few").withColumn("to", F.explode(each)).select(F.xxhash64("cell", "chunk", "to").alias("cell"), "rep", F.lit(0).alias("side"))
    right = marked.join(some, "cell").select(F.xxhash64("cell", "from", "chunk").alias("cell"), "rep", F.lit(1).alias("side"))
    return linked(left.union(right).join(texts, "rep"), size, percent, both_sides=True), [*spent, large, marked]


def links_of(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("v").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, trees: int | None = None, depth: int = 4, node_limit: int = 256, shingle_limit: int = 2_000_000, missed: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are lower-cased (A-Z); a set holds the distinct shingles of `size`
    words of the whole text. Sets that are equal become one class by a partial
    aggregate, so copies cost no more than their signatures. Classes branch down
    `trees` independent trees by their minwise tokens; a pair of similarity s
    is in no common leaf at depth k of t trees with probability (1 - s^k)^t.
    Unless given, trees are as many as bring that to `missed` or less for a pair
    at the threshold and the last depth: 16 trees for 0.85 (7e-6) and 22 for
    0.80 (9e-6) at depth 4. At depth 5 these take 20 and 29; 16 trees would miss
    8e-5 and 1.7e-3 there.

    Leaves are compared exhaustively on the full sets, where the texts of a leaf
    meet in one task; a leaf gives links that span its components, not pairs.
    Trees run in three rounds, and a later round leaves out leaves whose sets
    are all in one component by then, as more links there change nothing. A leaf
    that is large even at the last depth, by its sets or by their shingles, is
    compared in chunks, each with the leaf's smallest set; what then is still
    apart in it is compared with all of it, chunk by chunk. So nothing is
    capped, and a task holds two chunks: 512 sets or 4 million shingles, or two
    single sets beyond that.

    Null and empty texts, and null ids, link with nothing: n_shingles 0, or the
    null id as component_id, and kept. Rows with one doc_id count as one
    document: the sets of all its texts are linked, and all its rows with words
    have one component. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    trees = tree_count(percent, depth, missed) if trees is None else trees
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = materialize(signatures(docs, size, trees, depth), "signatures")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_key", "n_shingles", "paths")).alias("least")
    named = own.groupBy("set_a", "set_b").agg(least).select("set_a", "set_b", "least.*", F.monotonically_increasing_id().alias("rep"))
    classes = materialize(named, "classes")  # written once, so that the numbers stand
    leaf = leaves(classes, trees, depth, node_limit, shingle_limit)
    asked = leaf.select("rep").distinct().join(classes.select("rep", F.col("doc_id").alias("d"), F.col("text_key").alias("t")), "rep")
    texts = materialize(docs.join(asked, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("t"))).groupBy("rep").agg(F.max("text").alias("text")), "texts")

    several = own.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).where("x < y").select(F.col("doc_id").alias("d"))
    several = own.join(several, F.col("doc_id") == F.col("d")).select(F.col("doc_id").alias("one"), "set_a", "set_b").distinct().join(classes.select("rep", "set_a", "set_b"), ["set_a", "set_b"])
    several = materialize(several.select("one", "rep"), "one-document")
    links = several.join(several.groupBy(F.col("one").alias("same")).agg(F.min("rep").alias("a")), F.col("one") == F.col("same")).where("a < rep").select("a", F.col("rep").alias("b"))

    labels = None
    for lo, hi in ((0, 1), (1, 4), (4, trees)):
        rows, spent = still_mixed(leaf.where(F.col("tree").between(lo, hi - 1)), labels)
        cells = rows.select(F.xxhash64("cell", "chunk").alias("cell"), "rep")
        pivots = rows.where("chunks > 1").select(F.xxhash64("cell", "chunk").alias("cell"), F.col("pivot").alias("rep"))
        found = linked(cells.union(pivots).distinct().join(texts, "rep"), size, percent)
        found = materialize((links if labels is None else links_of(labels)).union(found), "found")
        discard(*spent, labels)
        labels = components(found)
        discard(found)
    more, spent = rest_of_large(leaf, labels, texts, size, percent)
    if more is not None:
        found, old = materialize(links_of(labels).union(more), "found"), labels
        labels = components(found)
        discard(found, old)
    discard(*spent, leaf, texts, several)

    members = classes.join(labels, F.col("rep") == F.col("v"), "left").select(F.col("set_a").alias("x"), F.col("set_b").alias("y"), F.coalesce("component", "rep").alias("part"), F.col("doc_id").alias("d"))
    members = materialize(members, "classes")
    smallest = members.groupBy(F.col("part").alias("p")).agg(F.min("d").alias("component"))
    final = materialize(members.join(smallest, F.col("part") == F.col("p")).select("x", "y", "component"), "components")
    discard(labels, classes, members)
    has = F.col("n_shingles") > 0
    out = signed.drop("paths", "text_key").join(final, has & (F.col("set_a") == F.col("x")) & (F.col("set_b") == F.col("y")), "left")
    component = F.when(F.col("doc_id").isNotNull() & has, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select doc_id, md5(string_agg(g, '|' order by g)) as k from s group by doc_id),
r as (select c.doc_id, min(c.doc_id) over (partition by k, n) as rep, n from c join n using (doc_id)),
u as (select s.doc_id, g from s join r on s.doc_id = r.doc_id and r.doc_id = r.rep),
i as (select a.doc_id as a, b.doc_id as b, count(*) as m from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
f as (select rep as v, rep as root from r where doc_id = rep union select e.b, f.root from f join e on f.v = e.a where f.root < e.b),
o as (select v, min(root) as component from f group by v)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(o.component, w.doc_id) as component_id, coalesce(o.component, w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id left join o on o.v = r.rep
"""
