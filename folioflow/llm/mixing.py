"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, materialize, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sizes: DataFrame, parts: int | None = None) -> DataFrame:
    """sizes with `place`, the 0-based position of each source by code point, null last.

    Sources are dealt to ranges of names and numbered within each; the sizes of the ranges, a
    row for each, give their offsets. So no task orders all sources, however many there are.
    """
    parts = parts or int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("source").isNull()
    dealt = sizes.repartitionByRange(parts, key, "source").sortWithinPartitions(key, "source").withColumn("id", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("range", F.shiftright("id", 33)), "mix-ranked")  # the number's upper bits are the task, the lower ones count up in it
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offset = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("offset"))  # at most `parts` rows
    return dealt.join(offset, "range").select("source", "source_size", (F.col("offset") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, parts: int | None = None) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row for each source.

    Sources take the weights in turn, by code point and null last. They share
    `share` of all words by weight; a target stops at `most` times its source
    and the excess goes to the others by weight, until none is above: each round
    is an aggregate of the sources, which gives what is left for those that are
    still open and the sum of their weights. The level left / weights only
    rises, so a source that is capped stays so. An empty source has the target 0.
    """
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = ranked(sizes, parts).withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = materialize(t.select("source", "source_size", "weight", "cap"), "mix-sources")
    total, all_weights = t.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(total or 0) * share
    left, open_weight, known = total, float(all_weights or 0), -1
    while True:
        capped = F.lit(left) * F.col("weight") >= F.col("cap") * F.lit(open_weight)
        n, cap, weight = t.where(capped).agg(F.count(F.lit(1)), F.sum("cap"), F.sum("weight")).first()
        if n == known or open_weight <= 0:
            break
        known, left, open_weight = n, total - float(cap or 0), float(all_weights or 0) - float(weight or 0)
    target = F.when(capped, F.col("cap")).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0))
    return t.select("source", "source_size", F.least(target, "cap").alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id (or what stands for it) and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def identity(doc_id: Column, text: Column) -> Column:
    """The id, or a digest of the text where it is null, so that such rows are drawn each for itself."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


ADDED = ("size", "source_size", "target", "copies")


def repetitions(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, sized: bool = False) -> DataFrame:
    """docs with size, source_size, target and copies, the times that the mix repeats each.

    The rate of a source is target / source_size; a document goes in floor(rate)
    times, and once more if its draw is below the fraction. Draws are
    independent, so a source's words come near its target as its documents grow
    in number: within 7 % for 500 documents, but a source of a single document
    gives it once or twice and may miss by almost half. Sizes are summed per
    source with a partial aggregate. The table of sources (a row each) joins
    back; Spark broadcasts it only if its measured size is below the threshold,
    else the join's hot sources are split at run time. Texts are not shuffled
    then. With `sized`, docs brings its own columns size and identity_, and no
    text is read. Null text has size 0, null sources are one source, a source of
    size 0 has rate 0; repeated rows with one id are drawn alike, rows with a
    null id by their text. An empty table gives no rows. Columns of docs named
    like the added ones are replaced.
    """
    if not sized:
        docs = docs.drop(*ADDED).withColumn("size", size_of(F.col("text"))).withColumn("identity_", identity(F.col("doc_id"), F.col("text")))
    sources = materialize(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    sources = sources.withColumnRenamed("source", "mixed_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col("identity_"), seed) < rate - F.floor(rate)).cast("bigint")
    out = docs.join(sources, F.col("source").eqNullSafe(F.col("mixed_source")), "left").drop("mixed_source")
    return out.withColumn("copies", copies.cast("bigint")).drop("identity_")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as repetitions() says, with copy = 1, 2, ..."""
    mixed = repetitions(docs, **options).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), identity(F.col("doc_id"), F.col("text")).alias("identity_"))
    mixed = repetitions(materialize(rows, "mix-sizes"), sized=True)  # texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
with d as (select doc_id, source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as identity, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight, (source_size * 2.0)::double as cap from s),
t as (select *, (sum(source_size) over () * 1.5)::double as total, sum(weight) over () as weights,
  coalesce(sum(cap) over b, 0.0) as cap_before, coalesce(sum(weight) over b, 0.0) as weight_before
  from w window b as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
o as (select *, total - cap_before as left_, weights - weight_before as shared_by from t),
l as (select min({'r': cap / weight, 'left_': left_, 'shared_by': shared_by}) filter (where left_ * weight < cap * shared_by) as level from o),
g as (select source, source_size, least(cap, case when level is not null and cap * level.shared_by > level.left_ * weight then level.left_ * weight / level.shared_by else cap end) as target from o, l),
x as (select d.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
  ('0x' || substr(md5('mix-1:' || identity), 1, 12))::bigint / 281474976710656.0 as drawn
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate) + (drawn < rate - floor(rate))::int))::bigint as taken from x
"""
