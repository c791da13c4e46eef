"""Importance resampling towards a target: features of word runs, gains of hashed buckets, a seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, materialize, table

#: A word once A-Z are lower-cased: a run of anything but ASCII that is neither digit nor small letter.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW, HIGH, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 1, 10_000, "2024", 20, 10
#: A table of gains of so many rows at most is broadcast.
MOST_BROADCAST = 1_000_000


def feature_words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.regexp_extract_all(F.translate(text, upper, lower), F.lit(FEATURE_WORD), F.lit(0)), F.array().cast("array<string>"))


def position_table(docs: DataFrame, keep: tuple[str, ...] = (), low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep` of docs with _row, _words and _bucket, a row for each feature of a text.

    Words are exploded with their places. For runs of more than one word, lead() over a text's places
    brings each word those that follow it, and each order from `low` to `high` joins that many by one
    space; single words are followed by nothing, so `high` = 1 needs no window and no shuffle. A
    text's rows meet in one task for the window, which is what its single row did before. _row tells
    rows of docs apart, also those that repeat an id, and _words is the text's number of words. A
    text without a feature has one row with no bucket.
    """
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), feature_words(F.col("text")).alias("_all"))
    rows = rows.select(*keep, "_row", F.size("_all").cast("long").alias("_words"), F.posexplode_outer("_all").alias("_place", "_word"))
    if high > 1:
        order = Window.partitionBy("_row").orderBy("_place")
        rows = rows.withColumns({f"_next{k}": F.lead("_word", k).over(order) for k in range(1, high)})
    runs = [F.concat_ws(" ", "_word", *[f"_next{k}" for k in range(1, n)]) if n > 1 else F.col("_word") for n in range(low, high + 1)]
    whole = [F.when(F.col("_place") + n <= F.col("_words"), run) for n, run in zip(range(low, high + 1), runs, strict=True)]
    if len(whole) == 1:
        feature = whole[0]
        if low > 1:  # keep the first place of a text that is shorter than a run
            rows = rows.where((F.col("_place") + low <= F.col("_words")) | (F.coalesce("_place", F.lit(0)) == 0))
    else:
        rows = rows.select(*keep, "_row", "_words", F.explode_outer(F.array_compact(F.array(*whole))).alias("_feature"))
        feature = F.col("_feature")
    return rows.select(*keep, "_row", "_words", (F.crc32(feature.cast("binary")) % buckets).cast("int").alias("_bucket"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets of two position tables: floor(1000 ln) of the smoothed ratio of their shares."""
    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("_bucket is not null").groupBy("_bucket").agg(F.count(F.lit(1)).alias(name))

    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    both = every.join(counts(source, "s"), "_bucket", "left").join(counts(target, "t"), "_bucket", "left").fillna(0, ["s", "t"])
    both = materialize(both, "buckets")  # a row for each bucket
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(all_s) + buckets) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_t) + buckets))
    return both.select(F.col("_bucket").alias("bucket"), F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel-distributed number in thousandths that only the seed and the id decide; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; those with a rank are drawn.

    Both tables' texts give position tables. That of docs is written, as it is read once for the
    buckets' counts, partial in each task, and once to join the gains; the gains, a row a bucket, are
    broadcast up to a million buckets. Sums by text are partial in the task that holds its rows. Of
    the texts with `least_words` words the `percent` with the highest scores are drawn, ties to the
    smaller id: ranges of the order are numbered each for itself and offset by the sizes of those
    before, so no task holds all texts. Null and empty texts have no feature and the weight 0; texts
    are taken whole; a null id comes after all others; rows that repeat an id are drawn each for
    itself, with the same noise, and among equal scores the one with fewer features first. An empty
    table gives no rows, an empty target flat counts. Other columns are not read.
    """
    of_docs = materialize(position_table(docs, ("doc_id",), low, high, buckets), "positions")
    gain = gains(of_docs, position_table(target, (), low, high, buckets), buckets)
    gain = F.broadcast(gain) if buckets <= MOST_BROADCAST else gain
    by_text = of_docs.join(gain, F.col("_bucket") == F.col("bucket"), "left").groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_words").alias("_words"), F.count("_bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")
    )
    scored = materialize(by_text.drop("_row").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    discard(of_docs)
    able = scored.where(F.col("_words") >= least_words)
    most = able.count() * percent // 100
    ranked = ordered(able, "rank", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def ordered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with `name`, the place of each from 1 in an order: ranges are numbered each for itself, and a row for each range gives its offset."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_range", F.shiftright("_at", 33)), "ordered")  # the upper bits are the task, the lower ones count up in it
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))  # at most `parts` rows
    return dealt.join(F.broadcast(offset), "_range").withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_at", "_offset")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn towards the texts of the benchmark, by single words."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: crc32 by bytes: a table of 256 remainders made by the rule of its polynomial, and a fold of a word's bytes.
OP11_SQL = r"""
with recursive bits(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
remainders as (select list(c order by i) as m from bits where k = 8),
texts as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
source as (select r, unnest(ws) as w from texts),
target as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
vocabulary as (select w, hex(w) as h from (select w from source union select w from target)),
bytes as (select w, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as b from vocabulary),
bucketed as (select w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, m[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, remainders),
s as (select bucket, count(*) as s from source join bucketed using (w) group by bucket),
t as (select bucket, count(*) as t from target join bucketed using (w) group by bucket),
gains as (select bucket, floor(1000.0::double * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from source) + 10000.0::double) / ((s + 1.0::double) * ((select count(*) from target) + 10000.0::double))))::bigint as gain from s left join t using (bucket)),
weights as (select r, sum(gain)::bigint as weight from source join bucketed using (w) join gains using (bucket) group by r),
scored as (select r, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from texts left join weights using (r)),
noisy as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from scored),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank, count(*) over () * 10 // 100 as most from noisy where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= most then rank end as rank from noisy left join ranked using (r)
"""
