"""Similarity hashes of 64 bits and the texts whose hashes differ in a few bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.tables import written

BITS, DISTANCE, MOST = 64, 3, 1000


def word_hash(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 16), 16, -10).cast("bigint")


def simhashes(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """`keep` and simhash: each bit is the majority over the hashes of a text's distinct words, a tie is 0; null for a text without words.

    Words are rows of their own and 64 sums by text, partial in the task that holds it, so nothing but
    sums is shuffled. Rows that repeat are hashed each.
    """
    distinct = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), distinct.alias("_words"))
    rows = rows.select(*keep, "_row", F.explode_outer("_words").alias("_word")).withColumn("_h", word_hash(F.col("_word")))
    vote = lambda b: F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{b}")
    sums = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.count("_word").alias("_n"), *[vote(b) for b in range(BITS)])
    hash_ = F.lit(0).cast("bigint")
    for b in range(BITS):
        hash_ = hash_.bitwiseOR(F.when(F.col(f"_b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return sums.select(*keep, F.when(F.col("_n") > 0, hash_).alias("simhash"))


def cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of parts of nearly equal width."""
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def part(h: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else h


def without(h: Column, first: int, width: int) -> Column:
    """The bits of h but for a part, moved together."""
    above = F.shiftleft(F.shiftrightunsigned(h, first + width), first) if first + width < BITS else F.lit(0).cast("bigint")
    return above.bitwiseOR(h.bitwiseAND(F.lit((1 << first) - 1)))


def near_hashes(hashes: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(a, b, distance) for all pairs a < b of the distinct values of `simhash` that differ in at most `distance` bits.

    Of distance + 1 bands one must be equal, so hashes meet in an equi-join by band. A band that more
    than `most` hashes share is split: their other bits are cut into bands again, of which one must be
    equal as well. Every pair that meets is confirmed on all bits, so the result is exact at any size
    of bands.
    """
    h = F.col("simhash")
    every = written(hashes.select("simhash").where("simhash is not null").distinct(), "hashes")
    bands = cuts(BITS, distance + 1)
    keyed = every.select(h, F.explode(F.array(*[F.struct(F.lit(i).alias("band"), part(h, *c).alias("value")) for i, c in enumerate(bands)])).alias("k")).select("simhash", "k.band", "k.value")
    count = written(keyed.groupBy(F.col("band").alias("b"), F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    keyed = written(keyed.join(count, (F.col("band") == F.col("b")) & (F.col("value") == F.col("v"))).select("simhash", "band", "value", "n"), "banded")
    small = keyed.where(F.col("n") <= most).select("simhash", F.struct("band", "value", F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("own")).alias("key"))
    rest = F.coalesce(*[F.when(F.col("band") == i, without(h, *c)) for i, c in enumerate(bands)])
    subs = cuts(BITS - min(w for _, w in bands), distance + 1)
    finer = F.explode(F.array(*[F.struct("band", "value", F.lit(j).alias("sub"), part(rest, *c).alias("own")) for j, c in enumerate(subs)]))
    keys = written(small.unionByName(keyed.where(F.col("n") > most).select("simhash", finer.alias("key"))), "keys")
    pairs = keys.select(F.col("simhash").alias("a"), "key").join(keys.select(F.col("simhash").alias("b"), "key"), "key").where("a < b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")
    return pairs.withColumn("distance", apart).where(F.col("distance") <= distance).select("a", "b", "distance").distinct()


def near_texts(docs: DataFrame, key: str, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(key, simhash, n_near, first_near): how many other rows have a hash that differs in at most `distance` bits, and their least key.

    Rows with one hash are a class: classes are compared, and a row counts those of its own and of near
    classes, so copies are not expanded into pairs.
    """
    hashed = written(simhashes(docs, [key]), "simhashes")
    pairs = written(near_hashes(hashed, distance, most), "near")
    classes = written(hashed.where("simhash is not null").groupBy(F.col("simhash").alias("of")).agg(F.count(F.lit(1)).alias("many"), F.min(key).alias("least")), "classes")
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
    others = both.join(classes, F.col("b") == F.col("of")).groupBy("a").agg(F.sum("many").alias("more"), F.min("least").alias("near"))
    second = hashed.join(classes, F.col("simhash") == F.col("of")).where(F.col(key) > F.col("least")).groupBy(F.col("of").alias("s")).agg(F.min(key).alias("second"))
    rows = hashed.join(classes, F.col("simhash") == F.col("of"), "left").join(others, F.col("simhash") == F.col("a"), "left").join(second, F.col("simhash") == F.col("s"), "left")
    own = F.when(F.col(key) == F.col("least"), F.col("second")).otherwise(F.col("least"))
    n = F.when(F.col("simhash").isNotNull(), F.col("many") - 1 + F.coalesce("more", F.lit(0)))
    return rows.select(key, "simhash", F.coalesce(n, F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("simhash").isNotNull(), F.least(own, F.col("near"))).alias("first_near"))
