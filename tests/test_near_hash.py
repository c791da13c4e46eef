"""Near lookup by similarity hashes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import near_hash as nh


def hashes_of(seed):
    """Random hashes, ones that share bands, and neighbours of both at up to five bits."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(60)] + [(r.getrandbits(16) << 48) | 0x1234_5678_9ABC for _ in range(60)] + [(0xABCD << 16) | r.getrandbits(16) for _ in range(40)]
    for h in list(out):
        for b in r.sample(range(64), r.randrange(6)):
            h ^= 1 << b
        out.append(h)
    return sorted({h - (1 << 64) if h >= 1 << 63 else h for h in out})


@pytest.mark.parametrize("most", [2, 20, 10_000])
@pytest.mark.parametrize("distance", [0, 1, 3])
def test_pairs_equal_brute_force(spark, distance, most):
    hs = hashes_of(distance)
    got = nh.near_hashes(spark.createDataFrame([(h,) for h in [*hs, *hs[:5], None]], "simhash long"), distance, most).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert sorted(map(tuple, got)) == sorted((a, b, apart(a, b)) for i, a in enumerate(hs) for b in hs[i + 1 :] if apart(a, b) <= distance)


def test_odd_texts(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank at noon"
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, None), (4, " -- "), (5, ""), (6, text + " "), (7, "something else entirely here")], "k long, text string")
    got = {r["k"]: (r["n_near"], r["first_near"]) for r in nh.near_texts(docs, "k").collect()}
    assert got == {1: (2, 2), 2: (2, 1), 6: (2, 1), 3: (0, None), 4: (0, None), 5: (0, None), 7: (0, None)}
    assert nh.simhashes(docs, ["k"]).where(F.col("simhash").isNull()).count() == 3
    assert nh.near_texts(docs.limit(0), "k").count() == 0
