"""Scores by patterns over texts in which engines differ about edges of words, cases and blanks, against their SQL."""

import os

import duckdb
import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import scoring as sc
from folioflow.plans import scoring

TEXTS = [
    "onñ ciónja 101.21", "éch 146.47", "ab 123é", "ab 123́", "xK 512", "ſa 512", "maſter béma. bs", "ab\x0b123", "ab 123", "ñasar 221 ñphd", "grade\x0b9 high school", "Courſe 3. Lecture 4é",
    "éundergrad égrad édoctoral ébachelor", "ñab 512 ñab 612 ñab 712", "ıb 512 İb 512", None, "",
]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The small tables, with texts of this file in documents that meet every template."""
    at = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", f"{at}/{t}.parquet")
    rows = [(i, TEXTS[i // 15 % len(TEXTS)], "en", "s", 1000 + i) for i in range(60 * len(TEXTS))]
    text = ", ".join("(" + ", ".join("null" if v is None else repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    duckdb.sql(f"copy (select * from (values {text}) v(doc_id, text, lang, source, n_chars)) to '{at}/documents.parquet' (format parquet)")
    return at


def test_case_blind_patterns_match_as_in_sql(spark):
    patterns = [p for v in sc.d.LEVEL_TERMS.values() for p in v["patterns"]] + sc.d.COURSE_PATTERNS
    texts = [(i, t) for i, t in enumerate(TEXTS) if t]
    got = spark.createDataFrame(texts, "i int, t string").select("i", *[tx.case_blind(tx.ascii_text(F.col("t")), p, lambda t, x: F.regexp_count(t, F.lit(x))).alias(f"n{k}") for k, p in enumerate(patterns)]).collect()
    for r in got:
        assert [*r][1:] == [duckdb.execute("select len(regexp_extract_all(?, ?))", [TEXTS[r["i"]], "(?i)" + p]).fetchall()[0][0] for p in patterns]


def test_relevance_scores(spark, odd):
    same(scoring.QUERIES["relevance_scores"], scoring.SQL["relevance_scores"], spark, odd)


def test_level_scores(spark, odd):
    same(scoring.QUERIES["level_scores"], scoring.SQL["level_scores"], spark, odd)


def test_halves_round_as_in_sql(spark):
    values = [(2 * k + 1) / 2e6 * s for k in range(300_000, 301_000) for s in (1, -1)] + [0.0, 1e300, 5.7145625, 6.6364375]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(tx.rounded(F.col("v")).alias("x")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchall()[0][0] for v in values]


def test_inclusion(spark, odd):
    same(scoring.QUERIES["inclusion"], scoring.SQL["inclusion"], spark, odd)


def test_filter_counts(spark, odd):
    same(scoring.QUERIES["filter_counts"], scoring.SQL["filter_counts"], spark, odd)
