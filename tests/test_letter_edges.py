"""Inclusion and its counts over texts with letters and blanks that engines take apart, against their SQL."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import scoring as sc
from folioflow.plans import fixtures as fx
from folioflow.plans import scoring

FAR = "\U00010400"
#: Letters of two UTF-16 units in words, so that the share of such words moves ease and grade over the levels' edges.
SYLLABLES = [("a" + FAR + "b ") * n + "banana rotunda. " * k for n in range(1, 60, 4) for k in (2, 9)]
BLANKS = [" ", "　  ", " ", "", None]
DOTTED = ["İntroductİon to research", "assİgnment syllabus quiz bİbliography", "unİversİty lectureİ", "LECTURE THESİS DİSSERTATİON"]


def tables_with(texts, sf, at):
    """The small tables, with each text in documents that meet every template."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", f"{at}/{t}.parquet")
    n = 60 * len(texts)
    columns = {"doc_id": range(n), "text": [texts[i // 15 % len(texts)] for i in range(n)], "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [1000 + i for i in range(n)]}
    pq.write_table(pa.table({k: pa.array(list(v), pa.string() if k in ("text", "lang", "source") else pa.int64()) for k, v in columns.items()}), f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def far(spark, sf, tmp_path_factory):
    return tables_with(SYLLABLES + BLANKS, sf, str(tmp_path_factory.mktemp("far")))


def test_syllables_behind_letters_of_two_units(spark):
    got = spark.createDataFrame([(FAR + "b",), ("a" + FAR + "b b",), ("b" + FAR,)], "t string").select(tx.syllable_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 2, 1]


def test_blank_texts_have_no_confidence(spark, sf, tmp_path):
    """Template 12 has no text of its own."""
    at = tables_with(BLANKS, sf, str(tmp_path))
    got = sc.classify_level(fx.meta(spark, at)).where(F.col("ordinal") % 15 == 12).select("level_confidence").distinct().collect()
    assert [r[0] for r in got] == [0.0]


def test_inclusion(spark, far):
    same(scoring.QUERIES["inclusion"], scoring.SQL["inclusion"], spark, far)


def test_filter_counts(spark, sf, tmp_path):
    same(scoring.QUERIES["filter_counts"], scoring.SQL["filter_counts"], spark, tables_with(DOTTED, sf, str(tmp_path)))
