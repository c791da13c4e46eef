"""Learned detectors on texts they have not learned from."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import detect as dt
from folioflow.plans import learned

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0 and lang is not null and length(trim(text)) >= 50")
    found = learned.learned_languages(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("language")).cast("int")).alias("right")).collect():
        assert r["n"] >= 15
        assert r["right"] >= 0.97


def test_charsets_of_held_out_bytes(spark):
    """What the detected charset makes of the bytes is the text that was written."""
    files = learned.in_charsets(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id div 5 % 2 = 0"))
    content = {r["doc_id"]: r for r in files.collect()}
    right: dict = {}
    for r in learned.learned_charsets(spark, SF).where("doc_id div 5 % 2 = 0").collect():
        own = content[r["doc_id"]]
        right.setdefault(own["charset"], []).append(bytes(own["content"]).decode(r["charset"], "replace") == own["written"])
    assert right.keys() == set(learned.CHARSETS)
    for name, hits in right.items():
        assert sum(hits) / len(hits) >= 0.93, name


def test_odd_texts_and_headers(spark):
    rows = spark.createDataFrame([(1, "the house and the sea " * 5, "en"), (2, "das haus und die see " * 5, "de"), (3, None, "en"), (4, "x", None)], "k int, text string, lang string")
    model = dt.learn(rows, "lang", dt.letter_grams(F.col("text")))
    more = rows.unionByName(spark.createDataFrame([(5, "", None), (6, "1234 " * 20, None), (2, "das haus und die see " * 5, None), (None, "and the house is in the sea and the sea is near", "en")], rows.schema))
    got = sorted((r["k"] or 0, r["language"], r["confidence"] > 0.9) for r in dt.languages(more, model, ["k"], least=40).collect())
    assert got == [(0, "en", True), (1, "en", True), (2, "de", True), (2, "de", True), (3, "en", False), (4, "en", False), (5, "en", False), (6, "en", False)]
    files = spark.createDataFrame([(1, bytearray("é".encode("latin-1")), "ISO-8859-1"), (2, bytearray(b"abc"), None), (3, None, None)], "k int, content binary, said string")
    none = dt.learn(rows.limit(0), "lang", dt.letter_grams(F.col("text")))
    assert [(r["k"], r["charset"]) for r in dt.charsets(files, none, ["k"], header="said").orderBy("k").collect()] == [(1, "ISO-8859-1"), (2, "UTF-8"), (3, "UTF-8")]
    with pytest.raises(ValueError):
        dt.learn(spark.range(20).select(F.col("id").cast("string").alias("lang"), F.lit("abc").alias("text")), "lang", dt.letter_grams(F.col("text")), most_labels=10)
