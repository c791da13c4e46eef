"""A training corpus in five stages: language, near duplicates, benchmark leaks, personal data, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, langid, mixing, near_dedup, pii
from folioflow.llm.common import scratch_path

#: A document is rejected if more than this share of its trigrams fits no language.
MOST_OTHER = 0.5


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source for an operator, and _row with all columns as they came, so that no name or type of theirs meets one of its own."""
    return docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents; those without a letter, or mostly in no language, go.

    Null and empty texts have no letter. Repeated rows are judged each, texts of any length whole. An
    empty table gives no rows; if no row has a label, nothing is learned and all are in no language.
    All columns stay as they are, of whatever name and type.
    """
    found = langid.predict(packed(docs), langid.fit(docs), keep=["_row"])
    other = F.aggregate(F.zip_with("languages", "proportions", lambda lang, share: F.when(lang == langid.OTHER, share).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    return found.where((F.col("lang_pred") != "und") & (other <= MOST_OTHER)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id.

    Null, empty and wordless texts are in no group and stay. Rows with one doc_id are one document:
    it stays or goes with all its texts, but of rows that repeat both id and text one stays, that
    whose columns have the least digest as JSON. Rows without an id stay as they are. An empty table
    gives no rows. All columns stay as they are, of whatever name and type.
    """
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    rows = packed(docs)
    known = rows.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    one = known.groupBy("doc_id", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")).agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return one.select("_row.*").unionByName(rows.where("doc_id is null").select("_row.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold nothing and stay; repeated rows stay or go together. Texts are searched
    whole. An empty table gives no rows, and an empty benchmark takes none. All columns stay as they
    are, of whatever name and type.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(packed(docs).select("text", "_row"), items).where(F.size("found") == 0).select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with placeholders for personal data; n_chars follows.

    Null texts stay null, rows without a finding as they are, repeated rows alike. Texts are searched
    whole. An empty table gives no rows. All columns but these two stay as they are, of whatever name
    and type.
    """
    found = pii.find_pii(packed(docs), pii.fit(docs.select("doc_id", "text")), keep=["_row"])
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.char_length("redacted").cast("bigint")).otherwise(F.col("_row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, with size, source_size, target, copies and copy.

    Null and empty texts have size 0 and are drawn like others of their source; rows of one id are
    drawn alike, rows without one by their text. An empty table gives no rows. All columns stay as
    they are, of whatever name and type; a column of the mix whose name is taken gets mix_ before it.
    """
    mixed = mixing.emit(packed(docs))
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"mix_{name}")

    return mixed.select("_row.*", *[F.col(c).alias(free(c)) for c in (*mixing.ADDED, "copy")])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("personal_data", personal_data), ("mix", mix)]

#: The stages learn from the rows that they get, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
