"""A collection organised by increments: what a micro-batch adds is written once, and a result is the sum of what all have added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import grouping as gr

#: What a batch adds to each table: counts of folders and of members, and the rows that groups and series are made of.
TABLES = {
    "folders": "subject_area string, academic_level string, n bigint, ordinal bigint",
    "authors": "author string, ordinal bigint, filename string",
    "institutions": "institution string, ordinal bigint, filename string",
    "parts": "series string, part bigint, filename string, ordinal bigint, pattern int",
}


def added(meta: DataFrame) -> dict[str, DataFrame]:
    """What these documents add to each table: as many rows as they have memberships, whatever is there already."""
    member = lambda rows, key: rows.select(key, F.col("ordinal").cast("bigint").alias("ordinal"), "filename")
    return {
        "folders": meta.groupBy("subject_area", "academic_level").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").cast("bigint").alias("ordinal")),
        "authors": member(meta.where(F.size("authors") > 0).withColumn("author", F.get("authors", F.lit(0))), "author"),
        "institutions": member(meta.where("institution <> ''"), "institution"),
        "parts": gr.series_parts(meta).select("series", "part", "filename", F.col("ordinal").cast("bigint").alias("ordinal"), "pattern"),
    }


def add_batch(path: str, meta_of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """Work on a micro-batch: each table gets a folder of the batch's number, which a batch that runs again replaces. Nothing of earlier batches is read or written."""

    def work(rows: DataFrame, batch: int) -> None:
        meta = meta_of(rows).persist()  # four tables of one batch
        try:
            for name, part in added(meta).items():
                part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        finally:
            meta.unpersist()

    return work


def of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of increments with `batch`, the one that added a row."""
    schema = T.StructType.fromDDL(TABLES[name])
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(f"{path}/{name}")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """(subject_area, academic_level, n, batch): documents of each folder and the batch that last touched it."""
    return of(spark, path, "folders").groupBy("subject_area", "academic_level").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, first, n, batch): authors and institutions of two documents or more, with their members counted."""
    def counted(name: str, key: str, prefix: str, kind: int) -> DataFrame:
        rows = of(spark, path, name).groupBy(key).agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"), F.max("batch").alias("batch")).where("n > 1")
        return rows.select(F.concat(F.lit(prefix), F.col(key)).alias("name"), F.lit(kind).alias("kind"), "first", "n", "batch")

    return counted("authors", "author", "author_", 0).unionByName(counted("institutions", "institution", "institution_", 2))


def members(spark: SparkSession, path: str) -> DataFrame:
    """The members of these groups, as author_members() and institution_members() give them."""
    return gr.named(of(spark, path, "authors"), "author_", "author", 0).unionByName(gr.named(of(spark, path, "institutions"), "institution_", "institution", 2))


def series(spark: SparkSession, path: str) -> DataFrame:
    return gr.series_of(of(spark, path, "parts").drop("batch"))


def compacted(spark: SparkSession, path: str, target: str, upto: int) -> None:
    """The increments of batches up to a number as one, with later ones beside, below another folder. Folders' counts are summed, rows of groups and series kept."""
    for name in TABLES:
        rows = of(spark, path, name)
        old = rows.where(F.col("batch") <= upto).drop("batch")
        if name == "folders":
            old = old.groupBy("subject_area", "academic_level").agg(F.sum("n").alias("n"), F.max("ordinal").alias("ordinal"))
        old.write.mode("overwrite").parquet(f"{target}/{name}/batch={upto}")
        rows.where(F.col("batch") > upto).write.mode("append").partitionBy("batch").parquet(f"{target}/{name}")
