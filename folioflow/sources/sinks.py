"""Writers: folders by subject, level and topic; index pages; JSON lines; CSV metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_hierarchy(df: DataFrame, path: str, *levels: str) -> None:
    """Parquet folders by level; rows of a folder meet in a few files, and large folders are split."""
    df.hint("rebalance", *levels).write.mode("overwrite").partitionBy(*levels).parquet(path)


PAGE_ORDER = ("_part", "_turn", "academic_level", "title", "filename")


def subject_title(subject: str) -> Column:
    return F.concat(F.lit("# "), F.initcap(F.replace(F.col(subject), F.lit("_"), F.lit(" "))))


def index_rows(meta: DataFrame) -> DataFrame:
    """(subject_area, line, and the columns of PAGE_ORDER): the lines of a page for each subject, a row each: a heading, then documents by level and title."""
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("** ("), F.col("academic_level"), F.lit(") - `"), F.col("filename"), F.lit("`"))
    body = meta.select("subject_area", line.alias("line"), F.lit(1).alias("_part"), F.lit(0).alias("_turn"), "academic_level", "title", "filename")
    count = meta.groupBy("subject_area").agg(F.count(F.lit(1)).alias("n"))
    head = F.posexplode(F.array(subject_title("subject_area"), F.lit(""), F.concat(F.col("n").cast("string"), F.lit(" documents")), F.lit(""))).alias("_turn", "line")
    none = [F.lit(None).cast("string").alias(c) for c in ("academic_level", "title", "filename")]
    return count.select("subject_area", head, F.lit(0).alias("_part"), *none).unionByName(body)


def write_pages(rows: DataFrame, path: str, page: str, order: Sequence[str] = PAGE_ORDER, lines_a_file: int = 100_000) -> None:
    """Text files of the column `line` in a folder for each page, in order.

    Rows are dealt to ranges of page and order, so a large page is the work of several tasks and lies
    in several files of at most `lines_a_file` lines, numbered as they follow one another. No page is
    ever a row. Spark commits files of tasks that end and drops those of others, so a task that runs
    again leaves nothing twice.
    """
    dealt = rows.repartitionByRange(page, *order).sortWithinPartitions(page, *order)
    dealt.select(page, F.col("line").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", lines_a_file).partitionBy(page).text(path)


def read_pages(spark: SparkSession, path: str, page: str) -> DataFrame:
    """(page, place, line): the written lines, numbered from 0 in each page; a task holds a file."""
    files = spark.read.schema(f"value string, {page} string").option("wholetext", True).text(path)
    at = lambda p: F.regexp_extract("_metadata.file_name", p, 1).cast("bigint")
    files = files.select(page, at(r"^part-(\d+)").alias("_task"), at(r"\.c(\d+)").alias("_file"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("_lines"))
    before = F.sum(F.size("_lines")).over(Window.partitionBy(page).orderBy("_task", "_file").rowsBetween(Window.unboundedPreceding, -1))
    sized = files.select(page, "_task", "_file", "_lines", F.coalesce(before, F.lit(0)).alias("_before"))
    return sized.select(page, "_before", F.posexplode("_lines").alias("_at", "line")).select(page, (F.col("_before") + F.col("_at")).cast("bigint").alias("place"), "line")


def index_lines(meta: DataFrame) -> DataFrame:
    """(subject_area, page): the same pages for display, each in a row."""
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("** ("), F.col("academic_level"), F.lit(") - `"), F.col("filename"), F.lit("`"))
    rows = meta.groupBy("subject_area").agg(F.array_sort(F.collect_list(F.struct("academic_level", "title", "filename", line.alias("line")))).alias("rows"))
    head = F.concat(F.lit("# "), F.initcap(F.replace("subject_area", F.lit("_"), F.lit(" "))), F.lit("\n\n"), F.size("rows").cast("string"), F.lit(" documents\n\n"))
    return rows.select("subject_area", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("page"))


def group_lines(groups: DataFrame) -> DataFrame:
    """(group_type, page): a page for each type of group."""
    line = F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.array_join(F.transform("members", lambda m: F.concat(F.lit("- "), m)), "\n"))
    rows = groups.groupBy("group_type").agg(F.array_sort(F.collect_list(F.struct("title", line.alias("line")))).alias("rows"))
    return rows.select("group_type", F.concat(F.lit("# "), F.initcap("group_type"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n")).alias("page"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str, excerpt: Column) -> None:
    """Metadata rows with an excerpt of 500 characters."""
    df.withColumn("excerpt", F.substring(excerpt, 1, 500)).write.mode("append").csv(path, header=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
