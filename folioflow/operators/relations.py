"""Joins and small relations: texts by name, tasks by source, memberships, checkpoints, crawl and recovery counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_texts(meta: DataFrame, texts: DataFrame, key: str = "filename") -> DataFrame:
    """Documents with their text, empty where none is known."""
    return meta.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_known_texts(meta: DataFrame, texts: DataFrame, key: str = "filename") -> DataFrame:
    """Documents that have a text, with it."""
    return meta.join(texts.select(key, "text"), key)


def group_documents(groups: DataFrame, meta: DataFrame, key: str = "filename") -> DataFrame:
    """(group, document) rows of groups (name, members)."""
    return groups.select("name", F.explode("members").alias(key)).join(meta, key)


def task_sources(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    return tasks.join(sources.withColumnRenamed("id", "source_id"), F.col("source_config_id") == F.col("source_id"), "left")


def add_member(members: Column, name: Column) -> Column:
    return F.array_union(members, F.array(name))


def remove_member(members: Column, name: Column) -> Column:
    return F.array_remove(members, name)


def newest(rows: DataFrame, key: str, at: str, keep: int) -> DataFrame:
    """The `keep` latest rows of each key, newest first, with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def recovery_statistics(rows: DataFrame, operation: str, at: str) -> DataFrame:
    return rows.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("latest"))


def crawl_statistics(pages: DataFrame, is_file: Column, queued: Column) -> DataFrame:
    """One row: visited pages, files, queue length, and files for each page visited."""
    out = pages.agg(F.count_if(~is_file & ~queued).alias("visited"), F.count_if(is_file).alias("files"), F.count_if(queued).alias("queue"))
    return out.withColumn("discovery_rate", F.col("files") / F.greatest(F.col("visited"), F.lit(1)))


def distinct_urls(*lists: DataFrame) -> DataFrame:
    """Distinct non-empty values of each table's `urls` arrays."""
    out = None
    for x in lists:
        rows = x.select(F.explode("urls").alias("url"))
        out = rows if out is None else out.union(rows)
    return out.where("url <> ''").distinct()


def report(rows: DataFrame, discovered: Column, processed: Column) -> DataFrame:
    """One row: discovered, processed, and the rate in percent of one at least."""
    out = rows.agg(F.count_if(discovered).alias("discovered"), F.count_if(processed).alias("processed"))
    return out.withColumn("success_rate", F.col("processed") * 100 / F.greatest(F.col("discovered"), F.lit(1)))


def in_page_order(meta: DataFrame, *keys: str) -> DataFrame:
    """Rank of each title within its page."""
    return meta.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("title", "filename")))
