"""Tables of documents, sources and tasks: search, update, delete, status changes, duplicates, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx


def search_documents(meta: DataFrame, min_quality: float = 0.0, limit: int = 100, **equal: str) -> DataFrame:
    """Documents of a quality and with equal fields, best first; a top-k, not a sort of the table."""
    rows = meta.where(F.col("quality_score") >= min_quality)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("quality_score"), "ordinal").limit(limit)


def similar_by_hash(meta: DataFrame, similarity_hash: str, min_quality: float = 0.8) -> DataFrame:
    """Documents with an equal hash; the threshold is on their quality."""
    return meta.where((F.col("similarity_hash") == similarity_hash) & (F.col("quality_score") >= min_quality))


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").orderBy(F.desc("priority"), "name")


def sources_for(sources: DataFrame, subject: str) -> DataFrame:
    return sources.where(F.col("is_active") & F.array_contains("subject_areas", subject))


def pending_tasks(tasks: DataFrame, limit: int = 100) -> DataFrame:
    return tasks.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def update_rows(base: DataFrame, changes: DataFrame, key: str, touched: tuple[str, Column] | None = None) -> DataFrame:
    """base with the values of changes where a key has some; `touched` sets a column, such as a time, on changed rows."""
    other = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), F.struct(*other).alias("_new"))
    both = base.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    value = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in other}
    if touched:
        value[touched[0]] = F.when(hit, touched[1]).otherwise(F.col(touched[0]))
    return both.select(*[value[c].alias(c) if c in value else F.col(c) for c in base.columns])


def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti").select(base.columns)


def insert_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with those rows whose key it doesn't hold yet."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti").select(rows.columns), allowMissingColumns=True)


def change_status(tasks: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Tasks with new (task_id, status, error_message); start and end times are set by the status that a task had before."""
    new = changes.select(F.col("task_id").alias("_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    hit, was = F.col("_id").isNotNull(), F.col("status")
    out = tasks.join(new, F.col("task_id") == F.col("_id"), "left").withColumns({
        "started_at": F.when(hit & (was == "processing"), now).otherwise(F.col("started_at")), "completed_at": F.when(hit & was.isin("completed", "failed"), now).otherwise(F.col("completed_at")),
        "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")), "new_status": F.when(hit, F.col("_status")).otherwise(was),
    })
    return out.withColumn("status", F.col("new_status")).select(tasks.columns)


def task_tests(now: Column) -> dict[str, Column]:
    return {"expired": F.col("created_at") < now - F.expr("interval 24 hours"), "can_retry": (F.col("retry_count") < F.col("max_retries")) & (F.col("status") == "failed")}


def duplicate_groups(docs: DataFrame, key: Column, id_column: str = "doc_id") -> DataFrame:
    """(content_hash, n, first_id): keys of two rows or more."""
    rows = docs.select(F.col(id_column).alias("id"), key.alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def keep_first(docs: DataFrame, key: Column, id_column: str = "doc_id") -> DataFrame:
    """Ids of the first document of each key: minima are summed before the shuffle, and texts stay where they are."""
    return docs.select(F.col(id_column).alias("id"), key.alias("k")).groupBy("k").agg(F.min("id").alias(id_column)).select(id_column)


def broken_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Values of a key that more than one row has: empty where the key is unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parts(rows: DataFrame, orphan_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has: empty where a foreign key holds."""
    return rows.where(F.col(orphan_key).isNotNull()).join(parents.select(F.col(parent_key).alias(orphan_key)), orphan_key, "left_anti")


def read_back(rows: DataFrame, defaults: dict[str, tuple]) -> DataFrame:
    """Null and empty (or zero) values as their defaults: {column: (nothing, default)}."""
    return rows.withColumns({c: tx.falsy(F.col(c), nothing, default) for c, (nothing, default) in defaults.items()})


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def capped_per_key(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def downloadable(size: Column, least: Column, most: Column, head: Column, content_type: Column) -> Column:
    """Within the source's sizes, 1024 bytes at least, and a PDF by its first bytes or its type."""
    is_pdf = (F.substring(head, 1, 4) == F.lit("%PDF")) | F.contains(F.lower(content_type), F.lit("pdf"))
    return size.between(least, most) & (size >= 1024) & is_pdf


def collection_statistics(meta: DataFrame, *columns: str) -> DataFrame:
    """One row: documents, bytes, mean quality, and a map of counts for each column; each map is as large as its column's values are many."""
    out = meta.agg(F.count(F.lit(1)).alias("documents"), F.sum("file_size").alias("bytes"), F.avg("quality_score").alias("mean_quality"))
    for c in columns:
        counts = meta.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}")))
    return out
