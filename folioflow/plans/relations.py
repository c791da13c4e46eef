"""Queries of joins and small relations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import grouping as gr
from folioflow.operators import relations as rl
from folioflow.plans import fixtures as fx

FILES = [("doc00.pdf", "text zero"), ("doc03.pdf", "text three"), ("gone.pdf", "x")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.with_texts(fx.meta(spark, sf_dir).select("filename", "title"), spark.createDataFrame(FILES, "filename string, text string"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    return rl.group_documents(gr.author_groups(m), m.select("filename", "title")).select("name", "filename", "title")


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their source: orders with customers, counted by nation."""
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("source_config_id"))
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return rl.task_sources(t, s).groupBy("nation").agg(F.count(F.lit(1)).alias("n_tasks"), F.count("source_id").alias("n_known"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    added = rl.add_member(F.col("keywords"), F.lit("limit"))
    return m.select("filename", F.array_join(added, "|").alias("added"), F.array_join(rl.remove_member(added, F.lit("calculus")), "|").alias("removed"), F.size(added).cast("bigint").alias("n"))


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest checkpoints of each key: orders of a customer."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return rl.newest(o, "o_custkey", "at", 3).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


def recovery_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rl.recovery_statistics(read(spark, sf_dir, "events"), "event_type", "ts")
    return out.select("event_type", "n", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest"))


def crawl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("url")
    out = rl.crawl_statistics(p, F.col("url").endswith(".html"), F.contains("url", F.lit("?")))
    return out.withColumn("discovery_rate", F.round("discovery_rate", 6))


def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs over two repositories' lists: pages by parity, with and without query."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return rl.distinct_urls(p.where("page_id % 2 = 0").select(F.array(F.col("url"), bare).alias("urls")), p.where("page_id % 2 = 1").select(F.array(bare, F.lit("")).alias("urls")))


def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rl.report(read(spark, sf_dir, "orders"), F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return out.withColumn("success_rate", F.round("success_rate", 6))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.in_page_order(fx.meta(spark, sf_dir), "subject_area", "academic_level").select("filename", F.col("place").cast("bigint").alias("place"))


QUERIES = {f.__name__: f for f in (text_join, group_members, order_customers, membership, newest_orders, recovery_statistics, crawl_statistics, distinct_urls, processing_report, page_order)}
SQL = {
    "text_join": f"with {fx.meta_sql()}, {fx.values_sql('f', FILES, 'filename string, text string')} select meta.filename, title, coalesce(text, '') as text from meta left join f on f.filename = meta.filename",
    "group_members": f"with {fx.meta_sql()}, a as (select authors[1] as k from meta where len(authors) > 0 group by 1 having count(*) > 1) select 'author_' || k as name, filename, title from meta join a on authors[1] = k",
    "order_customers": "select c_nationkey as nation, count(*) as n_tasks, count(c_custkey) as n_known from orders left join customer on c_custkey = o_custkey group by 1",
    "membership": f"with {fx.meta_sql()}, a as (select filename, case when list_contains(keywords, 'limit') then keywords else list_append(keywords, 'limit') end as k from meta) select filename, array_to_string(k, '|') as added, array_to_string(list_filter(k, lambda x: x <> 'calculus'), '|') as removed, len(k)::bigint as n from a",
    "newest_orders": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders qualify rank <= 3",
    "recovery_statistics": "select event_type, count(*) as n, epoch_us(max(ts)) as latest from events group by event_type",
    "crawl_statistics": "with c as (select count(*) filter (where not ends_with(url, '.html') and not contains(url, '?')) as visited, count(*) filter (where ends_with(url, '.html')) as files, count(*) filter (where contains(url, '?')) as queue from pages) select *, round(files / greatest(visited, 1), 6) as discovery_rate from c",
    "distinct_urls": "select distinct u as url from (select url as u from pages where page_id % 2 = 0 union all select regexp_replace(url, '[?#].*$', '') from pages) x",
    "processing_report": "with c as (select count(*) filter (where o_orderstatus <> 'P') as discovered, count(*) filter (where o_orderstatus = 'F') as processed from orders) select *, round(processed * 100 / greatest(discovered, 1), 6) as success_rate from c",
    "page_order": f"with {fx.meta_sql()} select filename, row_number() over (partition by subject_area, academic_level order by title, filename) as place from meta",
}
