"""Queries of tables, duplicates, tasks, readers and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions.tables import scratch_path
from folioflow.operators import catalog as ca
from folioflow.operators import crawl as cr
from folioflow.plans import fixtures as fx
from folioflow.sources import readers as rd
from folioflow.sources import sinks as sk

TASKS = [
    ("t1", "pending", 5, "2024-01-01 00:00:00", 0, 3, None, None, ""), ("t2", "pending", 9, "2024-01-02 00:00:00", 0, 3, None, None, ""), ("t3", "processing", 9, "2024-01-01 00:00:00", 1, 3, None, None, ""),
    ("t4", "failed", 1, "2024-01-03 00:00:00", 2, 3, "2024-01-03 01:00:00", None, "x"), ("t5", "failed", 1, "2024-01-03 12:00:00", 3, 3, None, None, "y"), ("t6", "completed", 2, "2024-01-04 00:00:00", 0, 3, None, None, ""),
]
TASK_SCHEMA = "task_id string, status string, priority int, created string, retry_count int, max_retries int, started string, completed string, error_message string"
CHANGES = [("t", "processing", ""), (None, None, None), ("t", "completed", ""), (None, None, None), (None, None, None), ("t", "archived", "moved")]
SOURCES = [("Open Courses", True, 3, ["physics", "mathematics"], 1, 30), ("Preprints", True, 7, ["computer_science"], 0, 0), ("Old Archive", False, 9, ["physics"], 5, 60), ("Library", True, 3, ["general"], 0, 45)]
SOURCE_SCHEMA = "name string, is_active boolean, priority int, subject_areas array<string>, retry_attempts int, timeout int"
HEALTH = [("Open Courses", "healthy"), ("Preprints", "unhealthy"), ("Gone", "healthy"), ("Library", "healthy")]
FILES = [(1, 500, "%PDF-1.4", "application/pdf"), (2, 5000, "%PDF-1.7", "text/html"), (3, 5000, "<html>", "text/html"), (4, 5000, "xxxx", "application/pdf; x"), (5, 900_000, "%PDF", "application/pdf")]
ATOM = [("""<feed><entry><id>http://arxiv.org/abs/2401.00001v1</id><published>2024-01-05T00:00:00Z</published><title> Deep Nets </title><summary>On nets.</summary><author><name>A. One</name></author><author><name>B. Two</name></author><category term="cs.LG"/><category term="stat.ML"/><link href="http://arxiv.org/pdf/2401.00001v1" type="application/pdf"/></entry>
<entry><id>http://arxiv.org/abs/2301.1</id><published>2023-01-05T00:00:00Z</published><title>Strings</title><summary>Theory.</summary><author><name>C. Three</name></author><category term="hep-th"/></entry></feed>""",)]
DSPACE = [('{"items": [{"metadata": {"dc.title": [{"value": "Thesis A"}], "dc.creator": [{"value": "X"}, {"value": "Y"}], "dc.subject": [{"value": "s1"}]}, "bitstreams": [{"uuid": "u1", "name": "a.txt", "mimeType": "text/plain"}, {"uuid": "u2", "name": "a.pdf", "mimeType": "application/pdf"}]}, {"metadata": {"dc.creator": [{"value": "Z"}]}, "bitstreams": []}]}',)]
EPRINTS = [('{"items": [{"title": "Paper E", "creators": [{"name": "N1"}], "abstract": "abs", "keywords": "k1,k2", "documents": [{"mime_type": "application/pdf", "uri": "https://e.org/1.pdf"}]}, {"title": "", "creators": []}]}',)]
#: A root index, an index that it names, their url sets, and one that nothing names; @ is the site.
SITEMAPS = [
    ("root@", "<sitemapindex><sitemap><loc>mid@</loc></sitemap><sitemap><loc>part2@</loc></sitemap></sitemapindex>"), ("mid@", "<sitemapindex><sitemap><loc> part1@ </loc></sitemap><sitemap><loc>root@</loc></sitemap></sitemapindex>"),
    ("part1@", "<urlset><url><loc>https://x@.edu/a.pdf</loc></url><url><loc>https://x@.edu/b.html</loc></url></urlset>"), ("part2@", "<urlset><url><loc>https://x@.edu/a.pdf</loc></url><url><loc> https://x@.edu/c.pdf </loc></url></urlset>"),
    ("lone@", "<urlset><url><loc>https://x@.edu/lost.pdf</loc></url></urlset>"),
]
_SITE = "concat('-', x.c_custkey - x.c_custkey % 5)"
SITEMAPS_ = fx.Spread(SITEMAPS, "location string, xml string", "customer", "c_custkey", location=f"replace(t.location, '@', {_SITE})", xml=f"replace(t.xml, '@', {_SITE})")
ROBOTS = [("a.org", "/private", False), ("a.org", "/private/open", True), ("b.org", "/", False)]
ROBOT_URLS = [("https://a.org/x", "a.org", "/x"), ("https://a.org/private/y", "a.org", "/private/y"), ("https://a.org/private/open/z", "a.org", "/private/open/z"), ("https://b.org/q", "b.org", "/q"), ("https://c.org/", "c.org", "/")]
NOW = "2024-01-04 06:00:00"
#: The rows above, dealt over whole tables.
TASKS_ = fx.Spread(TASKS, TASK_SCHEMA, "orders", "o_orderkey", task_id="concat('t', x.o_orderkey)", priority="x.o_orderkey % 17")
CHANGES_ = fx.Spread(CHANGES, "task_id string, status string, error_message string", "orders", "o_orderkey", task_id="concat(t.task_id, x.o_orderkey)")
SOURCES_ = fx.Spread(SOURCES, SOURCE_SCHEMA, "supplier", "s_suppkey", name="concat(t.name, ' ', x.s_suppkey)", priority="x.s_suppkey % 11")
HEALTH_ = fx.Spread(HEALTH, "name string, status string", "supplier", "s_suppkey", name="concat(t.name, ' ', x.s_suppkey)")
FILES_ = fx.Spread(FILES, "id int, size bigint, head string, kind string", "documents", "doc_id", id="x.doc_id", size="coalesce(x.n_chars, 0) * 10")
ATOM_ = fx.Spread(ATOM, "feed string", "documents", "doc_id", feed="replace(replace(replace(t.feed, '2401.00001', concat('2401.', x.doc_id)), 'Deep Nets', concat('Deep Nets ', coalesce(x.lang, ''))), '2024-01-05', concat('2024-01-', lpad(cast(x.doc_id % 28 + 1 as string), 2, '0')))")
DSPACE_ = fx.Spread(DSPACE, "reply string", "documents", "doc_id", reply="replace(replace(t.reply, 'Thesis A', concat('Thesis ', x.doc_id)), 'a.pdf', concat(x.doc_id, '.pdf'))")
EPRINTS_ = fx.Spread(EPRINTS, "reply string", "documents", "doc_id", reply="replace(replace(t.reply, 'Paper E', concat('Paper ', x.doc_id)), 'N1', concat('N', coalesce(x.source, '')))")
ROBOTS_ = fx.Spread(ROBOTS, "host string, prefix string, allow boolean", "customer", "c_custkey", host="concat(t.host, x.c_custkey % 20)")
ROBOT_URLS_ = fx.Spread(ROBOT_URLS, "url string, host string, path string", "pages", "page_id", url="concat(t.url, '?', x.page_id)", host="concat(t.host, x.page_id % 20)")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TASKS_.rows(spark, sf_dir)
    return t.select("task_id", "status", "priority", F.to_timestamp_ntz("created").alias("created_at"), "retry_count", "max_retries", F.to_timestamp_ntz("started").alias("started_at"), F.to_timestamp_ntz("completed").alias("completed_at"), "error_message")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.search_documents(fx.meta(spark, sf_dir), 0.5, 5, subject_area="mathematics").select("filename", "quality_score")


def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over parts, with the price as quality and the brand as field."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("quality_score"), "p_brand")
    return ca.search_documents(p, 905.0, 20, p_brand="Brand#4").select("ordinal", "quality_score")


def similar_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir).withColumn("similarity_hash", F.col("subject_area"))
    return ca.similar_by_hash(m, "physics", 0.5).select("filename")


def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SOURCES_.rows(spark, sf_dir)
    active = ca.active_sources(s).select("name", F.lit("active").alias("list"))
    return active.union(ca.sources_for(s, "physics").select("name", F.lit("physics")))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured and healthy sources: healthy counts all health rows, so unhealthy can be negative."""
    s, h = SOURCES_.rows(spark, sf_dir), HEALTH_.rows(spark, sf_dir)
    out = s.agg(F.count(F.lit(1)).alias("total_sources")).join(h.agg(F.count_if(F.col("status") == "healthy").alias("healthy_sources")))
    bad = h.where("status <> 'healthy'").join(s, "name").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("recheck"))
    return out.join(bad).withColumn("unhealthy_sources", F.col("total_sources") - F.col("healthy_sources"))


def source_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SOURCES_.rows(spark, sf_dir)
    return ca.read_back(s, {"retry_attempts": (0, 3), "timeout": (0, 30)}).select("name", "retry_attempts", "timeout")


def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.pending_tasks(tasks(spark, sf_dir), 5).select("task_id", "priority")


def order_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending queue over orders: open ones by priority, then age."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O'")
    t = o.select(F.lit("pending").alias("status"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("task_id"))
    return ca.pending_tasks(t, 50).select("task_id", "priority")


def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ca.change_status(tasks(spark, sf_dir), CHANGES_.rows(spark, sf_dir).where("task_id is not null"), F.to_timestamp_ntz(F.lit(NOW)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("task_id", "status", "error_message", text("started_at"), text("completed_at"))


def task_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("task_id", *[c.alias(k) for k, c in ca.task_tests(F.to_timestamp_ntz(F.lit(NOW))).items()])


def updated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update and delete over customers: every fifth key changed, every seventh deleted."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", F.lit("old").alias("state"))
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    out = ca.update_rows(c, changes, "c_custkey", ("state", F.lit("new")))
    return ca.delete_rows(out, c.where("c_custkey % 7 = 0"), "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


def inserted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    new = p.select((F.col("p_partkey") + 100).alias("p_partkey"), F.lit("new").alias("p_brand"))
    return ca.insert_new(p, new, "p_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.keep_first(documents(spark, sf_dir), F.sha2("text", 256))


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.duplicate_groups(documents(spark, sf_dir), F.sha2("text", 256))


def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken unique keys of documents' texts and orphans of orders' customers."""
    d = documents(spark, sf_dir).select(F.sha2("text", 256).alias("h"))
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    broken = ca.broken_keys(d, "h").agg(F.count(F.lit(1)).alias("broken"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return broken.join(ca.missing_parts(o, "o_custkey", c, "c_custkey").agg(F.count(F.lit(1)).alias("orphans")))


def first_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "source", "lang")
    return ca.first_per_key(d, "source", "doc_id").select("source", F.col("doc_id").alias("first_id"))


def capped_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "source", "n_chars")
    return ca.capped_per_key(d, "source", F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id")), 3).select("source", "doc_id")


def download_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FILES_.rows(spark, sf_dir)
    return f.select("id", ca.downloadable(F.col("size"), F.lit(400), F.lit(100_000), F.col("head"), F.col("kind")).alias("ok"))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ca.collection_statistics(fx.meta(spark, sf_dir), "subject_area", "academic_level")
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|").alias(c)
    return out.select("documents", "bytes", F.round("mean_quality", 6).alias("mean_quality"), flat("by_subject_area"), flat("by_academic_level"))


def conversation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turn of each conversation by role: the newest row per key."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == "user").alias("user_turns"))


def atom_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.atom_papers(ATOM_.rows(spark, sf_dir)).select("paper_id", "title", "abstract", F.array_join("authors", "|").alias("authors"), F.array_join("subject_areas", "|").alias("subjects"), "pdf_url")


def recent_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.recent_papers(rd.atom_papers(ATOM_.rows(spark, sf_dir)), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), 30).select("paper_id")


def federated_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rd.atom_papers(ATOM_.rows(spark, sf_dir)).withColumn("repository_type", F.lit("arxiv"))
    papers = rd.federated(a, rd.dspace_papers(DSPACE_.rows(spark, sf_dir), "https://d.org"), rd.eprints_papers(EPRINTS_.rows(spark, sf_dir)))
    return papers.select("title", F.array_join("authors", "|").alias("authors"), F.coalesce(F.array_join("keywords", "|"), F.lit("")).alias("keywords"), "pdf_url", "repository_type")


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all sitemaps that the roots lead to, over two levels of index files."""
    s = SITEMAPS_.rows(spark, sf_dir)
    return cr.sitemap_pages(s.where("location like 'root%'"), rd.sitemap_entries(s)).select("url", "sitemap", F.col("depth").cast("bigint").alias("depth"))


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.allowed_by_robots(ROBOT_URLS_.rows(spark, sf_dir), ROBOTS_.rows(spark, sf_dir).distinct()).select("url")


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys as pages, each linking to three others, crawled from two seeds."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("k"))
    n = s.count()
    links = s.select(F.col("k").cast("string").alias("src"), F.explode(F.array(*[((F.col("k") * m + 7) % n).cast("string") for m in (3, 5, 11)])).alias("dst"))
    return cr.frontier(spark.createDataFrame([("1",), ("2",)], "url string"), links, 3).select("url", F.col("depth").cast("bigint").alias("depth"))


def subject_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of subject_index as the sink writes them, line by line."""
    path = scratch_path(spark, "pages")
    sk.write_pages(sk.index_rows(fx.meta(spark, sf_dir).where("subject_area <> ''")), path, "subject_area", lines_a_file=50)
    return sk.read_pages(spark, path, "subject_area")


def subject_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.index_lines(fx.meta(spark, sf_dir).where("subject_area <> ''"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words of test items and documents, by language: the equi-join form of a dictionary search."""
    w = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("w")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", w("text"))
    d = documents(spark, sf_dir).select("lang", w("text")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return b.join(d, "w").groupBy("lang").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("n").alias("n_occurrences"))


_T = f"with {TASKS_.sql('t')}"
_S = SOURCES_.sql("s")
_SHA = "sha256(text)"
_TAG = lambda t: f"trim(regexp_extract(e, '(?is)<{t}(?:\\\\s[^>]*)?>(.*?)</{t}\\\\s*>', 1))".replace("\\\\", "\\")
_CATEGORY = "case " + " ".join(f"when starts_with(c, '{p}') then '{s}'" for p, s in d.CATEGORY_PREFIXES) + " end"
_PAPERS = rf"""with {ATOM_.sql('f')}, en as (select unnest(regexp_extract_all(feed, '(?is)<entry(?:\s[^>]*)?>(.*?)</entry\s*>', 1)) as e from f),
  pa as (select string_split({_TAG('id')}, '/')[-1] as paper_id, {_TAG('title')} as title, {_TAG('summary')} as abstract, array_to_string(list_transform(regexp_extract_all(e, '(?is)<name(?:\s[^>]*)?>(.*?)</name\s*>', 1), lambda n: trim(n)), '|') as authors,
    list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(e, '(?i)<category[^>]*term=["'']([^"'']*)["'']', 1), lambda c: {_CATEGORY}), lambda s: s is not null))) as found,
    nullif(regexp_extract(list_filter(regexp_extract_all(e, '(?i)(<link[^>]*>)', 1), lambda x: contains(x, 'application/pdf'))[1], 'href=["'']([^"'']*)["'']', 1), '') as link, {_TAG('published')} as published from en),
  p as (select paper_id, title, abstract, authors, case when len(found) > 0 then array_to_string(found, '|') else 'general' end as subjects, coalesce(link, 'https://arxiv.org/pdf/' || paper_id || '.pdf') as pdf_url, replace(published, 'Z', '')::timestamp as published from pa)"""
_REPOSITORIES = f"""{_PAPERS}, {DSPACE_.sql('ds')}, {EPRINTS_.sql('ep')}, di as (select unnest(json_extract(reply, '$.items[*]')) as i from ds), ei as (select unnest(json_extract(reply, '$.items[*]')) as i from ep),
  dp as (select json_extract_string(i, '$.metadata."dc.title"[0].value') as title, array_to_string(json_extract_string(i, '$.metadata."dc.creator"[*].value'), '|') as authors, coalesce(array_to_string(json_extract_string(i, '$.metadata."dc.subject"[*].value'), '|'), '') as keywords,
    list_filter(json_extract(i, '$.bitstreams[*]'), lambda b: json_extract_string(b, '$.mimeType') = 'application/pdf')[1] as b from di),
  eq as (select json_extract_string(i, '$.title') as title, array_to_string(json_extract_string(i, '$.creators[*].name'), '|') as authors, replace(json_extract_string(i, '$.keywords'), ',', '|') as keywords,
    list_filter(json_extract(i, '$.documents[*]'), lambda b: json_extract_string(b, '$.mime_type') = 'application/pdf')[1] as b from ei)
  select title, authors, '' as keywords, pdf_url, 'arxiv' as repository_type from p
  union all select title, authors, keywords, 'https://d.org/bitstream/' || json_extract_string(b, '$.uuid') || '/' || json_extract_string(b, '$.name'), 'dspace' from dp where title <> ''
  union all select title, authors, keywords, json_extract_string(b, '$.uri'), 'eprints' from eq where title <> ''"""

QUERIES = {f.__name__: f for f in (
    metadata_search, part_search, similar_hash, source_lists, source_health, source_defaults, pending_tasks, order_queue, status_transition, task_checks, updated_customers, inserted_parts, exact_dedup_keep_first,
    dup_groups, key_checks, first_by_source, capped_by_source, download_gates, collection_stats, conversation_tasks, atom_papers, recent_papers, federated_papers, sitemap_urls, robots_gate, crawl_frontier, subject_index, subject_pages,
    benchmark_overlap,
)}
SQL = {
    "metadata_search": f"with {fx.meta_sql()} select filename, quality_score::double as quality_score from meta where quality_score >= 0.5 and subject_area = 'mathematics' order by quality_score desc, ordinal limit 5",
    "part_search": "select p_partkey as ordinal, p_retailprice as quality_score from part where p_retailprice >= 905.0 and p_brand = 'Brand#4' order by p_retailprice desc, p_partkey limit 20",
    "similar_hash": f"with {fx.meta_sql()} select filename from meta where subject_area = 'physics' and quality_score >= 0.5",
    "source_lists": f"with {_S} select name, 'active' as list from s where is_active union all select name, 'physics' from s where is_active and list_contains(subject_areas, 'physics')",
    "source_health": f"with {_S}, {HEALTH_.sql('h')} select (select count(*) from s) as total_sources, (select count(*) from h where status = 'healthy') as healthy_sources, (select string_agg(name, '|' order by name) from h join s using (name) where status <> 'healthy') as recheck, (select count(*) from s) - (select count(*) from h where status = 'healthy') as unhealthy_sources",
    "source_defaults": f"with {_S} select name, coalesce(nullif(retry_attempts, 0), 3) as retry_attempts, coalesce(nullif(timeout, 0), 30) as timeout from s",
    "pending_tasks": f"{_T} select task_id, priority from t where status = 'pending' order by priority desc, created, task_id limit 5",
    "order_queue": "select o_orderkey as task_id, 6 - substr(o_orderpriority, 1, 1)::int as priority from orders where o_orderstatus = 'O' order by 2 desc, o_orderdate, o_orderkey limit 50",
    "status_transition": f"""{_T}, {CHANGES_.sql('c0')}, c as (select task_id as id, status as new, error_message as err from c0 where task_id is not null) select task_id, coalesce(new, status) as status, case when id is not null then err else error_message end as error_message,
      case when id is not null and status = 'processing' then '{NOW}' else started end as started_at, case when id is not null and status in ('completed', 'failed') then '{NOW}' else completed end as completed_at from t left join c on task_id = id""",
    "task_checks": f"{_T} select task_id, created::timestamp < timestamp '{NOW}' - interval 24 hours as expired, retry_count < max_retries and status = 'failed' as can_retry from t",
    "updated_customers": "select c_custkey, round(c_acctbal + (c_custkey % 5 = 0)::int, 2) as c_acctbal, case when c_custkey % 5 = 0 then 'new' else 'old' end as state from customer where c_custkey % 7 <> 0",
    "inserted_parts": "with p as (select p_partkey, p_brand from part union all select p_partkey + 100, 'new' from part where p_partkey + 100 not in (select p_partkey from part)) select p_brand, count(*) as n from p group by p_brand",
    "exact_dedup_keep_first": "select min(doc_id) as doc_id from documents group by text",
    "dup_groups": f"select {_SHA} as content_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "key_checks": f"with b as (select {_SHA} as h, count(*) as n from documents group by 1 having count(*) > 1) select (select count(*) from b) as broken, (select coalesce(sum(n), 0)::bigint from b) as rows, (select count(*) from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer)) as orphans",
    "first_by_source": "select source, min(doc_id) as first_id from documents group by source",
    "capped_by_source": "select source, doc_id from documents qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3",
    "download_gates": f"with {FILES_.sql('f')} select id, size between 400 and 100000 and size >= 1024 and (substr(head, 1, 4) = '%PDF' or contains(lower(kind), 'pdf')) as ok from f",
    "collection_stats": f"""with {fx.meta_sql()} select count(*) as documents, sum(file_size)::bigint as bytes, round(avg(quality_score), 6) as mean_quality, (select string_agg(concat(k, '=', n), '|' order by k) from (select subject_area as k, count(*) as n from meta group by 1)) as by_subject_area,
      (select string_agg(concat(k, '=', n), '|' order by k) from (select academic_level as k, count(*) as n from meta group by 1)) as by_academic_level from meta""",
    "conversation_tasks": "select conv_id, max(turn) as last_turn, max_by(role, turn) as last_role, count(*) filter (where role = 'user') as user_turns from conversations group by conv_id",
    "atom_papers": f"{_PAPERS} select paper_id, title, abstract, authors, subjects, pdf_url from p",
    "recent_papers": f"{_PAPERS} select paper_id from p where published >= timestamp '2024-01-10 00:00:00' - interval 30 days",
    "federated_papers": _REPOSITORIES,
    "sitemap_urls": f"""with recursive {SITEMAPS_.sql('s')}, e as materialized (select location, trim(unnest(regexp_extract_all(xml, '<loc>\\s*([^<]*?)\\s*</loc>', 1))) as url, contains(xml, '<sitemapindex') as is_index from s),
      f as (select location, 0 as depth from s where starts_with(location, 'root') union select e.url, f.depth + 1 from f join e on e.location = f.location and e.is_index where f.depth < 10),
      d as (select location, min(depth)::bigint as depth from f group by location) select e.url, d.location as sitemap, d.depth from d join e on e.location = d.location where not e.is_index""",
    "robots_gate": f"with {ROBOT_URLS_.sql('u')}, {ROBOTS_.sql('r')} select url from u where coalesce((select allow from r where r.host = u.host and starts_with(u.path, prefix) order by length(prefix) desc, allow desc limit 1), true)",
    "crawl_frontier": "with recursive n as (select count(*) as n from supplier), e as (select s_suppkey::bigint as src, (s_suppkey * m + 7) % n as dst from supplier, n, (values (3), (5), (11)) v(m)), f as (select unnest([1, 2])::bigint as url, 0 as depth union select dst, depth + 1 from f join e on src = url where depth < 3) select url::varchar as url, min(depth)::bigint as depth from f group by url",
    "subject_index": f"with {fx.meta_sql()} select subject_area, concat('# ', array_to_string(list_transform(string_split(subject_area, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '), chr(10), chr(10), count(*), ' documents', chr(10), chr(10), string_agg(concat('- **', title, '** (', academic_level, ') - `', filename, '`'), chr(10) order by academic_level, title, filename)) as page from meta where subject_area <> '' group by subject_area",
    "subject_pages": f"with p as (with {fx.meta_sql()} select subject_area, concat('# ', array_to_string(list_transform(string_split(subject_area, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '), chr(10), chr(10), count(*), ' documents', chr(10), chr(10), string_agg(concat('- **', title, '** (', academic_level, ') - `', filename, '`'), chr(10) order by academic_level, title, filename)) as page from meta where subject_area <> '' group by subject_area), l as (select subject_area, string_split(page, chr(10)) as lines from p) select subject_area, unnest(range(len(lines))) as place, unnest(lines) as line from l",
    "benchmark_overlap": r"with b as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as w from benchmark), d as (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as w from documents), g as (select lang, w, count(*) as n from d group by all) select lang, count(*) as n_hits, sum(n)::bigint as n_occurrences from b join g using (w) group by lang",
}
