"""Queries of registries, files, repositories, crawls, taxonomies, round trips and operational tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.functions.tables import scratch_path, table
from folioflow.operators import markup as mk
from folioflow.operators import crawl as cr
from folioflow.operators import monitoring as mo
from folioflow.operators import operations as op
from folioflow.operators import pages as pg
from folioflow.operators import profile as pf
from folioflow.operators import relations as rl
from folioflow.operators import scoring as sc
from folioflow.operators import urls as u
from folioflow.plans import fixtures as fx
from folioflow.plans import sqlgen as g
from folioflow.plans.documents import _resolve as resolve_sql
from folioflow.plans.scoring import _vote_sql
from folioflow.sources import readers as rd
from folioflow.sources import sinks as sk

NOW = "2024-01-25 00:00:00"
KINDS = [("arxiv", None), ("arxiv", False), ("institutional", None), ("google_scholar", None), ("researchgate", True), ("wiki", None)]
KINDS_ = fx.Spread(KINDS, "kind string, enabled boolean", "customer", "c_custkey", kind="t.kind")
#: Three layouts of result pages: (item pattern, title pattern), and a page of each.
LAYOUTS = {
    "scholar": (r'(?is)<div class="gs_r">(.*?)</div>', r"(?is)<h3[^>]*>(.*?)</h3>"),
    "list": (r'(?is)<li class="result">(.*?)</li>', r'(?is)<a[^>]*class="title"[^>]*>(.*?)</a>'),
    "table": (r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<td[^>]*>(.*?)</td>"),
}
RESULTS = [
    ('<div class="gs_r"><h3><a href="/p@.pdf">Graphs <b>@</b></a></h3> Cited by 1@</div><div class="gs_r"><h3></h3></div>',), ('<ul><li class="result"><a class="title" href="q.pdf">Notes @</a></li><li class="other">x</li></ul>',),
    ('<table><tr><td><a href="https://z.org/t@">Thesis @</a></td><td>Cited by 4</td></tr><tr><td> </td></tr></table>',),
]
RESULTS_ = fx.Spread([(0, "", h) for (h,) in RESULTS], "page_id int, url string, html string", "pages", "page_id", page_id="x.page_id", url="x.url", html="replace(t.html, '@', cast(x.page_id as string))")
CONSTRUCTED = r"[^ -~]|[()\\]"


# ---- sources -------------------------------------------------------------

_STRATEGIES = "case {k} % 4 when 0 then 'static_html' when 1 then 'api_endpoint' when 2 then 'telepathy' else 'rss_feed' end"
_CRAWLED = "case when {k} % 5 = 0 then 'yesterday' else concat('2024-01-0', {k} % 9 + 1, 'T00:00:00') end"


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of JSON entries, some broken, some with a strategy or time that is none: bad entries are dropped."""
    k = {"k": "c_custkey"}
    entry = f"""case when c_custkey % 11 = 0 then '{{oops' else concat('{{"name": "Source ', c_custkey, '", "base_url": "https://s', c_custkey, '.example.org", "scraping_strategy": "', {_STRATEGIES.format(**k)}, '", "priority": ', c_custkey % 7, ', "last_crawled": "', {_CRAWLED.format(**k)}, '"}}') end"""
    rows = rd.registry_rows(table(spark, sf_dir, "customer").select(F.expr(entry).alias("entry")), "entry")
    return rows.select("name", "scraping_strategy", "priority", "max_depth", "is_active", F.date_format("last_crawled", "yyyy-MM-dd").alias("last_crawled"))


def pdf_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information and text of files that are made of all documents."""
    i = F.col("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), CONSTRUCTED, " ")
    parts = [
        F.lit("%PDF-1.4\n"), F.expr("repeat('<< /Type /Page >>\n', cast(1 + doc_id % 3 as int))"), F.when(i % 4 == 0, "/Encrypt 1 0 R\n").otherwise(""), F.expr("repeat('/Subtype /Image\n', cast(doc_id % 2 as int))"),
        F.concat(F.lit("/Title (Paper "), i.cast("string"), F.lit(") /Author ("), F.coalesce("source", F.lit("")), F.lit(")\n")), F.lit("stream\nBT ("), text, F.lit(") Tj ET\nendstream"),
    ]
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), i.cast("string")).alias("path"), F.concat(i.cast("string"), F.lit(".pdf")).alias("filename"), F.encode(F.concat(*parts), "UTF-8").alias("content"))
    return rd.pdf_profile(files).select("filename", F.col("pages").cast("bigint").alias("pages"), "encrypted", F.col("images").cast("bigint").alias("images"), "title", "author", F.md5("text").alias("text_md5"), rd.candidate_title(F.col("text"), F.col("title")).alias("candidate"))


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document as a scan that shows its language alone, every third with recognised text."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("lang")).alias("text"))
    ocr = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("filename"), F.col("text").alias("ocr_text"))
    return op.with_ocr(files, ocr).select(F.col("filename").alias("doc_id"), F.md5("text").alias("text_md5"))


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    rendered = pages.where("page_id % 2 = 0").select("page_id", F.concat("html", F.lit("<!-- rendered -->")).alias("html"))
    return op.rendered_or_static(pages, rendered).select("page_id", "strategy", F.md5("html").alias("html_md5"))


def paged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged scan of at most 250 orders, 100 a page: the limit is the scan's."""
    return op.paged(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 250).select("o_orderkey", "page")


def enabled_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.enabled_repositories(KINDS_.rows(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def search_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, links and citations of result pages in three layouts."""
    pages = RESULTS_.rows(spark, sf_dir)
    parts = [rd.search_results(pages, item, title).withColumn("layout", F.lit(name)) for name, (item, title) in LAYOUTS.items()]
    return parts[0].union(parts[1]).union(parts[2]).select("layout", "title", "link", F.coalesce(F.col("citations"), F.lit(0)).cast("bigint").alias("citations"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8 without a header, in ISO-8859-1 with one, and in ISO-8859-1 without."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\u0000-ÿ]", "?")
    i = F.col("doc_id") % 3
    raw = table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1")).alias("b"), F.when(i == 1, "ISO-8859-1").alias("charset"))
    return raw.select("doc_id", rd.detected_charset(F.col("b"), F.col("charset")).alias("charset"), F.md5(rd.decoded(F.col("b"), rd.detected_charset(F.col("b"), F.col("charset")))).alias("text_md5"))


def best_first_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty customers as pages, best first from three seeds; a page links to four others."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"))
    n = c.count()
    dst = F.explode(F.array(*[((F.col("k") * m + 3) % n) for m in (2, 3, 5, 7)]))
    links = c.select(F.col("k").cast("string").alias("src"), dst.alias("t")).select("src", F.col("t").cast("string").alias("dst"), (F.col("t") * 31 % 10).cast("int").alias("priority"))
    seeds = spark.createDataFrame([("1", 1), ("2", 5), ("4", 5)], "url string, priority int")
    return cr.best_first(seeds, links, 60, 4, fetch=8).select(F.col("turn").cast("bigint").alias("turn"), "url", F.col("depth").cast("bigint").alias("depth"))


# ---- relations and taxonomies --------------------------------------------


def files_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have extracted metadata: the inner form of the join by name."""
    m = fx.meta(spark, sf_dir)
    files = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".pdf")).alias("filename"), F.col("lang").alias("text"))
    return rl.with_known_texts(m.select("filename", "title"), files).select("filename", "title", "text")


def custom_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in taxonomy with topics of the documents' sources, saved as JSON and loaded again."""
    base = spark.createDataFrame([(s, t, k, lv) for s, t, k, lv in d.TAXONOMY], "subject string, topic string, keywords array<string>, levels array<string>")
    docs = table(spark, sf_dir, "documents")
    custom = docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("topic")).agg(F.array_sort(F.collect_set("lang")).alias("keywords")).select(F.lit("sources").alias("subject"), "topic", "keywords", F.array(F.lit("graduate")).alias("levels"))
    replaced = spark.createDataFrame([("mathematics", "calculus", ["limit"], ["graduate"])], base.schema)
    both = op.add_topics(op.add_topics(base, custom), replaced)
    path = scratch_path(spark, "taxonomy")
    op.save_rows(both, path)
    return op.load_rows(both, path).select("subject", "topic", F.array_join("keywords", "|").alias("keywords"), F.array_join("levels", "|").alias("levels"))


def topic_match_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a taxonomy made of the benchmark: each item a topic, its distinct words the keywords."""
    words = lambda c: tx.word_array(F.coalesce(c, F.lit("")))
    tax = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("subject"), F.lpad(F.col("item_id").cast("string"), 6, "0").alias("topic"), F.array_distinct(words(F.col("text"))).alias("keywords"))
    out = op.match_taxonomy(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", words(F.col("text")), tax)
    return out.select("doc_id", "topic", F.round("score", 6).alias("score"))


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words and stems of each language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(tx.word_array(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct(op.stem(F.col("w"))).alias("n_stems"), F.sum(F.char_length(op.stem(F.col("w")))).alias("stem_chars"))


def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    lang, sure = sc.language_vote(F.concat_ws(" ", "title", "content"))
    errors = [F.when(F.col("title") == "", F.lit("no title")), F.when(F.col("text_ratio") < 0.05, F.lit("little text"))]
    out = op.result_columns(m, lang, F.round(sure, 6), F.round(pf.sentence_readability(F.col("content")), 6), pf.content_hash(F.col("content")), errors)
    return out.withColumns({c: F.array_join(c, "|") for c in ("authors", "keywords", "processing_errors")}).withColumn("page_count", F.col("page_count").cast("bigint"))


def language_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages whose text passes the test of the page's language."""
    links = mk.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", "link", u.academic_link_text(F.col("link_text"), "es").alias("es"), u.academic_link_text(F.col("link_text"), "fr").alias("fr"))


def fifo_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of open orders by arrival; the priority has no say."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderdate", "o_orderkey", "o_orderpriority")
    return op.first_in_first_out(o, "o_orderdate", "o_orderkey").select("o_orderkey", "place")


# ---- round trips through sinks -------------------------------------------


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    c = table(spark, sf_dir, "conversations")
    user = F.col("role").eqNullSafe(F.lit("user"))
    for part in (c.where(user), c.where(~user)):  # a second write goes behind the first
        sk.append_jsonl(part, path)
    return spark.read.schema(c.schema).json(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max(F.md5("text")).alias("largest_md5"), F.sum(F.char_length("text")).alias("chars"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows with their excerpt of 500 characters through CSV; line ends and quotes come back."""
    path = scratch_path(spark, "csv")
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.col("lang").alias("language"), F.col("source").alias("field"), F.lit("u").alias("url"), "source", F.md5(t).alias("hash"), F.char_length(t).cast("bigint").alias("size"), F.lit("a \"b\", c").alias("title"), t.alias("excerpt"))
    sk.append_csv(rows, path, F.col("excerpt"))
    return rd.legacy_csv(spark, path).select("filename", "language", "field", "hash", "size", "title", F.md5("excerpt").alias("excerpt_md5"))


def hierarchy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "hierarchy")
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    sk.write_hierarchy(rows, path, "lang", "source")
    return spark.read.schema("doc_id bigint, lang string, source string").parquet(path).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.snapshot(table(spark, sf_dir, "customer"), scratch_path(spark, "snapshot")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last_key"))


# ---- operational tables --------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def checkpoints(e: DataFrame) -> DataFrame:
    """Events as checkpoints: the user is the task, the event's number the order, its value what is done."""
    return e.select(F.col("user_id").alias("task"), F.col("event_id").alias("saved_at"), F.col("value").alias("done"))


def resumable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.resumable(checkpoints(events(spark, sf_dir)), "task", F.lit(20.0)).select("task", "saved_at", F.round("left_", 4).alias("left_"))


def stale_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale_checkpoints(checkpoints(events(spark, sf_dir)), "task", 10).select("task", "saved_at")


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error'").select("event_id")
    return op.retry_schedule(e, F.col("event_id") % 6, 3, initial=1.0, factor=3.0, most=5.0).select("event_id", "attempt", "wait", "outcome")


def degraded_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the last days by who serves them: users with errors are degraded and fall back on a common one."""
    e = events(spark, sf_dir)
    bad = op.degraded(e, "user_id", F.col("event_type") != "error", F.to_timestamp_ntz(F.lit(NOW)), 48, 1)
    return op.with_fallback(e, "user_id", bad, F.lit("mirror")).groupBy("served_by").agg(F.count(F.lit(1)).alias("n"))


def retained_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = mo.threshold_alerts(events(spark, sf_dir), "event_type", {"click": 15.0, "error": 20.0})
    return op.retained(alerts, F.to_timestamp_ntz(F.lit(NOW))).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.progress_of(events(spark, sf_dir), "event_type", F.col("event_id") % 3 > 0, F.col("value") * 1024, F.col("value"))
    return out.select("event_type", "total", "finished", *[F.round(c, 4).alias(c) for c in ("percent", "bytes", "eta")])


def health_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.health(events(spark, sf_dir), "6 hours", "value", 9.0, 10.0, 60.0)
    return out.select(mo.micros(F.col("start")).alias("start"), "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"), "status", "collect_now")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, docs = events(spark, sf_dir), table(spark, sf_dir, "documents")
    good = F.count_if(F.col("event_type") != "error")
    crawl = e.agg(F.count(F.lit(1)).alias("events"), good.alias("good"), F.round(good / F.count(F.lit(1)), 6).alias("rate"))
    corpus = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))
    return op.dashboard(crawl=crawl, corpus=corpus)


# ---- SQL -----------------------------------------------------------------

QUERIES = {f.__name__: f for f in (
    source_registry, pdf_profiles, ocr_texts, rendered_pages, paged_replies, enabled_repositories, search_layouts, decoded_texts, best_first_crawl, files_with_metadata, custom_taxonomy, topic_match_custom, word_stems,
    result_projection, language_links, fifo_queue, jsonl_round_trip, csv_round_trip, hierarchy_round_trip, customer_snapshot, resumable_tasks, stale_checkpoints, retry_schedule, degraded_services, retained_alerts,
    download_progress, health_windows, dashboard,
)}
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
_ENDS = lambda w, *es: "(" + " or ".join(f"ends_with({w}, '{e}')" for e in es) + ")"
_STEM = f"""case when {_ENDS('w', 'ies')} and not {_ENDS('w', 'eies', 'aies')} then left(w, -3) || 'y' when {_ENDS('w', 'es')} and not {_ENDS('w', 'aes', 'ees', 'oes', 'ies')} then left(w, -1)
  when {_ENDS('w', 's')} and not {_ENDS('w', 'us', 'ss', 'es')} then left(w, -1) else w end"""
_FILE_TEXT = r"regexp_replace(coalesce(text, ''), '[^ -~]|[()\\]', ' ', 'g')"
_READABILITY = "greatest(0.0, least(1.0, 1.0::double - abs(len(regexp_extract_all(content, '\\S+')) / (len(regexp_extract_all(content, '[.!?]+')) + 1) - 15) / 15))"


def _results_sql() -> str:
    strip = lambda c: f"trim(regexp_replace({c}, '(?s)<[^>]*>', '', 'g'))"
    parts = [f"select '{n}' as layout, url, unnest(regexp_extract_all(html, {fx.literal(item)}, 1)) as i, {fx.literal(title)} as title_pattern from r" for n, (item, title) in LAYOUTS.items()]
    titles = "case layout " + " ".join(f"when '{n}' then regexp_extract(i, {fx.literal(title)}, 1)" for n, (_, title) in LAYOUTS.items()) + " end"
    return f"""with {RESULTS_.sql('r')}, i as ({' union all '.join(parts)}), t as (select layout, url, i, {strip(titles)} as title, regexp_extract(i, '(?i)href=["'']([^"'']*)["'']', 1) as href from i)
  select layout, title, {resolve_sql('url', 'href')} as link, coalesce(try_cast(nullif(regexp_extract(i, 'Cited by (\\d+)', 1), '') as bigint), 0) as citations from t where title <> ''"""


#: One page a step: `queue` holds what is found and not yet visited, best first by priority and then by `seq`.
_BEST_FIRST = """with recursive n as (select count(*) as n from customer), e as (select c_custkey::bigint as src, (c_custkey * m + 3) % n as t from customer, n, (values (2), (3), (5), (7)) v(m)),
  l as (select src::varchar as src, t::varchar as dst, max(t * 31 % 10)::int as p from e group by all), a as materialized (select src, list({'p': p, 'url': dst} order by p desc, dst) as out from l group by src),
  f as (select 0 as step, null::varchar as url, null::bigint as depth, [{'p': 5, 's': 0, 'url': '2', 'd': 0}, {'p': 5, 's': -1, 'url': '4', 'd': 0}, {'p': 1, 's': -2, 'url': '1', 'd': 0}]::struct(p int, s bigint, url varchar, d bigint)[] as queue, ['1', '2', '4'] as seen, 3::bigint as seq union all
    select step + 1, b.url, b.d, list_concat(list_filter(queue, lambda x: x.url <> b.url), list_transform(fresh, lambda x, i: {'p': x.p, 's': -(seq + i - 1), 'url': x.url, 'd': b.d + 1})), list_concat(seen, list_transform(fresh, lambda x: x.url)), seq + len(fresh)
    from (select f.*, b, case when b.d = 4 then [] else list_filter(coalesce(a.out, []), lambda x: not list_contains(seen, x.url)) end as fresh from (select *, list_max(queue) as b from f where step < 60 and len(queue) > 0) f left join a on a.src = f.b.url))
  select step - 1 as turn, url, depth from f where step > 0"""

SQL = {
    "source_registry": f"select 'Source ' || c_custkey as name, {_STRATEGIES.format(k='c_custkey')} as scraping_strategy, (c_custkey % 7)::int as priority, 3 as max_depth, true as is_active, substr({_CRAWLED.format(k='c_custkey')}, 1, 10) as last_crawled from customer where c_custkey % 11 <> 0 and c_custkey % 4 <> 2 and c_custkey % 5 <> 0",
    "pdf_profiles": f"""with p as (select doc_id, source, {_FILE_TEXT} as t from documents) select doc_id || '.pdf' as filename, 1 + doc_id % 3 as pages, doc_id % 4 = 0 as encrypted, doc_id % 2 as images, 'Paper ' || doc_id as title, coalesce(source, '') as author, md5(t) as text_md5,
      'Paper ' || doc_id as candidate from p""",
    "ocr_texts": """with f as (select doc_id, coalesce(case when doc_id % 2 = 0 then text else lang end, '') as own, coalesce(case when doc_id % 3 = 0 then text end, '') as other from documents)
      select doc_id, md5(case when length(trim(own)) < 100 and length(other) > length(own) then other else own end) as text_md5 from f""",
    "rendered_pages": "select page_id, case when page_id % 2 = 0 and html is not null then 'dynamic' else 'static' end as strategy, md5(case when page_id % 2 = 0 then html || '<!-- rendered -->' else html end) as html_md5 from pages",
    "paged_replies": "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 100 as page from orders order by o_orderkey limit 250",
    "enabled_repositories": f"with {KINDS_.sql('k')} select kind, count(*) as n from k where coalesce(enabled, kind in ('arxiv', 'institutional')) group by kind",
    "search_layouts": _results_sql(),
    "decoded_texts": r"select doc_id, case when doc_id % 3 = 0 or (doc_id % 3 = 2 and not regexp_matches(t, '[\x{80}-\x{ff}]')) then 'UTF-8' else 'ISO-8859-1' end as charset, md5(t) as text_md5 from (select doc_id, regexp_replace(coalesce(text, ''), '[^\x{00}-\x{ff}]', '?', 'g') as t from documents)",
    "best_first_crawl": _BEST_FIRST,
    "files_with_metadata": f"with {fx.meta_sql()} select filename, title, lang as text from meta join documents on ordinal = doc_id where doc_id % 3 <> 0",
    "custom_taxonomy": f"""with {fx.values_sql('b', [(s, t, '|'.join(k), '|'.join(lv)) for s, t, k, lv in d.TAXONOMY], 'subject string, topic string, keywords string, levels string')}
      select * from b where topic <> 'calculus' union all select 'mathematics', 'calculus', 'limit', 'graduate' union all select 'sources', coalesce(source, 'unknown'), coalesce(string_agg(distinct lang, '|' order by lang), ''), 'graduate' from documents group by all""",
    "topic_match_custom": f"""with k as (select lpad(item_id::varchar, 6, '0') as topic, unnest(list_distinct({_WORDS.format('text')})) as term from benchmark), n as (select topic, count(*) as size from k group by topic),
      w as (select doc_id, unnest(list_distinct({_WORDS.format('text')})) as term from documents), h as (select doc_id, topic, count(*) as n from w join k using (term) group by all),
      r as (select doc_id, h.topic, n / size as score, row_number() over (partition by doc_id order by n / size desc, h.topic) as turn from h join n on n.topic = h.topic) select doc_id, topic, round(score, 6) as score from r where turn = 1""",
    "word_stems": f"with w as (select distinct lang, unnest({_WORDS.format('text')}) as w from documents), s as (select lang, w, {_STEM} as s from w) select lang, count(*) as n_words, count(distinct s) as n_stems, sum(length(s))::bigint as stem_chars from s group by lang",
    "result_projection": f"""with {fx.meta_sql()}, x as (select *, lower(concat_ws(' ', title, content)) as t, list_filter([case when title = '' then 'no title' end, case when text_ratio < 0.05 then 'little text' end], lambda e: e is not null) as errors from meta), y as (select *, {_vote_sql(d.LANGUAGE_TERMS)} as best from x)
      select filename, title, array_to_string(authors, '|') as authors, institution, subject_area, academic_level, case when best.score > 0 then best.label else 'en' end as language, round(least(best.score / 10, 1.0), 6) as language_confidence, array_to_string(keywords, '|') as keywords, page_count::bigint as page_count,
      text_ratio, quality_score, round({_READABILITY}, 6) as readability_score, sha256(content) as content_hash, file_size, len(errors) = 0 as is_processed, coalesce(array_to_string(errors, '|'), '') as processing_errors from y""",
    "language_links": f"""with a as (select page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a\\s*>') as a from pages), e as (select page_id, url, unnest(a) as a, unnest(range(0, len(a))) as pos from a),
      h as (select page_id, url, pos, regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1) as href, lower(trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g'))) as t from e)
      select page_id, pos, {resolve_sql('url', 'href')} as link, {', '.join(f"t = '' or {g.any_of('t', d.LANGUAGE_TERMS[k])} or not {g.any_of('t', d.LINK_EXCLUDES[k])} as {k}" for k in ('es', 'fr'))} from h""",
    "fifo_queue": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as place from orders where o_orderstatus = 'O'",
    "jsonl_round_trip": "select role, count(*) as n, max(md5(text)) as largest_md5, sum(length(text))::bigint as chars from conversations group by role",
    "csv_round_trip": "select doc_id::varchar as filename, lang as language, source as field, md5(text) as hash, length(text)::bigint as size, 'a \"b\", c' as title, md5(substr(text, 1, 500)) as excerpt_md5 from documents",
    "hierarchy_round_trip": "select lang, source, count(*) as n, min(doc_id) as first_id from documents group by all",
    "customer_snapshot": "select c_mktsegment, count(*) as n, max(c_custkey) as last_key from customer group by c_mktsegment",
    "resumable_tasks": "with l as (select user_id as task, max(event_id) as saved_at, max_by(value, event_id) as done from events group by user_id) select task, saved_at, round(20.0 - done, 4) as left_ from l where done < 20.0",
    "stale_checkpoints": "select user_id as task, event_id as saved_at from events qualify row_number() over (partition by user_id order by event_id desc) > 10",
    "retry_schedule": """with c as (select event_id, event_id % 6 as fails, least(event_id % 6, 3) as last_ from events where event_type = 'error'), a as (select *, unnest(range(0, last_ + 1)) as attempt from c)
      select event_id, attempt, case when attempt = 0 then 0.0 else least(1.0 * pow(3.0, attempt - 1), 5.0) end::double as wait, case when attempt < last_ then 'retried' when fails <= 3 then 'succeeded' else 'gave_up' end as outcome from a""",
    "degraded_services": f"with b as (select user_id from events where ts > timestamp '{NOW}' - interval 48 hours and event_type = 'error' group by user_id having count(*) >= 1) select case when user_id in (select user_id from b) then 'mirror' else user_id::varchar end as served_by, count(*) as n from events group by 1",
    "retained_alerts": f"with l as (select *, case event_type when 'click' then 15.0 when 'error' then 20.0 end::double as t from events where ts > timestamp '{NOW}' - interval 168 hours) select case when (value - t) / t * 100 > 50 then 'critical' when (value - t) / t * 100 > 25 then 'error' else 'warning' end as severity, count(*) as n from l where value > t group by 1",
    "download_progress": "with e as (select *, event_id % 3 > 0 as done from events) select event_type, count(*) as total, count(*) filter (where done) as finished, round(count(*) filter (where done) * 100 / count(*), 4) as percent, round(coalesce(sum(value * 1024) filter (where done), 0.0), 4) as bytes, round(coalesce(sum(value) filter (where done) / greatest(count(*) filter (where done), 1) * (count(*) - count(*) filter (where done)), 0.0), 4) as eta from e group by event_type",
    "health_windows": "with w as (select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as s, count(*) as n, avg(value) as m, max(value) as most from events group by 1) select epoch_us(s) as start, n, round(m * n, 2) as total, case when m > 10.0 then 'critical' when m > 9.0 then 'warning' else 'healthy' end as status, most > 60.0 as collect_now from w",
    "dashboard": """with c as (select count(*) as n, count(*) filter (where event_type <> 'error') as g from events), d as (select count(*) as n, sum(n_chars) as chars, count(distinct source) as s from documents)
      select 'crawl' as section, 'events' as measure, n::double as value from c union all select 'crawl', 'good', g from c union all select 'crawl', 'rate', round(g / n, 6) from c union all select 'corpus', 'documents', n from d union all select 'corpus', 'chars', chars from d union all select 'corpus', 'sources', s from d""",
}
