"""Queries of document profiles, URLs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.functions.tables import table
from folioflow.operators import markup as mk
from folioflow.operators import pages as pg
from folioflow.operators import profile as pf
from folioflow.operators import urls as u
from folioflow.plans import fixtures as fx
from folioflow.plans import sqlgen as g

AUTHORS = [(1, "Dr. Ada Byron; Lin Wu PhD"), (2, "Leo Euler, Prof. N. Bohr and X"), (3, "A & B Curie & Professor Hill M.D."), (4, ""), (5, "One\nTwo Names,Three Names")]
RAW = [
    (1, "", "", "linear_algebra-notes.pdf", 12, 4000, 0, 0), (2, "Embedded Title", "Other", "x.pdf", 60, 900, 3, 2), (3, "", "Found Title Here", "y.pdf", 3, 0, 0, 1),
    (4, "A Very Long Embedded Title", "", "o'neil_guide.pdf", 2, 7000, 2, 1),
]
RAW_SCHEMA = "id int, embedded string, extracted string, filename string, pages int, chars int, images int, n_authors int"
LINKS = [
    (1, "https://www.north.edu/courses/cs101/lecture1.pdf"), (2, "https://arxiv.org/abs/2401.00001"), (3, "https://github.com/a/b/blob/main/notes.pdf"),
    (4, "https://drive.google.com/file/d/XYZ123/view?usp=sharing"), (5, "https://www.north.edu/login?next=/a"), (6, "http://www.north.edu/departments/physics/people/staff/list.html"),
    (7, "https://other.org/library/view?format=pdf&id=3"), (8, "mailto:a@north.edu"), (9, "https://www.north.edu/a/b/c/d/e/computer-science/index.html"), (10, "https://www.north.edu/files/archive.zip"),
    (11, "https://www.north.edu/news#top"), (12, "https://www.north.edu/research/papers/study.pdf?download=1"),
]
#: The rows above, dealt over whole tables.
AUTHORS_ = fx.Spread(AUTHORS, "id int, names string", "documents", "doc_id", id="x.doc_id", names="concat(t.names, '; Kim Lee', coalesce(x.source, ''))")
RAW_ = fx.Spread(RAW, RAW_SCHEMA, "documents", "doc_id", id="x.doc_id", filename="concat('f', x.doc_id, '_', t.filename)", pages="x.doc_id % 70", chars="coalesce(x.n_chars, 0)")
LINKS_ = fx.Spread(LINKS, "id int, url string", "pages", "page_id", id="x.page_id", url="replace(t.url, '/a', concat('/a', x.page_id % 5))")
BASE = "https://www.north.edu/"
INCLUDE, EXCLUDE = [r"lecture.*\.pdf", r"\.pdf$", r"\.pdf\?"], [r"archive", r"draft"]
SUBJECTS = ["computer_science", "physics"]
MARKUP = [
    (1, "https://x.edu/c/index.html", '<html><head><title>Course Home - X</title><meta name="description" content="All about it"><meta name="keywords" content="algebra, graphs"><meta name="author" content="A. Noether"></head><body><h1>CS 101 Fall 2023</h1><a href="files/lecture1.pdf">Lecture 1</a> <a href="/docs/notes.pdf">notes pdf</a><a href="../up/hw.pdf?v=1">Homework</a><a href="#x">x</a></body></html>'),
    (2, "https://y.org/", '<h1>Only <b>Heading</b></h1><p>First paragraph of the page.</p><p>By: Someone Else</p><h2>Part</h2><script>var f="data/a.pdf";</script><div data-file="slides.pdf">Hill College</div> https://z.org/t.pdf'),
    (3, "https://z.net/a/b", ""),
]
MARKUP_ = fx.Spread(MARKUP, "page_id int, url string, html string", "pages", "page_id", page_id="x.page_id", html="concat(t.html, coalesce(x.html, ''))")
#: The same pages as a chain: each links to the next one by its address.
CHAIN_ = fx.Spread(MARKUP, "page_id int, url string, html string", "pages", "page_id", page_id="x.page_id", url="concat('http://s.org/p', x.page_id)", html="concat(t.html, '<a href=\"/p', x.page_id + 1, '\">next</a>')")


def author_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = AUTHORS_.rows(spark, sf_dir)
    return rows.select("id", F.array_join(pf.parse_authors(F.col("names")), "|").alias("authors"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = RAW_.rows(spark, sf_dir)
    title = pf.merged_title(F.col("embedded"), F.col("extracted"), F.col("filename"))
    ratio = pf.text_ratio(F.col("chars"), F.col("images"))
    quality = pf.quality_score(F.col("pages"), F.coalesce(ratio, F.lit(0.0)), F.col("chars"), title, F.col("n_authors"))
    return r.select("id", title.alias("title"), F.round(ratio, 6).alias("text_ratio"), F.round(quality, 6).alias("quality"))


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", pf.title_from_text(t).alias("title"), F.round(pf.sentence_readability(t), 6).alias("readability"), pf.content_hash(t).alias("content_hash"),
                       F.md5(pf.clean_text(t)).alias("clean_md5"), F.md5(pf.summary(t)).alias("summary_md5"))


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractor's quality score by source, a page being 2000 characters, beside the labels."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    n = F.char_length("text")
    q = pf.quality_score(F.ceil(n / 2000), F.lit(1.0), n, pf.title_from_text(F.col("text")), F.lit(0))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = rows.select("doc_id", "source", F.round(q, 6).alias("q")).join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("q"), 6).alias("avg_q"), F.sum("quality").cast("bigint").alias("n_good"), F.count("quality").alias("n_labelled"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LINKS_.rows(spark, sf_dir)
    url = F.col("url")
    return rows.select("id", pf.safe_filename(url, F.lit("North Hill University Library")).alias("name"), pf.legacy_filename(url, F.lit("en"), F.lit("physics")).alias("legacy"), pf.download_url(url).alias("download"), pf.safe_folder(url).alias("folder"))


def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    path = F.concat_ws("/", F.lit("/data"), "subject_area", F.regexp_replace(F.lower("title"), " ", "_"))
    return m.select("filename", pf.subject_from_path(path, F.col("subject_area")).alias("subject"), F.array_join(pf.keywords_from_path(path, F.col("keywords")), "|").alias("keywords"),
                    pf.folder_path(F.col("subject_area"), F.col("academic_level"), F.lit("general")).alias("folder"))


def url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LINKS_.rows(spark, sf_dir)
    url, base = F.col("url"), F.lit(BASE)
    return rows.select(
        "id", u.wanted_file(url, INCLUDE, EXCLUDE).alias("wanted"), u.crawlable_page(url, base).alias("page"), u.crawlable_type(url).alias("type_ok"), u.academic_url(url).alias("academic"),
        u.entry_point(url).alias("entry"), u.generally_crawlable(url).alias("general"), u.should_crawl(url, base).alias("crawl"), u.pdf_link(url).alias("pdf"), u.loose_pdf_link(url).alias("loose_pdf"),
        u.maybe_holds_pdfs(url).alias("maybe"), u.priority(url, SUBJECTS).alias("priority"),
    )


def page_url_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", u.host(F.col("url")).alias("host"), u.path(F.col("url")).alias("path"), u.priority(F.col("url")).alias("priority"), u.generally_crawlable(F.col("url")).alias("general"))


def source_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    link = F.concat(F.lit("https://"), F.coalesce(F.nullif("download_source", F.lit("")), F.lit("x.org")))
    return m.select("filename", u.academic_source(link, F.array(F.coalesce(F.nullif("subject_area", F.lit("")), F.lit("general"))), F.col("institution")).alias("academic"),
                    u.repository_page(F.col("content"), link).alias("repository"), u.academic_link_text(F.col("title"), "es").alias("link_ok"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    html = F.col("html")
    return p.select("page_id", pg.title(html).alias("title"), pg.description(html).alias("description"), F.array_join(pg.keywords(html), "|").alias("keywords"), F.char_length(pg.page_text(html)).cast("bigint").alias("text_chars"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = mk.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", "href", "link_text", "link")


def markup_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MARKUP_.rows(spark, sf_dir)
    return pg.page_metadata(m).join(m.select("page_id", pg.site_name(F.col("html"), u.host(F.col("url"))).alias("site"), F.array_join(pg.file_patterns(F.col("html")), "|").alias("patterns")), "page_id")


def markup_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.pdf_urls(MARKUP_.rows(spark, sf_dir))


def followed_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF links of pages and of those one step away."""
    return pg.followed_pdf_urls(CHAIN_.rows(spark, sf_dir)).select("page_id", "link", F.col("depth").cast("bigint").alias("depth"))


def markup_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MARKUP_.rows(spark, sf_dir)
    return m.select("page_id", F.array_join(pg.embedded_urls(F.col("html"), F.col("url")), "|").alias("embedded"), F.array_join(pg.legacy_links(F.col("html")), "|").alias("legacy"))


# ---- SQL -----------------------------------------------------------------

_TITLE_CASE = "array_to_string(list_transform(range(1, length({x}) + 1), lambda i: case when i = 1 or not regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') then upper(substr({x}, i, 1)) else lower(substr({x}, i, 1)) end), '')"
_TAG = "regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"


def _tag(x: str) -> str:
    return _TAG.format(x=x)


def _inner(tag: str) -> str:
    return f"nullif(trim({_tag(f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1)")}), '')"


def _meta(name: str) -> str:
    return rf"""nullif(trim(regexp_extract(html, '(?i)<meta[^>]*name=["'']{name}["''][^>]*content=["'']([^"'']*)["'']', 1)), '')"""


_HOST = r"coalesce(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')"
_PATH = r"coalesce(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')"
_PAGE_TEXT = _tag(r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g')")
_DESC = f"coalesce({_meta('description')}, substr({_inner('p')}, 1, 200), '')"
_KEYS = rf"""array_to_string(list_concat(coalesce(list_transform(string_split({_meta('keywords')}, ','), lambda k: trim(k)), []::varchar[]), list_filter(list_transform(regexp_extract_all(html, '(?is)<h[123](?:\s[^>]*)?>(.*?)</h[123]\s*>', 1), lambda h: trim(regexp_replace(h, '(?s)<[^>]*>', '', 'g'))), lambda h: h <> ''))[1:10], '|')"""


def _resolve(base: str, href: str) -> str:
    """For links without dot steps beyond a leading one; the fixture has no others."""
    root = f"regexp_extract({base}, '^[A-Za-z]+://[^/?#]*')"
    folder = f"regexp_replace(regexp_replace(case when {_PATH.format(x=base)} = '' then '/' else {_PATH.format(x=base)} end, '[^/]*$', ''), '^$', '/')"
    up = f"regexp_replace({folder}, '[^/]+/$', '')"
    return rf"""case when regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {href} when {href} = '' then regexp_replace({base}, '#.*$', '') when starts_with({href}, '//') then regexp_extract({base}, '^[A-Za-z]+:') || {href}
      when starts_with({href}, '/') then {root} || {href} when starts_with({href}, '#') then regexp_replace({base}, '#.*$', '') || {href} when starts_with({href}, '../') then {root} || {up} || substr({href}, 4) else {root} || {folder} || {href} end"""


_PDF = lambda x: f"({_HOST.format(x=x)} <> '' and not {g.any_of(f'lower({x})', d.NO_PDF_LINK)} and (ends_with(lower({_PATH.format(x=x)}), '.pdf') or {g.any_of(f"lower(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1))", d.PDF_QUERY_TERMS)} or {g.any_of(f'lower({x})', d.PDF_URL_TERMS)}))"
_ENDS = lambda x, es: "(" + " or ".join(f"ends_with(lower({x}), '{e}')" for e in es) + ")"
_RX = lambda x, ps: "(" + " or ".join(f"regexp_matches({x}, {fx.literal('(?i)' + p)})" for p in ps) + ")"
_PATHS = [p for group in d.ACADEMIC_PATHS.values() for p in group]
_ACADEMIC = f"({_RX('lower(url)', _PATHS)} or {g.any_of('lower(url)', d.ACADEMIC_URL_TERMS)})"


def _priority(subjects: list[str]) -> str:
    parts = [f"regexp_matches(lower(url), '{p}')::int * {n}" for n, group in d.PRIORITY_PATHS for p in group]
    parts += [f"{g.any_of('lower(url)', [s.replace('_', ' '), s.replace('_', '-')])}::int * 3" for s in subjects]
    return f"({' + '.join(parts)} - greatest(0, len(list_filter(string_split({_PATH.format(x='url')}, '/'), lambda p: p <> '')) - 3))::bigint"


def _pdfs_sql(source: fx.Spread = MARKUP_) -> str:
    anchors = r"""list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a\s*>'), lambda a: {'href': regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1), 'text': lower(regexp_replace(a, '(?s)<[^>]*>', '', 'g'))})"""
    loose = f"({_ENDS('x.href', ['.pdf'])} or {g.any_of('lower(x.href)', [*d.PDF_QUERY_TERMS, '.pdf?', '.pdf#'])})"
    told = f"({g.any_of('x.text', d.LINK_WORDS)} and (contains(x.text, 'pdf') or ends_with(lower(x.href), '.pdf')))"
    pats = ", ".join(f"regexp_extract_all(html, {fx.literal(p)}, 1)" for p in d.PDF_PATTERNS)
    return f"""with {source.sql('m')}, a as (select *, {anchors} as a from m),
      f as (select page_id, url, flatten([list_transform(list_filter(a, lambda x: {loose}), lambda x: x.href), {pats}, list_transform(list_filter(a, lambda x: {told}), lambda x: x.href)]) as found from a),
      e as (select page_id, url, unnest(found) as href, unnest(range(1, len(found) + 1)) as seq from f), r as (select page_id, seq, {_resolve('url', 'href')} as link from e),
      k as (select page_id, link, min(seq) as seq from r where {_PDF('link')} group by all)
      select page_id, row_number() over (partition by page_id order by seq)::bigint as rank, link from k qualify rank <= 30"""


def _followed_sql() -> str:
    own = _pdfs_sql(CHAIN_).replace("select page_id, row_number()", "own as (select page_id, row_number()", 1).rstrip() + ")"
    own = own.replace("group by all)\n      own as", "group by all),\n      own as", 1)
    return f"""{own}, hr as (select page_id, url, unnest(list_transform(a, lambda x: x.href)) as href from a), st as (select distinct page_id, {_resolve('url', 'href')} as link from hr),
      sx as (select st.page_id, m.page_id as goes from st join m on m.url = st.link and m.page_id <> st.page_id), un as (select page_id, link, 0 as depth from own union all select sx.page_id, own.link, 1 from sx join own on own.page_id = sx.goes)
      select page_id, link, min(depth)::bigint as depth from un group by all"""


_SAFE = "regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g')"
_QUALITY = "least(1.0, (case when {p} between 5 and 50 then 0.3 when {p} > 50 then 0.2 when {p} >= 3 then 0.1 else 0.0 end)::double + {r} * 0.3::double + (case when {c} > 5000 then 0.2 when {c} > 1000 then 0.1 else 0.0 end)::double + (case when length({t}) > 10 then 0.1 else 0.0 end)::double + (case when {a} > 0 then 0.1 else 0.0 end)::double)"
_TITLE = f"coalesce(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)), lambda x: length(x) >= 10 and length(x) < 200 and length(regexp_replace(x, '[^a-zA-Z\\s]', '', 'g')) >= 5 and not {g.any_of('lower(x)', d.TITLE_SKIPS)})[1], '')"

QUERIES = {f.__name__: f for f in (
    author_arrays, metadata_merge, text_profile, quality_by_source, file_names, path_metadata, url_predicates, page_url_priority, source_tests, page_meta, page_links, markup_meta, markup_pdfs, markup_embedded, followed_pdfs,
)}
SQL = {
    "author_arrays": rf"""with {AUTHORS_.sql('a')} select id, array_to_string(list_filter(list_transform(regexp_split_to_array(names, ';|,| and | & |\n'),
      lambda a: trim(regexp_replace(regexp_replace(trim(a), '(?i)^(Dr\.?|Prof\.?|Professor)\s+', ''), '(?i)\s+(Ph\.?D\.?|M\.?D\.?)$', ''))), lambda a: length(a) > 2)[1:10], '|') as authors from a""",
    "metadata_merge": f"""with {RAW_.sql('r')}, p as (select *, regexp_replace(regexp_replace(filename, '(?i)\\.pdf$', ''), '[_-]+', ' ', 'g') as plain from r),
      t as (select *, coalesce(nullif(embedded, ''), nullif(extracted, ''), {_TITLE_CASE.format(x='plain')}) as title, case when chars > 0 then case when images = 0 then case when chars > 1000 then 1.0 else 0.5 end::double else least(1.0::double, chars / (1000 * images)) end end as ratio from p)
      select id, title, round(ratio, 6) as text_ratio, round({_QUALITY.format(p='pages', r='coalesce(ratio, 0.0)', c='chars', t='title', a='n_authors')}, 6) as quality from t""",
    "text_profile": f"""select doc_id, {_TITLE} as title, round(greatest(0.0, least(1.0, 1.0::double - abs(len(regexp_extract_all(text, '\\S+')) / (len(regexp_extract_all(text, '[.!?]+')) + 1) - 15) / 15)), 6) as readability, sha256(text) as content_hash,
      md5(trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as clean_md5,
      md5(case when length(text) < 100 then '' when len(s) <= 3 then case when length(text) > 500 then substr(text, 1, 500) || '...' else text end else array_to_string(s[1:3], ' ') end) as summary_md5
      from (select *, regexp_extract_all(text, '\\s*([^.!?]+[.!?]*)', 1) as s from documents)""",
    "quality_by_source": f"""with q as (select doc_id, source, round({_QUALITY.format(p='ceil(length(text) / 2000)', r='1.0::double', c='length(text)', t=_TITLE, a='0')}, 6) as q from documents)
      select source, count(*) as n_docs, round(avg(q), 6) as avg_q, sum(quality)::bigint as n_good, count(quality) as n_labelled from q left join labels using (doc_id) group by source""",
    "file_names": f"""with {LINKS_.sql('l')}, p as (select *, case when {_PATH.format(x='url')} = '' then '' else {_PATH.format(x='url')} end as path from l),
      b as (select *, regexp_extract(path, '([^/]*)$', 1) as base, regexp_replace(replace(path, '/', '_'), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') as other from p)
      select id, substr(substr('North_Hill_University_Library', 1, 20) || '_' || {_SAFE.format(x="case when ends_with(lower(base), '.pdf') then base when ends_with(lower(other), '.pdf') then other else other || '.pdf' end")}, 1, 100) as name,
      concat_ws('_', 'en', 'physics', substr(case when ends_with(base, '.pdf') then base else regexp_replace(base, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g') || '.pdf' end, 1, 64)) as legacy,
      case when contains(url, 'arxiv.org/abs/') then 'https://arxiv.org/pdf/' || string_split(url, '/abs/')[-1] || '.pdf' when contains(url, 'github.com') and contains(url, '/blob/') then replace(url, '/blob/', '/raw/')
      when contains(url, 'drive.google.com') and contains(url, '/file/d/') then 'https://drive.google.com/uc?export=download&id=' || regexp_extract(url, '/file/d/([^/]*)', 1) else url end as download,
      substr(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g'), 1, 100) as folder from b""",
    "path_metadata": f"""with {fx.meta_sql()}, p as (select *, concat_ws('/', '/data', subject_area, replace(lower(title), ' ', '_')) as path from meta), n as (select *, regexp_extract(path, '([^/]*)$', 1) as name from p)
      select filename, case when {g.any_of('path', ['computer', 'cs'])} then 'computer_science' when contains(path, 'math') then 'mathematics' when contains(path, 'physics') then 'physics' else subject_area end as subject,
      coalesce(array_to_string(list_sort(list_distinct(flatten([keywords, case when contains(name, 'lecture') then ['lecture', 'course material'] else [] end, case when contains(name, 'tutorial') then ['tutorial', 'learning'] else [] end,
      case when contains(name, 'assignment') then ['assignment', 'homework'] else [] end, case when contains(name, 'exam') then ['exam', 'test'] else [] end]))), '|'), '') as keywords, subject_area || '/' || academic_level || '/general' as folder from n""",
    "url_predicates": f"""with {LINKS_.sql('l')}, h as (select *, {_HOST.format(x='url')} = 'www.north.edu' as same from l)
      select id, not {_RX('url', EXCLUDE)} and {_RX('url', INCLUDE)} as wanted, same and not {_ENDS('url', d.PAGE_EXTENSIONS)} and not {g.any_of('lower(url)', d.PAGE_SKIPS)} as page, not {_ENDS('url', d.CRAWL_EXTENSIONS)} as type_ok, {_ACADEMIC} as academic,
      {_RX('lower(url)', _PATHS)} as entry, not {g.any_of('lower(url)', d.CRAWL_SKIPS)} as general, same and not {_ENDS('url', d.CRAWL_EXTENSIONS)} and ({_ACADEMIC} or not {g.any_of('lower(url)', d.CRAWL_SKIPS)}) as crawl, {_PDF('url')} as pdf,
      {_ENDS('url', ['.pdf'])} or {g.any_of('lower(url)', [*d.PDF_QUERY_TERMS, '.pdf?', '.pdf#'])} as loose_pdf, {g.any_of('lower(url)', ['document', 'material', 'resource', 'download', 'file', 'publication', 'paper', 'report', 'lecture', 'course'])} as maybe, {_priority(SUBJECTS)} as priority from h""",
    "page_url_priority": f"select page_id, {_HOST.format(x='url')} as host, {_PATH.format(x='url')} as path, {_priority([])} as priority, not {g.any_of('lower(url)', d.CRAWL_SKIPS)} as general from pages",
    "source_tests": f"""with {fx.meta_sql()}, l as (select *, 'https://' || coalesce(nullif(download_source, ''), 'x.org') as link from meta)
      select filename, {g.any_of(f"lower({_HOST.format(x='link')})", d.SOURCE_DOMAINS)} or coalesce(nullif(subject_area, ''), 'general') <> 'general' or length(institution) > 3 as academic,
      contains(lower(link), '.edu') or {g.any_of('lower(content)', ['dspace', 'eprints', 'digital repository', 'institutional repository', 'thesis', 'dissertation', 'research papers', 'academic publications'])} or {g.any_of('lower(link)', ['/dspace/', '/eprints/', '/repository/', '/digital/', '/ir/'])} as repository,
      title = '' or {g.any_of('lower(title)', d.LANGUAGE_TERMS['es'])} or not {g.any_of('lower(title)', d.LINK_EXCLUDES['es'])} as link_ok from l""",
    "page_meta": f"select page_id, coalesce({_inner('title')}, {_inner('h1')}, '') as title, {_DESC} as description, {_KEYS} as keywords, length({_PAGE_TEXT})::bigint as text_chars from pages",
    "page_links": f"""with a as (select page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href=["''][^"'']*["''][^>]*>.*?</a\\s*>') as a from pages), e as (select page_id, url, unnest(a) as a, unnest(range(0, len(a))) as pos from a),
      h as (select page_id, url, pos, regexp_extract(a, '(?is)href=["'']([^"'']*)["'']', 1) as href, trim({_tag('a')}) as link_text from e) select page_id, pos, href, link_text, {_resolve('url', 'href')} as link from h""",
    "markup_meta": f"""with {MARKUP_.sql('m')}, t as (select *, {_PAGE_TEXT} as txt, {_HOST.format(x='url')} as host, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) as raw from m),
      i as (select *, coalesce(nullif(trim(regexp_extract(txt, '(?i)([^<>\\n]+ university)', 1)), ''), nullif(trim(regexp_extract(txt, '(?i)([^<>\\n]+ college)', 1)), ''), nullif(trim(regexp_extract(txt, '(?i)([^<>\\n]+ institute)', 1)), ''), nullif(trim(regexp_extract(txt, '(?i)university of ([^<>\\n]+)', 1)), '')) as inst,
        regexp_replace(regexp_replace(raw, '\\s*-\\s*.*$', ''), '\\s*\\|\\s*.*$', '') as short, replace(replace(replace(host, 'www.', ''), '.edu', ''), '.org', '') as bare,
        list_transform(regexp_extract_all(html, {fx.literal(d.PDF_PATTERNS[0])}, 1), lambda x: lower(x)) as ls from t)
      select page_id, coalesce({_inner('title')}, {_inner('h1')}, '') as title, {_DESC} as description, {_KEYS} as keywords,
      coalesce({_meta('author')}, nullif(trim(regexp_extract(txt, '(?i)(?:by|author|instructor):\\s*([^<>\\n]+)', 1)), ''), nullif(trim(regexp_extract(txt, '(?i)(?:prof|professor|dr)\\.?\\s+([^<>\\n]+)', 1)), ''), '') as author,
      coalesce({_TITLE_CASE.format(x='inst')}, '') as institution, regexp_extract(txt, '\\b([A-Z]{{2,4}}\\s*\\d{{3,4}}[A-Z]?)\\b', 1) as course_code,
      trim(concat_ws(' ', upper(substr(regexp_extract(txt, '(?i)\\b(fall|spring|summer|winter)\\s+(\\d{{4}})\\b', 1), 1, 1)) || lower(substr(regexp_extract(txt, '(?i)\\b(fall|spring|summer|winter)\\s+(\\d{{4}})\\b', 1), 2)), regexp_extract(txt, '(?i)\\b(fall|spring|summer|winter)\\s+(\\d{{4}})\\b', 2))) as term,
      case when length(short) > 5 then short else {_TITLE_CASE.format(x='bare')} end as site,
      array_to_string(list_sort(list_filter([case when len(list_filter(ls, lambda x: contains(x, 'lecture'))) > 0 then 'lecture.*\\.pdf' end, case when len(list_filter(ls, lambda x: contains(x, 'notes'))) > 0 then 'notes.*\\.pdf' end,
        case when len(list_filter(ls, lambda x: contains(x, 'slides'))) > 0 then 'slides.*\\.pdf' end, case when len(list_filter(ls, lambda x: contains(x, 'homework') or contains(x, 'assignment'))) > 0 then '(homework|assignment).*\\.pdf' end, '\\.pdf$'], lambda x: x is not null)), '|') as patterns from i""",
    "markup_pdfs": _pdfs_sql(),
    "followed_pdfs": _followed_sql(),
    "markup_embedded": f"""with {MARKUP_.sql('m')}, f as (select *, list_concat(regexp_extract_all(html, '(?i)["'']([^"'']*\\.pdf[^"'']*)["'']', 1), regexp_extract_all(html, '(?i)data-[^=]*=["'']([^"'']*\\.pdf[^"'']*)["'']', 1)) as found,
      list_filter(list_concat(regexp_extract_all(html, {fx.literal(d.PDF_PATTERNS[0])}, 1), regexp_extract_all(html, {fx.literal(d.PDF_PATTERNS[1])}, 1)), lambda x: ends_with(x, '.pdf')) as legacy from m)
      select page_id, array_to_string(list_transform(found, lambda h: {_resolve('url', 'h')}), '|') as embedded, array_to_string(legacy, '|') as legacy from f""",
}
