"""Web pages: metadata and links, by regular expressions on the markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.operators import markup as mk
from folioflow.operators import urls as u

TAG = r"(?s)<[^>]*>"


def inner(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, tags inside dropped; null without one."""
    raw = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, TAG, "")), F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, rf"""(?i)<meta[^>]*name=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)), F.lit(""))


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", ""), TAG, "")


def title(html: Column) -> Column:
    return F.coalesce(inner(html, "title"), inner(html, "h1"), F.lit(""))


def description(html: Column) -> Column:
    return F.coalesce(meta_content(html, "description"), F.substring(inner(html, "p"), 1, 200), F.lit(""))


def keywords(html: Column, most: int = 10) -> Column:
    meta = F.transform(F.split(meta_content(html, "keywords"), ","), lambda k: F.trim(k))
    heads = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[123](?:\s[^>]*)?>(.*?)</h[123]\s*>"), 1), lambda h: F.trim(F.regexp_replace(h, TAG, "")))
    return F.slice(F.concat(F.coalesce(meta, F.array().cast("array<string>")), F.filter(heads, lambda h: h != "")), 1, most)


def author(html: Column) -> Column:
    text = page_text(html)
    one = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.coalesce(meta_content(html, "author"), *[one(p) for p in d.AUTHOR_PATTERNS], F.lit(""))


def institution(text: Column, fallback: Column) -> Column:
    """The first pattern that matches; a pattern runs only over texts that hold its word, as it tries every start of a line else."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(word)), F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))) for word, p in d.INSTITUTION_PATTERNS]
    return F.coalesce(tx.title_case(F.coalesce(*found)), fallback)


def course_code(text: Column) -> Column:
    return F.regexp_extract(text, r"\b([A-Z]{2,4}\s*\d{3,4}[A-Z]?)\b", 1)


def term(text: Column) -> Column:
    """Season and year, the season capitalised; empty without one."""
    at = lambda i: F.regexp_extract(text, r"(?i)\b(fall|spring|summer|winter)\s+(\d{4})\b", i)
    return F.trim(F.concat_ws(" ", F.initcap(at(1)), at(2)))


def site_name(html: Column, host: Column) -> Column:
    raw = F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    name = F.regexp_replace(F.regexp_replace(raw, r"\s*-\s*.*$", ""), r"\s*\|\s*.*$", "")
    bare = F.replace(F.replace(F.replace(host, F.lit("www."), F.lit("")), F.lit(".edu"), F.lit("")), F.lit(".org"), F.lit(""))
    return F.when(F.char_length(name) > 5, name).otherwise(tx.title_case(bare))


def file_patterns(html: Column) -> Column:
    """Sorted URL patterns that a site's file links suggest; the plain one always."""
    links = F.transform(F.regexp_extract_all(html, F.lit(d.PDF_PATTERNS[0]), 1), lambda x: F.lower(x))
    some = lambda *ws: F.exists(links, lambda x: tx.any_of(x, ws))
    found = F.array(
        F.when(some("lecture"), r"lecture.*\.pdf"), F.when(some("notes"), r"notes.*\.pdf"), F.when(some("slides"), r"slides.*\.pdf"),
        F.when(some("homework", "assignment"), r"(homework|assignment).*\.pdf"), F.lit(r"\.pdf$"),
    )
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def anchors(html: Column) -> Column:
    """An array of (href, text) of the page's links, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\s[^>]*href=["'][^"']*["'][^>]*>.*?</a\s*>)"""), 1)
    return F.transform(raw, lambda a: F.struct(F.regexp_extract(a, r"""(?is)href=["']([^"']*)["']""", 1).alias("href"), F.trim(F.regexp_replace(a, TAG, "")).alias("text")))


def page_metadata(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    text = page_text(html)
    return pages.select(
        "page_id", title(html).alias("title"), description(html).alias("description"), F.array_join(keywords(html), "|").alias("keywords"), author(html).alias("author"),
        institution(text, F.lit("")).alias("institution"), course_code(text).alias("course_code"), term(text).alias("term"),
    )


def pdf_urls(pages: DataFrame, most: int = 30) -> DataFrame:
    """(page_id, rank, link): PDF links by anchors, markup patterns and link words, first finds first, distinct, `most` for each page."""
    html, base = F.col("html"), F.col("url")
    a = anchors(html)
    direct = F.transform(F.filter(a, lambda x: u.loose_pdf_link(x["href"])), lambda x: x["href"])
    told = F.transform(F.filter(a, lambda x: tx.any_of(F.lower(x["text"]), d.LINK_WORDS) & (F.contains(F.lower(x["text"]), F.lit("pdf")) | F.lower(x["href"]).endswith(".pdf"))), lambda x: x["href"])
    found = F.concat(direct, *[F.regexp_extract_all(html, F.lit(p), 1) for p in d.PDF_PATTERNS], told)
    links = F.array_distinct(F.filter(F.transform(found, lambda h: u.resolve(base, h)), u.pdf_link))
    rows = pages.select("page_id", F.posexplode(F.slice(links, 1, most)).alias("rank", "link"))
    return rows.select("page_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "link")


def embedded_urls(html: Column, base: Column) -> Column:
    """Quoted file URLs anywhere in the markup, then those of data attributes, resolved."""
    found = F.concat(F.regexp_extract_all(html, F.lit(r"""(?i)["']([^"']*\.pdf[^"']*)["']"""), 1), F.regexp_extract_all(html, F.lit(r"""(?i)data-[^=]*=["']([^"']*\.pdf[^"']*)["']"""), 1))
    return F.transform(found, lambda h: u.resolve(base, h))


def legacy_links(html: Column) -> Column:
    return F.filter(F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in d.PDF_PATTERNS[:2]]), lambda x: x.endswith(".pdf"))


def followed_pdf_urls(pages: DataFrame, most: int = 30) -> DataFrame:
    """(page_id, link, depth): PDF links of each page, depth 0, and of the pages among these that it links to, depth 1; each link once, at its least depth."""
    own = pdf_urls(pages, most)
    known = pages.select(F.col("page_id").alias("to"), F.col("url").alias("to_url"))
    steps = mk.page_links(pages).select("page_id", "link").distinct().join(known, F.col("link") == F.col("to_url")).where("page_id <> to").select("page_id", "to")
    further = steps.join(own.select(F.col("page_id").alias("of"), "link"), F.col("to") == F.col("of")).select("page_id", "link", F.lit(1).alias("depth"))
    return own.select("page_id", "link", F.lit(0).alias("depth")).union(further).groupBy("page_id", "link").agg(F.min("depth").alias("depth"))
