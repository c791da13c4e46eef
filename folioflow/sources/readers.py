"""Readers: source registries, PDF files, repository replies, sitemaps, CSV metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.operators import urls as u
from folioflow.operators.scoring import category_subjects

SOURCE = (
    "name string, base_url string, description string, scraping_strategy string, rate_limit double, max_depth int, pdf_patterns array<string>, exclude_patterns array<string>, subject_areas array<string>, "
    "languages array<string>, academic_levels array<string>, is_active boolean, priority int, last_crawled timestamp_ntz, headers map<string,string>, auth_required boolean, api_key string, "
    "concurrent_downloads int, timeout int, retry_attempts int, min_file_size bigint, max_file_size bigint, min_pages int, institution string, country string, source_type string"
)
STRATEGIES = ["static_html", "dynamic_javascript", "api_endpoint", "rss_feed"]
#: Two sources for a registry that is missing or can't be read.
FALLBACK = [{"name": "Open Courses", "base_url": "https://courses.example.org"}, {"name": "Preprints", "base_url": "https://preprints.example.org", "scraping_strategy": "api_endpoint"}]
DEFAULTS = {
    "scraping_strategy": "static_html", "rate_limit": 1.0, "max_depth": 3, "is_active": True, "priority": 1, "auth_required": False, "concurrent_downloads": 5, "timeout": 30, "retry_attempts": 3,
    "min_file_size": 1024, "max_file_size": 100 * 1024 * 1024, "min_pages": 5,
}


def simple_yaml(text: str) -> dict:
    """The subset of YAML that registries use: nested maps by indent, lists of scalars, quoted or plain scalars."""

    def scalar(s: str):  # noqa: ANN202
        s = s.strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        plain = {"true": True, "false": False, "null": None, "~": None, "": None}
        if s.lower() in plain:
            return plain[s.lower()]
        if re.fullmatch(r"-?\d+", s):
            return int(s)
        return float(s) if re.fullmatch(r"-?\d+\.\d*", s) else s

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(i: int, indent: int):  # noqa: ANN202
        if i < len(lines) and lines[i][1].startswith("- "):
            items = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                items.append(scalar(lines[i][1][2:]))
                i += 1
            return items, i
        out: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[key.strip("\"' ")] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][1].startswith("- ") and lines[i][0] == indent):
                out[key.strip("\"' ")], i = block(i, lines[i][0])
            else:
                out[key.strip("\"' ")] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def registry(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """Sources of a YAML or JSON registry; entries with a bad strategy, level or time are dropped, and a registry that can't be read gives FALLBACK."""
    try:
        data = json.loads(text) if kind == "json" else simple_yaml(text)
        entries = list(data.values()) if isinstance(data, dict) else list(data)
    except (ValueError, AttributeError, IndexError):
        entries = FALLBACK
    names = [x.split()[0] for x in SOURCE.split(", ")]

    def good(e: object) -> bool:
        if not isinstance(e, dict) or not e.get("name") or not e.get("base_url") or set(e) - {*names}:
            return False
        levels = e.get("academic_levels") or []
        return (e.get("scraping_strategy") or "static_html") in STRATEGIES and all(x in d.LEVELS for x in levels) and (not e.get("last_crawled") or not pd.isna(pd.to_datetime(str(e["last_crawled"]), errors="coerce")))

    rows = []
    for e in filter(good, entries):
        full = DEFAULTS | {k: v for k, v in e.items() if v is not None}
        full["last_crawled"] = pd.to_datetime(str(full["last_crawled"])).to_pydatetime().replace(tzinfo=None) if full.get("last_crawled") else None
        full |= {k: float(full[k]) for k in ("rate_limit",)}
        rows.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(rows, SOURCE)


def registry_rows(rows: DataFrame, entry: str) -> DataFrame:
    """Sources of a registry of JSON entries, one a row: a broken entry, one without name or address, or with a strategy, level or time that is none, is dropped; what is missing takes the default."""
    kinds = [x.split() for x in SOURCE.split(", ")]
    raw = ", ".join(f"{n} {'string' if n == 'last_crawled' else t}" for n, t in kinds)
    e = F.from_json(entry, raw, {"mode": "PERMISSIVE"})
    s = rows.select(e.alias("e")).select("e.*")
    when = F.try_to_timestamp("last_crawled")
    good = F.col("name").isNotNull() & F.col("base_url").isNotNull() & F.coalesce(F.col("scraping_strategy").isin(STRATEGIES), F.lit(True)) & (F.col("last_crawled").isNull() | when.isNotNull())
    good &= F.coalesce(F.forall("academic_levels", lambda x: x.isin(d.LEVELS)), F.lit(True))
    s = s.where(good).withColumn("last_crawled", when.cast("timestamp_ntz"))
    return s.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in DEFAULTS.items()})


def candidate_title(text: Column, title: Column, least: int = 10) -> Column:
    """The file's own title, else the first line of its text that could be one."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.char_length(F.trim(x)).between(least, 200)), F.lit(0))
    return F.coalesce(F.when(title != "", title), F.trim(line), F.lit(""))


def detected_charset(content: Column, header: Column) -> Column:
    """The header's charset; without one, UTF-8 if the bytes are valid in it, else ISO-8859-1, in which all are."""
    return F.coalesce(header, F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files *.pdf below a folder, hidden ones left out: path, filename, length, head, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("filename", name).where(~name.startswith(".")).withColumn("head", F.decode(F.substring("content", 1, 4), "ISO-8859-1"))


PDF = "path string, filename string, file_size bigint, content_hash string, pages int, encrypted boolean, images int, title string, author string, text string"


def pdf_profile(files: DataFrame) -> DataFrame:
    """Information that a PDF shows without a rendering library: pages, encryption, images, title, author, and text of plain or deflated streams."""

    def one(content: bytes) -> tuple[int, bool, int, str, str, str]:
        import zlib

        body = content.decode("latin-1")
        pages = len(re.findall(r"/Type\s*/Page(?![a-zA-Z])", body))
        field = lambda k: (re.search(rf"/{k}\s*\(((?:\\.|[^\\)])*)\)", body) or [None, ""])[1].replace("\\(", "(").replace("\\)", ")")
        texts = []
        for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
            raw = m[1]
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                pass
            texts += [x.decode("latin-1").replace("\\(", "(").replace("\\)", ")") for x in re.findall(rb"\(((?:\\.|[^\\)])*)\)\s*Tj", raw)]
        return pages, "/Encrypt" in body, len(re.findall(r"/Subtype\s*/Image", body)), field("Title"), field("Author"), "\n".join(texts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for p in parts:
            found = [(*r, len(c), hashlib.sha256(c).hexdigest(), *one(c)) for *r, c in p[["path", "filename", "content"]].itertuples(index=False)]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in PDF.split(", ")])

    return files.select("path", "filename", "content").mapInPandas(run, PDF)


def decoded(content: Column, charset: Column) -> Column:
    """Bytes to text by a known charset, UTF-8 otherwise; bytes that don't fit become replacement marks."""
    out = F.when(F.lower(charset) == "iso-8859-1", F.decode(content, "ISO-8859-1")).when(F.lower(charset) == "utf-16", F.decode(content, "UTF-16")).when(F.lower(charset) == "us-ascii", F.decode(content, "ISO-8859-1"))
    return out.otherwise(F.coalesce(F.try_validate_utf8(content.cast("string")), F.make_valid_utf8(content.cast("string"))))


ATOM = r"(?is)<{0}(?:\s[^>]*)?>(.*?)</{0}\s*>"


def atom_papers(replies: DataFrame, pdf_base: str = "https://arxiv.org/pdf/") -> DataFrame:
    """Rows (feed) of Atom XML to papers: title, abstract, authors, paper_id, categories, subjects, published, pdf_url."""
    entry = F.explode(F.regexp_extract_all("feed", F.lit(r"(?is)<entry(?:\s[^>]*)?>(.*?)</entry\s*>"), 1)).alias("e")
    e = F.col("e")
    tag = lambda t: F.trim(F.regexp_extract(e, ATOM.format(t), 1))
    cats = F.regexp_extract_all(e, F.lit(r"""(?i)<category[^>]*term=["']([^"']*)["']"""), 1)
    link = F.get(F.filter(F.regexp_extract_all(e, F.lit(r"(?i)(<link[^>]*>)"), 1), lambda x: F.contains(x, F.lit("application/pdf"))), F.lit(0))
    rows = replies.select(entry).select(
        tag("title").alias("title"), tag("summary").alias("abstract"), F.transform(F.regexp_extract_all(e, F.lit(ATOM.format("name")), 1), lambda n: F.trim(n)).alias("authors"),
        F.element_at(F.split(tag("id"), "/"), -1).alias("paper_id"), cats.alias("categories"), tag("published").alias("published"), F.regexp_extract(link, r"""href=["']([^"']*)["']""", 1).alias("link"),
    )
    url = F.when(F.coalesce("link", F.lit("")) != "", F.col("link")).otherwise(F.concat(F.lit(pdf_base), F.col("paper_id"), F.lit(".pdf")))
    return rows.withColumns({"pdf_url": url, "subject_areas": category_subjects(F.col("categories"))}).drop("link")


DSPACE = "items array<struct<metadata:map<string,array<struct<value:string>>>,bitstreams:array<struct<uuid:string,name:string,mimeType:string>>>>"
EPRINTS = "items array<struct<title:string,creators:array<struct<name:string>>,abstract:string,keywords:string,documents:array<struct<mime_type:string,uri:string>>>>"


def dspace_papers(replies: DataFrame, base_url: str) -> DataFrame:
    """Rows (reply) of JSON to papers; items without a title are dropped."""
    item = F.explode(F.from_json("reply", f"struct<{DSPACE.replace(' ', ':', 1)}>")["items"]).alias("i")
    meta = F.col("i.metadata")
    values = lambda k: F.transform(meta[k], lambda v: v["value"])
    pdf = F.get(F.filter("i.bitstreams", lambda b: b["mimeType"] == "application/pdf"), F.lit(0))
    rows = replies.select(item).select(
        F.get(values("dc.title"), F.lit(0)).alias("title"), values("dc.creator").alias("authors"), F.get(values("dc.description.abstract"), F.lit(0)).alias("abstract"), values("dc.subject").alias("keywords"),
        F.when(pdf.isNotNull(), F.concat(F.lit(base_url + "/bitstream/"), pdf["uuid"], F.lit("/"), pdf["name"])).alias("pdf_url"), F.lit("dspace").alias("repository_type"),
    )
    return rows.where("title <> ''")


def eprints_papers(replies: DataFrame) -> DataFrame:
    item = F.explode(F.from_json("reply", f"struct<{EPRINTS.replace(' ', ':', 1)}>")["items"]).alias("i")
    pdf = F.get(F.filter("i.documents", lambda x: x["mime_type"] == "application/pdf"), F.lit(0))
    words = F.when(F.coalesce("i.keywords", F.lit("")) != "", F.split("i.keywords", ",")).otherwise(F.array().cast("array<string>"))
    rows = replies.select(item).select(F.col("i.title").alias("title"), F.transform("i.creators", lambda c: c["name"]).alias("authors"), F.col("i.abstract").alias("abstract"), words.alias("keywords"), pdf["uri"].alias("pdf_url"), F.lit("eprints").alias("repository_type"))
    return rows.where("title <> ''")


def recent_papers(papers: DataFrame, now: Column, days: int) -> DataFrame:
    """Published within some days of a time; times without a zone on both sides."""
    return papers.where(F.to_timestamp_ntz(F.regexp_replace("published", "Z$", "")) >= now - F.expr(f"interval {days} days"))


def federated(*papers: DataFrame) -> DataFrame:
    """All repositories' papers, each with the columns that any has."""
    out = papers[0]
    for p in papers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """Rows (location, xml) to (location, url, is_index): each <loc>, and whether the file is an index of sitemaps."""
    loc = F.explode(F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.trim(x))).alias("url")
    return sitemaps.select("location", loc, F.lower("xml").contains("<sitemapindex").alias("is_index"))


def search_results(pages: DataFrame, item: str, title: str) -> DataFrame:
    """(title, link, citations) of result pages (url, html), items and titles being cut out by patterns with one group."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(item), 1)).alias("i"))
    strip = lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    href = F.regexp_extract("i", r"""(?i)href=["']([^"']*)["']""", 1)
    return rows.select(strip(F.regexp_extract("i", title, 1)).alias("title"), u.resolve(F.col("url"), href).alias("link"), F.regexp_extract("i", r"Cited by (\d+)", 1).try_cast("int").alias("citations")).where("title <> ''")


def legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="filename string, language string, field string, url string, source string, hash string, size bigint, title string, excerpt string")
