"""API replies and whole sites: file links in JSON and XML, field mapping, navigation links, source profiles."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import markup as mk
from folioflow.operators import pages as pg
from folioflow.operators import scoring as sc
from folioflow.operators import urls as u

LINK_KEYS = frozenset(["pdf_url", "download_url", "file_url"])
FIELDS = {
    "title": ["title", "name", "subject"], "author": ["author", "creator", "authors"], "description": ["description", "abstract", "summary"], "keywords": ["keywords", "tags", "subjects"],
    "institution": ["institution", "publisher", "source"],
}
NAV_WORDS = ["courses", "classes", "academics", "departments", "faculty", "research", "publications", "resources", "materials", "library"]


def json_links(reply: str) -> list[str]:
    """Values ending in .pdf under a link key at any depth, in order; none if the reply is no JSON."""
    try:
        todo = [json.loads(reply)]
    except (TypeError, ValueError):
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            below = []
            for k, v in x.items():
                if k.lower() in LINK_KEYS and isinstance(v, str):
                    below.append((v,))
                else:
                    below.append(v)
            todo += reversed(below)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, tuple) and x[0].endswith(".pdf"):
            out.append(x[0])
    return out


def links_in_json(replies: DataFrame, key: str = "id", reply: str = "reply") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "links": p[reply].map(json_links)})

    return replies.select(key, reply).mapInPandas(run, f"{key} {dict(replies.dtypes)[key]}, links array<string>")


def links_in_xml(xml: Column) -> Column:
    """Texts and attribute values that end in .pdf, texts first."""
    return F.concat(F.regexp_extract_all(xml, F.lit(r">([^<>]*\.pdf)<"), 1), F.regexp_extract_all(xml, F.lit(r"""=["']([^"'<>]*\.pdf)["']"""), 1))


def mapped_fields(reply: Column) -> dict[str, Column]:
    """Each field from the first of its keys that the JSON holds."""
    return {f: F.coalesce(*[F.get_json_object(reply, f"$.{k}") for k in keys]) for f, keys in FIELDS.items()}


def navigation_links(pages: DataFrame, words: Sequence[str] = NAV_WORDS) -> DataFrame:
    """(page_id, pos, link): links in <nav> elements, and in others of a navigation class or id, whose text holds one of the words, by default an academic section."""
    return mk.navigation_links(pages, tx.any_of(F.lower("link_text"), list(words)))


def source_profiles(pages: DataFrame) -> DataFrame:
    """A source row for each site's first page: name, description, strategy, file patterns, subjects, institution, whether academic or a repository."""
    html, host = F.col("html"), u.host(F.col("url"))
    firsts = pages.where("html is not null").withColumn("domain", host).groupBy("domain").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p")).select("domain", "p.*")
    subjects = sc.labels_of(html, F.col("url"))
    place = pg.institution(F.col("html"), tx.title_case(F.replace("domain", F.lit("www."), F.lit(""))))
    return firsts.select(
        "domain", F.col("url").alias("base_url"), pg.site_name(html, F.col("domain")).alias("name"), F.coalesce(pg.meta_content(html, "description"), F.lit("")).alias("description"), sc.scraping_strategy(html).alias("scraping_strategy"),
        pg.file_patterns(html).alias("pdf_patterns"), subjects.alias("subject_areas"), place.alias("institution"), u.repository_page(html, F.col("url")).alias("is_repository"), u.academic_source(F.col("url"), subjects, place).alias("is_academic"),
    )
