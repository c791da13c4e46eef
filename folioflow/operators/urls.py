"""URL predicates and priorities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.operators.scoring import total


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [url.rlike("(?i)" + p) for p in patterns], F.lit(False))


def ends_with_any(url: Column, endings: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(url).endswith(e) for e in endings], F.lit(False))


def wanted_file(url: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Exclude patterns win over include patterns; both are searched without regard to case."""
    return ~matches_any(url, exclude) & matches_any(url, include)


def crawlable_page(url: Column, base: Column) -> Column:
    return (host(url) == host(base)) & ~ends_with_any(url, d.PAGE_EXTENSIONS) & ~tx.any_of(F.lower(url), d.PAGE_SKIPS)


def crawlable_type(url: Column) -> Column:
    return ~ends_with_any(url, d.CRAWL_EXTENSIONS)


def academic_url(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike("|".join(p for group in d.ACADEMIC_PATHS.values() for p in group)) | tx.any_of(low, d.ACADEMIC_URL_TERMS)


def entry_point(url: Column) -> Column:
    return F.lower(url).rlike("|".join(p for group in d.ACADEMIC_PATHS.values() for p in group))


def generally_crawlable(url: Column) -> Column:
    return ~tx.any_of(F.lower(url), d.CRAWL_SKIPS)


def should_crawl(url: Column, base: Column) -> Column:
    """Of the base's host, of a crawlable type, and academic or on no skip list; seen and disallowed URLs go by anti joins."""
    return (host(url) == host(base)) & crawlable_type(url) & (academic_url(url) | generally_crawlable(url))


def pdf_link(url: Column) -> Column:
    """An absolute URL that names a PDF by its path, query or site."""
    low = F.lower(url)
    named = F.lower(path(url)).endswith(".pdf") | tx.any_of(F.lower(query(url)), d.PDF_QUERY_TERMS) | tx.any_of(low, d.PDF_URL_TERMS)
    return (host(url) != "") & ~tx.any_of(low, d.NO_PDF_LINK) & named


def loose_pdf_link(href: Column) -> Column:
    low = F.lower(href)
    return low.endswith(".pdf") | tx.any_of(low, [*d.PDF_QUERY_TERMS, ".pdf?", ".pdf#"])


def maybe_holds_pdfs(url: Column) -> Column:
    return tx.any_of(F.lower(url), ["document", "material", "resource", "download", "file", "publication", "paper", "report", "lecture", "course"])


def academic_source(base_url: Column, subjects: Column, institution: Column) -> Column:
    other = F.exists(F.coalesce(subjects, F.array().cast("array<string>")), lambda s: s != "general")
    return tx.any_of(F.lower(host(base_url)), d.SOURCE_DOMAINS) | other | (F.char_length(F.coalesce(institution, F.lit(""))) > 3)


def repository_page(content: Column, url: Column) -> Column:
    words = ["dspace", "eprints", "digital repository", "institutional repository", "thesis", "dissertation", "research papers", "academic publications"]
    return F.contains(F.lower(url), F.lit(".edu")) | tx.any_of(F.lower(content), words) | tx.any_of(F.lower(url), ["/dspace/", "/eprints/", "/repository/", "/digital/", "/ir/"])


def academic_link_text(text: Column, language: str) -> Column:
    low = F.lower(text)
    return (F.coalesce(text, F.lit("")) == "") | tx.any_of(low, d.LANGUAGE_TERMS.get(language, [])) | ~tx.any_of(low, d.LINK_EXCLUDES.get(language, []))


def priority(url: Column, subjects: Sequence[str] = ()) -> Column:
    low = F.lower(url)
    parts = [low.rlike(p).cast("int") * n for n, group in d.PRIORITY_PATHS for p in group]
    parts += [tx.any_of(low, [s.replace("_", " "), s.replace("_", "-")]).cast("int") * 3 for s in subjects]
    depth = F.size(F.filter(F.split(path(url), "/"), lambda p: p != ""))
    return (total(parts) - F.greatest(F.lit(0), depth - 3)).cast("bigint")


def resolve(base: Column, href: Column) -> Column:
    """A link against its page: absolute, scheme-relative, root-relative, fragment or query only, and relative with . and .. steps."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    rel = F.concat(F.when(folder == "", "/").otherwise(folder), href)
    tail = F.regexp_extract(rel, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(rel, r"[?#].*$", ""), "/")

    def step(seen: Column, p: Column) -> Column:
        up = F.when(F.size(seen) > 1, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen)
        return F.when(p == "..", up).when(p == ".", seen).otherwise(F.concat(seen, F.array(p)))

    last = F.element_at(parts, -1)
    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    slash = F.when(last.isin(".", ".."), "/").otherwise("")
    bare = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", bare)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(bare, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), href))
        .otherwise(F.concat(root, F.array_join(clean, "/"), slash, tail))
    )
