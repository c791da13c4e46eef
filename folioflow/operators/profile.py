"""Derived columns of a document: title, authors, quality, hashes, names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx


def parse_authors(names: Column) -> Column:
    """Split on ; , and & and line ends; titles and degrees dropped; names of over two characters, ten at most."""
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), r";|,| and | & |\n"), lambda a: F.trim(a))
    bare = F.transform(parts, lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, r"(?i)^(Dr\.?|Prof\.?|Professor)\s+", ""), r"(?i)\s+(Ph\.?D\.?|M\.?D\.?)$", "")))
    return F.slice(F.filter(bare, lambda a: F.char_length(a) > 2), 1, 10)


def title_from_text(text: Column) -> Column:
    """The first of ten lines that looks like a title, else empty."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10), lambda x: F.trim(x))

    def good(x: Column) -> Column:
        letters = F.char_length(F.regexp_replace(x, r"[^a-zA-Z\s]", ""))
        return (F.char_length(x) >= 10) & (F.char_length(x) < 200) & (letters >= 5) & ~tx.any_of(F.lower(x), d.TITLE_SKIPS)

    return F.coalesce(F.get(F.filter(lines, good), F.lit(0)), F.lit(""))


def pretty_filename(name: Column) -> Column:
    return tx.title_case(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"[_-]+", " "))


def merged_title(embedded: Column, extracted: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(embedded, F.lit("")), F.nullif(extracted, F.lit("")), pretty_filename(filename))


def text_ratio(chars: Column, images: Column) -> Column:
    """Null without text; without images 1 for over 1000 characters, else a half; else characters per 1000 for each image, 1 at most."""
    bare = F.when(chars > 1000, 1.0).otherwise(0.5)
    return F.when(chars > 0, F.when(images == 0, bare).otherwise(F.least(F.lit(1.0), chars / (1000 * images))))


def quality_score(pages: Column, ratio: Column, chars: Column, title: Column, n_authors: Column) -> Column:
    s = F.when(pages.between(5, 50), 0.3).when(pages > 50, 0.2).when(pages >= 3, 0.1).otherwise(0.0) + ratio * 0.3
    s = s + F.when(chars > 5000, 0.2).when(chars > 1000, 0.1).otherwise(0.0) + F.when(F.char_length(title) > 10, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), s + F.when(n_authors > 0, 0.1).otherwise(0.0))


def sentence_readability(text: Column) -> Column:
    """1 at 15 words for each piece between closing marks, falling to 0; the piece after the last mark counts."""
    pieces = F.regexp_count(text, F.lit(r"[.!?]+")) + 1
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(words / pieces - 15) / 15))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def summary(text: Column, sentences: int = 3) -> Column:
    """Empty under 100 characters; the first sentences; a text of no more sentences is cut at 500 characters."""
    whole = F.regexp_extract_all(text, F.lit(r"\s*([^.!?]+[.!?]*)"), 1)
    cut = F.when(F.char_length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    return F.when(F.char_length(text) < 100, "").when(F.size(whole) <= sentences, cut).otherwise(F.array_join(F.slice(whole, 1, sentences), " "))


def safe_filename(url: Column, source: Column) -> Column:
    """Source prefix of 20 characters and a name from the URL's path, 100 characters at most."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    own = F.lower(base).endswith(".pdf")
    other = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), r"[^\p{L}\p{N}_.-]", "_")
    made = F.when(F.lower(other).endswith(".pdf"), other).otherwise(F.concat(other, F.lit(".pdf")))
    name = F.regexp_replace(F.when(own, base).otherwise(made), r"[^\p{L}\p{N}_.-]", "_")
    prefix = F.substring(F.regexp_replace(source, r"[^\p{L}\p{N}_]", "_"), 1, 20)
    return F.substring(F.concat(prefix, F.lit("_"), name), 1, 100)


def legacy_filename(url: Column, language: Column, field: Column) -> Column:
    base = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]*)$", 1)
    name = F.when(base.endswith(".pdf"), base).otherwise(F.concat(F.regexp_replace(base, r"[^\p{L}\p{N}_]+", "_"), F.lit(".pdf")))
    return F.concat_ws("_", language, field, F.substring(name, 1, 64))


def download_url(url: Column) -> Column:
    """Abstract pages, code views and share links to the file itself."""
    return (
        F.when(F.contains(url, F.lit("arxiv.org/abs/")), F.concat(F.lit("https://arxiv.org/pdf/"), F.element_at(F.split(url, "/abs/"), -1), F.lit(".pdf")))
        .when(F.contains(url, F.lit("github.com")) & F.contains(url, F.lit("/blob/")), F.replace(url, F.lit("/blob/"), F.lit("/raw/")))
        .when(F.contains(url, F.lit("drive.google.com")) & F.contains(url, F.lit("/file/d/")), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), F.regexp_extract(url, r"/file/d/([^/]*)", 1)))
        .otherwise(url)
    )


def subject_from_path(path: Column, subject: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.lit(False), "")
    for name, terms in d.PATH_SUBJECTS:
        out = out.when(tx.any_of(low, terms), name)
    return out.otherwise(subject)


def keywords_from_path(path: Column, keywords: Column) -> Column:
    """Sorted distinct keywords with those that the file's name suggests."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    added = F.flatten(F.filter(F.array(*[F.when(F.contains(name, F.lit(k)), F.array(*map(F.lit, v))) for k, v in d.NAME_KEYWORDS]), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(F.concat(keywords, added)))


def folder_path(subject: Column, level: Column, topic: Column) -> Column:
    return F.concat_ws("/", subject, level, topic)


def safe_folder(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.translate(name, '<>:"/\\|?*', "_" * 9), r"\s+", "_"), 1, 100)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
