"""Elements of HTML pages by nesting: tags and texts as rows, opening and closing ones matched by running sums of depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import urls as u

#: Comments, scripts and styles whole, tags with quoted values, stretches of text, and a < that opens nothing.
TOKEN = (
    r"""(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|</?[a-z][^\s/>"'<]*+(?:"[^"]*+"|'[^']*+'|[^>"']++){0,400}+>|[^<]++|<"""
)
#: Elements without content, which nothing closes.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that can't hold one of their own kind: the next one closes the last.
FLAT = ("a", "option", "p")
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in double, single or no quotes; null without it."""
    at = rf"""(?is)^<[^\s>]+(?:\s+[^\s"'>=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|\s*/)*?\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.regexp_extract(tag, at, 1)
    return F.when(raw != "", F.regexp_replace(raw, r"""^["']|["']$""", ""))


def unescaped(text: Column) -> Column:
    """The named entities of every page and decimal ones of ASCII as characters."""
    for n in (34, 38, 39, 60, 62):
        text = F.replace(text, F.lit(f"&#{n};"), F.lit(chr(n)))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def tokens(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """`keep`, _row, n, token, name, kind: a row for each tag and text of a page in order; kind is open, close, void or text. _row tells pages apart, also such as repeat an id. A null page has none."""
    rows = pages.select(*keep, F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)).alias("_tokens"))
    rows = rows.select(*keep, "_row", F.posexplode("_tokens").alias("n", "token"))
    name = F.lower(F.regexp_extract("token", r"""^</?([a-zA-Z][^\s/>"'<]*)""", 1))
    rows = rows.withColumn("name", name).where(~F.startswith("token", F.lit("<!--")) & ~F.col("name").isin("script", "style"))
    kind = F.when(F.col("name") == "", "text").when(F.startswith("token", F.lit("</")), "close").when(F.col("name").isin(*VOID), "void").otherwise("open")
    return rows.withColumn("kind", kind)


def elements(rows: DataFrame, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """`keep`, _row, n, name, token, end: elements of these names with the place of the tag that closes them, or null if none does.

    Of each name, opening tags add one to the depth and closing ones take one, but never below none: a
    closing tag too many is left out. The tag that closes an element is the next one of its depth.
    Windows hold the tags of these names of one page.
    """
    tags = rows.where(F.col("name").isin(*names) & F.col("kind").isin("open", "close"))
    by = Window.partitionBy("_row", "name").orderBy("n")
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    tags = tags.withColumn("_sum", F.sum(step).over(by))
    tags = tags.withColumn("_floor", F.least(F.lit(0), F.min("_sum").over(by))).withColumn("_before", F.coalesce(F.lag("_floor").over(by), F.lit(0)))
    tags = tags.where((F.col("kind") == "open") | (F.col("_floor") == F.col("_before")))
    flat = F.col("name").isin(*FLAT)
    depth = F.when(flat, 0).otherwise(F.col("_sum") - F.col("_floor") + F.when(F.col("kind") == "close", 1).otherwise(0))
    tags = tags.withColumn("_depth", depth)
    return tags.withColumn("end", F.lead("n").over(Window.partitionBy("_row", "name", "_depth").orderBy("n"))).where("kind = 'open'").select(*keep, "_row", "n", "name", "token", "end")


def links(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep`, _row, n, href, link_text of the links in rows of tokens; the text is that of all elements inside, up to the closing tag or the next link."""
    some = rows.where((F.col("kind") == "text") | (F.col("name") == "a"))
    last = F.last(F.when(F.col("name") == "a", F.struct("n", "kind", "token")), ignorenulls=True).over(Window.partitionBy("_row").orderBy("n"))
    inside = some.withColumn("_a", last).where("_a.kind = 'open'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("n", "token")))), lambda x: x["token"]), "")
    out = inside.groupBy("_row", F.col("_a.n").alias("n")).agg(*[F.first(c).alias(c) for c in keep], F.first("_a.token").alias("_tag"), F.trim(text).alias("link_text"))
    return out.withColumn("href", attribute(F.col("_tag"), "href")).where("href is not null").select(*keep, "_row", "n", "href", "link_text")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, link_text, link): a row for each link, resolved against the page; pages without links give none."""
    found = links(tokens(pages, ["page_id", "url"]), ["page_id", "url"])
    pos = F.row_number().over(Window.partitionBy("_row").orderBy("n")) - 1
    return found.select("page_id", pos.cast("bigint").alias("pos"), "href", "link_text", u.resolve(F.col("url"), unescaped(F.col("href"))).alias("link"))


#: Elements other than <nav> that are navigation if their class or id says so.
NAV_HOLDERS = ("div", "ul", "menu", "section", "header")
NAV_NAMES = r"(?is)\b(?:navigation|menu|navbar|nav)\b"


def navigation_links(pages: DataFrame, wanted: Column) -> DataFrame:
    """(page_id, pos, link): links inside <nav> elements, then those in others of a navigation class or id, at any depth, of which `wanted`, over link_text, holds; each link of a page once."""
    keep = ["page_id", "url"]
    rows = tokens(pages, keep)
    spans = elements(rows, keep, ["nav", *NAV_HOLDERS])
    named = F.concat_ws(" ", attribute(F.col("token"), "class"), attribute(F.col("token"), "id")).rlike(NAV_NAMES)
    spans = spans.withColumn("_turn", F.when(F.col("name") == "nav", 0).when(named, 1)).where("_turn is not null")
    edges = F.explode(F.array(F.struct("n", F.lit(1).alias("step")), F.struct(F.coalesce("end", F.lit(1 << 30)).alias("n"), F.lit(-1).alias("step"))))
    no_link = [F.lit(None).cast("string").alias(c) for c in ("href", "link_text")]
    marks = spans.select(*keep, "_row", "_turn", edges.alias("_e")).select(*keep, "_row", "_turn", F.col("_e.n").alias("n"), *no_link, F.col("_e.step").alias("_step"))
    found = links(rows, keep).select(*keep, "_row", F.explode(F.array(F.lit(0), F.lit(1))).alias("_turn"), "n", "href", "link_text", F.lit(0).alias("_step"))
    open_ = F.sum("_step").over(Window.partitionBy("_row", "_turn").orderBy("n"))
    inside = marks.unionByName(found).withColumn("_open", open_).where("_step = 0 and _open > 0").where(wanted)
    once = inside.groupBy("_row", u.resolve(F.col("url"), unescaped(F.col("href"))).alias("link")).agg(F.first("page_id").alias("page_id"), F.min(F.struct("_turn", "n")).alias("_at"))
    return once.select("page_id", (F.row_number().over(Window.partitionBy("_row").orderBy("_at")) - 1).alias("pos"), "link")
