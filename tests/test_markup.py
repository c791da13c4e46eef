"""Elements of pages that regular expressions get wrong."""

import html as plain
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioflow.operators import markup as mk

COLUMNS = "page_id long, url string, html string"
BASE = "http://e.org/d/"


def links(spark, *pages):
    rows = spark.createDataFrame([(i, BASE, h) for i, h in enumerate(pages)], COLUMNS)
    out = {}
    for r in mk.page_links(rows).orderBy("page_id", "pos").collect():
        out.setdefault(r["page_id"], []).append((r["href"], r["link_text"]))
    return [out.get(i, []) for i in range(len(pages))]


def test_links(spark):
    got = links(
        spark, '<a href="x">one <b>two</b><!-- <a href="no">no</a> --></a><A class=q HREF=y?a=1>three</A>', "<a href='q'>open <a href='r'>next</a> after", '<a name="n">no</a><a data-href="d" href = "z">yes</a>',
        "<script>var a = '<a href=\"s\">s</a>';</script><a href='t' title=\"a > b\">u</a>", "<a href='m&amp;n'>&lt;</a>", "a < b <a href=v>w</a >", None, "",
    )
    assert got == [[("x", "one two"), ("y?a=1", "three")], [("q", "open"), ("r", "next")], [("z", "yes")], [("t", "u")], [("m&amp;n", "&lt;")], [("v", "w")], [], []]


def test_entities_of_a_link_are_characters(spark):
    rows = spark.createDataFrame([(1, BASE, "<a href='/m?a=1&amp;b=&#39;2&quot;'>x</a>")], COLUMNS)
    assert mk.page_links(rows).first()["link"] == "http://e.org/m?a=1&b='2\""


def spans(spark, html, *names):
    rows = mk.tokens(spark.createDataFrame([(1, BASE, html)], COLUMNS), ["page_id"])
    return [(r["name"], r["n"], r["end"]) for r in mk.elements(rows, ["page_id"], names).orderBy("n").collect()]


def test_nesting(spark):
    assert spans(spark, "<div><div></div><div><p></div></div></div><div>", "div") == [("div", 0, 6), ("div", 1, 2), ("div", 3, 5), ("div", 8, None)]
    assert spans(spark, "</ul><ul><li>a<ul><li>b</ul></ul></ul>", "ul") == [("ul", 1, 8), ("ul", 4, 7)]
    assert spans(spark, "<p>a<p>b</p><br><br/>", "p", "br") == [("p", 0, 2), ("p", 2, 4)]


class Spans(HTMLParser):
    """Elements of one name by a plain parser's tags and a stack."""

    def __init__(self, name):
        super().__init__()
        self.name, self.found, self.stack = name, [], []

    def handle_starttag(self, tag, attrs):
        if tag == self.name:
            self.stack.append(len(self.found))
            self.found.append([self.getpos(), None])

    def handle_endtag(self, tag):
        if tag == self.name and self.stack:
            self.found[self.stack.pop()][1] = self.getpos()


@pytest.mark.parametrize("name", ["div", "span"])
def test_nesting_equals_a_stack(spark, name):
    import random

    random.seed(4)
    pages = ["".join(random.choice(["<div>", "</div>", "<span class='x'>", "</span>", "t", "<!-- <div> -->", "<br>"]) for _ in range(60)) for _ in range(25)]
    rows = mk.tokens(spark.createDataFrame([(i, BASE, h) for i, h in enumerate(pages)], COLUMNS), ["page_id"])
    size = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    got = {}
    for r in mk.elements(rows, ["page_id"], [name]).collect():
        got.setdefault(r["page_id"], set()).add((r["n"], r["end"]))
    texts = {r["page_id"]: r["t"] for r in size.collect()}
    for i, h in enumerate(pages):
        at, place = {}, 0
        import re

        for n, token in enumerate(re.findall(r"<!--.*?-->|<[^>]*>|[^<]+", h)):
            at[place] = n
            place += len(token)
        p = Spans(name)
        p.feed(h)
        assert got.get(i, set()) == {(at[a[1]], None if b is None else at[b[1]]) for a, b in p.found}
    assert texts


def test_navigation(spark):
    html = (
        "<nav><div class='x'><div><a href='1'>Courses</a></div></div><a href='2'>other</a></nav><a href='3'>courses</a><div class=\"top menu\"><div>in</div><ul><li><a href='4'>My courses</a></ul></div>"
        "<a href='5'>courses</a><div id=sub-nav><a href='1'>courses</a><a href='6'>courses</a></div><div class='navy'><a href='7'>courses</a></div>"
    )
    rows = spark.createDataFrame([(1, BASE, html), (2, BASE, None)], COLUMNS)
    got = mk.navigation_links(rows, F.contains(F.lower("link_text"), F.lit("courses"))).orderBy("pos").collect()
    assert [(r["pos"], r["link"]) for r in got] == [(0, BASE + "1"), (1, BASE + "4"), (2, BASE + "6")]


def test_a_tag_of_many_quotes(spark):
    """A tag beyond all bounds is text, and nothing overflows."""
    assert links(spark, "<a " + "x='1' " * 2000 + "href='y'>z</a><a href='w'>v</a>")[0][-1] == ("w", "v")
    assert plain.unescape("&amp;") == "&"
