"""Crawl frontier over a link table."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.tables import written


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth): pages that are reached from the seeds over links (src, dst) in at most max_depth steps, each at its first depth.

    A round for each depth: new pages are distinct link targets that no earlier
    round has seen. Rounds are written to the shared folder.
    """
    seen = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    edge = seen
    for depth in range(1, max_depth + 1):
        new = links.join(edge.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        edge = written(new.withColumn("depth", F.lit(depth)), "frontier")
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen


def best_first(seeds: DataFrame, links: DataFrame, max_pages: int = 1000, max_depth: int = 3, fetch: int = 64) -> DataFrame:
    """(turn, url, depth, priority): pages in the order of a crawl that always goes to the best one found so far.

    seeds are (url, priority), links (src, dst, priority). The best is the
    largest priority, of equals what was found first; a page's links are found
    in order of priority, then name. The order is sequential, but bounded by
    max_pages: the driver holds the queue's max_pages best at most, and reads
    the links of the next `fetch` of them at once, at most max_pages of a page.
    """
    spark = seeds.sparkSession
    seen: set[str] = set()
    queue: list[tuple[int, int, str, int]] = []
    known: dict[str, list[tuple[int, str]]] = {}
    seq, out = 0, []

    def found(rows: list[tuple[int, str]], depth: int) -> None:
        nonlocal seq
        for priority, url in rows:
            if url not in seen:
                seen.add(url)
                heapq.heappush(queue, (-priority, seq, url, depth))
                seq += 1

    start = seeds.groupBy("url").agg(F.max("priority").alias("priority")).orderBy(F.desc("priority"), "url").limit(max_pages).collect()
    found([(r["priority"], r["url"]) for r in start], 0)
    best = Window.partitionBy("src").orderBy(F.desc("priority"), "dst")
    while queue and len(out) < max_pages:
        minus, _, url, depth = heapq.heappop(queue)
        out.append((len(out), url, depth, -minus))
        if depth == max_depth:
            continue
        if url not in known:
            asked = [url, *(u for *_, u, d in heapq.nsmallest(fetch - 1, queue) if d < max_depth and u not in known)]
            rows = links.where(F.col("src").isin(asked)).groupBy("src", "dst").agg(F.max("priority").alias("priority")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_pages).collect()
            known |= {u: [] for u in asked}
            for r in sorted(rows, key=lambda r: (r["src"], r["n"])):
                known[r["src"]].append((r["priority"], r["dst"]))
        found(known.pop(url), depth + 1)
        known[url] = []
        if len(queue) > 2 * max_pages:  # only so many can still have their turn
            queue = heapq.nsmallest(max_pages, queue)
    return spark.createDataFrame(out, "turn int, url string, depth int, priority int")


def sitemap_pages(roots: DataFrame, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """(url, sitemap, depth): the pages of all sitemaps that the roots lead to.

    entries are (location, url, is_index), a row for each <loc>; an index leads
    to the sitemaps that it names, level by level, each read once however often
    it is named.
    """
    edge = written(roots.select(F.col("location")).distinct().withColumn("depth", F.lit(0)), "sitemaps")
    seen = edge
    for depth in range(1, max_depth + 1):
        named = entries.where("is_index").join(edge.select("location"), "location").select(F.col("url").alias("location")).distinct()
        edge = written(named.join(seen.select("location"), "location", "left_anti").withColumn("depth", F.lit(depth)), "sitemaps")
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return entries.where("not is_index").join(seen, "location").select("url", F.col("location").alias("sitemap"), "depth")


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (url, host, path) that no rule (host, prefix) of their host disallows; the longest fitting rule decides, allow before disallow of one length."""
    r = rules.select(F.col("host").alias("r_host"), "prefix", "allow")
    fit = urls.join(r, (F.col("host") == F.col("r_host")) & F.col("path").startswith(F.col("prefix")) & (F.col("prefix") != ""))
    best = fit.groupBy("url").agg(F.max(F.struct(F.char_length("prefix").alias("n"), F.col("allow"))).alias("best"))
    return urls.join(best.where("not best.allow").select("url"), "url", "left_anti").select(urls.columns)


def ordered(frontier_rows: DataFrame, priority: str = "priority") -> DataFrame:
    """Best first: priority, then the order in which pages were found."""
    return frontier_rows.orderBy(F.desc(priority), "seq")
