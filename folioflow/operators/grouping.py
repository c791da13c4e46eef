"""Groups of documents: by author, institution, keyword, course and series; overlap merge; statistics.

Tables are documents_meta with `ordinal`, the order in which documents came,
which decides ties and the order of members.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.functions.tables import numbered, written

GROUP = "name string, kind int, first bigint, members array<string>"
#: A chain of overlapping groups of more memberships is merged in rounds and not in a task.
ONE_TASK = 100_000


def named(rows: DataFrame, prefix: str, key: str, kind: int) -> DataFrame:
    """(name, kind, first, ordinal, filename): a row for each member of the groups of two or more rows with one key; first is the least ordinal."""
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("ordinal").cast("bigint").alias("first")).where("_n > 1").withColumnRenamed(key, "_key")
    out = rows.join(several, F.col(key) == F.col("_key"))
    return out.select(F.concat(F.lit(prefix), F.col(key)).alias("name"), F.lit(kind).alias("kind"), "first", F.col("ordinal").cast("bigint").alias("ordinal"), "filename")


def listed(rows: DataFrame, *order: str) -> DataFrame:
    """Groups for display: members in one array, in the order given."""
    members = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("filename").alias("_f")))), lambda x: x["_f"]).alias("members")
    return rows.groupBy("name", "kind", "first").agg(members)


def author_members(meta: DataFrame) -> DataFrame:
    return named(meta.where(F.size("authors") > 0).select("ordinal", "filename", F.get("authors", F.lit(0)).alias("author")), "author_", "author", 0)


def author_groups(meta: DataFrame) -> DataFrame:
    return listed(author_members(meta), "ordinal")


def institution_members(meta: DataFrame) -> DataFrame:
    return named(meta.where("institution <> ''").select("ordinal", "filename", "institution"), "institution_", "institution", 2)


def institution_groups(meta: DataFrame) -> DataFrame:
    return listed(institution_members(meta), "ordinal")


def keyword_counts(meta: DataFrame, most: int = 20) -> DataFrame:
    """(keyword, n, first): the most frequent keywords; each occurrence counts, the first seen wins ties, and single ones are left out."""
    rows = meta.select("ordinal", F.posexplode("keywords").alias("pos", "keyword"))
    counts = rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("ordinal").cast("bigint").alias("o"), F.col("pos").cast("bigint").alias("p"))).alias("seen"))
    return counts.orderBy(F.desc("n"), "seen").limit(most).where("n > 1")


def topic_members(meta: DataFrame, most: int = 20) -> DataFrame:
    """Members of the topics of the most frequent keywords; first is the keyword's place among them."""
    rows = meta.select("ordinal", "filename", F.explode(F.array_distinct("keywords")).alias("keyword"))
    common = keyword_counts(meta, most)
    turn = F.row_number().over(Window.orderBy(F.desc("n"), "seen")).cast("bigint")  # of `most` rows
    out = named(rows.join(F.broadcast(common.select("keyword")), "keyword"), "topic_", "keyword", 1).drop("first")
    return out.join(F.broadcast(common.select(F.concat(F.lit("topic_"), F.col("keyword")).alias("_name"), turn.alias("first"))), F.col("name") == F.col("_name")).select("name", "kind", "first", "ordinal", "filename")


def topic_groups(meta: DataFrame, most: int = 20) -> DataFrame:
    return listed(topic_members(meta, most), "ordinal")


def overlapping(flat: DataFrame) -> DataFrame:
    """(gid, part) for members (gid, m): part is equal for groups that a chain of shared members connects; the merge never looks across parts.

    Each round passes the least number over members, by partial minima; a member is in few groups, one for each kind of group that it has.
    """
    labels = flat.select("gid").distinct().withColumn("part", F.col("gid"))
    while True:
        least = flat.join(labels, "gid").groupBy("m").agg(F.min("part").alias("low"))
        moved = flat.join(least, "m").groupBy("gid").agg(F.min("low").alias("low")).join(labels, "gid")
        done = written(moved.select("gid", "low", (F.col("low") < F.col("part")).alias("changed")), "parts")
        labels = done.select("gid", F.col("low").alias("part"))
        if done.where("changed").isEmpty():
            return labels


def fold(rows: pd.DataFrame, overlap: float) -> pd.DataFrame:
    """The greedy merge of one part, (gid, root). An index of members leads to the kept groups that hold them, so time grows with the memberships and not with pairs of groups."""
    kept: dict[int, set] = {}
    holders: dict[str, list[int]] = {}
    out = []
    for gid, own in rows.sort_values("gid").groupby("gid", sort=False)["m"]:
        shared: dict[int, int] = {}
        for m in own:
            for k in holders.get(m, ()):
                shared[k] = shared.get(k, 0) + 1
        root = min((k for k, n in shared.items() if n / min(len(own), len(kept[k])) > overlap), default=gid)
        members = kept.setdefault(root, set())
        for m in own:
            if m not in members:
                members.add(m)
                holders.setdefault(m, []).append(root)
        out.append((gid, root))
    return pd.DataFrame(out, columns=["gid", "root"])


def merge_in_rounds(flat: DataFrame, overlap: float, told: dict | None = None) -> DataFrame:
    """(gid, root) of the greedy merge for members (gid, m), in rounds over the tables of members.

    A group can be decided once nothing that comes before it can change what it would find: no
    undecided earlier group shares a member with it, nor with a cluster that it meets and that is
    smaller than itself, as only such a cluster's size counts. Groups decided in one round share no
    members, so their decisions don't touch each other. The first undecided group always can, and
    there are as many rounds as the longest chain of groups that wait for one another. Members are
    rows throughout: counts and minima are partial aggregates, and nothing but the number of
    undecided groups comes to the driver.
    """
    sizes = written(flat.groupBy("gid").agg(F.count(F.lit(1)).alias("size")), "sizes")
    left, clusters, decided, rounds = flat, None, [], 0
    while True:
        rounds += 1
        low = written(left.groupBy("m").agg(F.min("gid").alias("low")), "low")  # the first undecided group of each member
        blocked = left.join(low, "m").groupBy("gid").agg(F.min("low").alias("low"))
        if clusters is None:
            met = None
            ready = blocked.where("low >= gid").select("gid", F.col("gid").alias("root"))
        else:
            count = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
            first = clusters.join(low, "m").groupBy("root").agg(F.min("low").alias("low"))
            state = count.join(first, "root", "left").withColumnRenamed("root", "of")
            shared = left.join(clusters, "m").groupBy("gid", "root").agg(F.count(F.lit(1)).alias("shared"))
            met = shared.join(state, F.col("root") == F.col("of")).join(sizes, "gid")
            waits = (F.col("many") < F.col("size")) & (F.col("low") < F.col("gid"))
            fits = F.when(F.col("shared") / F.least("many", "size") > overlap, F.col("root"))
            met = met.groupBy("gid").agg(F.max(waits).alias("waits"), F.min(fits).alias("root")).withColumnRenamed("gid", "g")
            ready = blocked.where("low >= gid").join(met, F.col("gid") == F.col("g"), "left").where("waits is null or not waits").select("gid", F.coalesce("root", "gid").alias("root"))
        ready = written(ready, "decided")
        decided.append(ready)
        new = left.join(ready, "gid").select("root", "m")
        clusters = written(new if clusters is None else clusters.union(new).distinct(), "clusters")
        left = written(left.join(ready, "gid", "left_anti"), "undecided")
        if left.isEmpty():
            break
    if told is not None:
        told["rounds"] = rounds
    return reduce(DataFrame.unionByName, decided)


def merge_members(rows: DataFrame, overlap: float = 0.5, one_task: int = ONE_TASK, told: dict | None = None) -> DataFrame:
    """(name, kind, first, merged, ordinal, filename) of the kept groups: groups in order of kind, first and name; each joins the first kept group of which the smaller is shared by more than `overlap`.

    The order matters, so only groups that a chain of shared members connects are decided together: a
    chain of at most `one_task` memberships in one task, all longer ones in rounds. Both give the same.
    `told` gets the memberships of the longest chain and the number of rounds.
    """
    groups = numbered(rows.select("name", "kind", "first").distinct(), "gid", "kind", "first", "name")
    groups = written(groups.select(F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.col("first").alias("_first"), "gid"), "groups")
    same = (F.col("name") == F.col("_name")) & (F.col("kind") == F.col("_kind")) & (F.col("first") == F.col("_first"))
    full = written(rows.join(groups, same).groupBy("gid", F.col("filename").alias("m")).agg(F.min("ordinal").alias("ordinal")), "memberships")
    flat = full.select("gid", "m")
    n = flat.count()
    if n <= one_task:  # all chains together are short
        roots = flat.groupBy(F.lit(0).alias("part")).applyInPandas(lambda part: fold(part, overlap), "gid bigint, root bigint")
        largest = n
    else:
        parts = written(overlapping(flat), "group-parts")
        sizes = flat.join(parts, "gid").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gid").alias("groups")).where("groups > 1")
        sizes = written(sizes.select(F.col("part").alias("p"), "n"), "part-sizes")
        largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        marked = flat.join(parts, "gid").join(sizes, F.col("part") == F.col("p"))
        roots = marked.where(F.col("n") <= one_task).select("part", "gid", "m").groupBy("part").applyInPandas(lambda part: fold(part, overlap), "gid bigint, root bigint")
        if largest > one_task:
            roots = roots.unionByName(merge_in_rounds(written(marked.where(F.col("n") > one_task).select("gid", "m"), "long-chains"), overlap, told))
    if told is not None:
        told["largest"] = largest
    roots = written(roots, "roots").select(F.col("gid").alias("g"), "root")
    whole = full.join(roots, F.col("gid") == F.col("g"), "left").withColumn("root", F.coalesce("root", "gid"))
    merged = roots.where("g <> root").select(F.col("root").alias("grown")).distinct()
    out = whole.groupBy("root", "m").agg(F.min("ordinal").alias("ordinal")).join(merged, F.col("root") == F.col("grown"), "left")
    out = out.join(groups, F.col("root") == F.col("gid"))
    return out.select(F.col("_name").alias("name"), F.col("_kind").alias("kind"), F.col("_first").alias("first"), F.col("grown").isNotNull().alias("merged"), "ordinal", F.col("m").alias("filename"))


def merge_overlapping(groups: DataFrame, overlap: float = 0.5, **options) -> DataFrame:
    """merge_members() of groups with arrays of members; those of merged groups come sorted."""
    rows = groups.select("name", "kind", "first", F.posexplode("members").alias("ordinal", "filename")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return shown(merge_members(rows, overlap, **options))


def shown(rows: DataFrame) -> DataFrame:
    """Kept groups for display: members in document order, those of merged groups sorted."""
    return listed(rows.withColumn("_place", F.when(~F.col("merged"), F.col("ordinal"))), "_place")


def related_members(meta: DataFrame, **options) -> DataFrame:
    return merge_members(author_members(meta).unionByName(topic_members(meta)).unionByName(institution_members(meta)), **options)


def related_groups(meta: DataFrame) -> DataFrame:
    return shown(related_members(meta))


def course_codes(meta: DataFrame) -> Column:
    """Distinct codes of the code field, title and description, upper-case and without space, in order."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    own = F.filter(F.array(F.coalesce("course_code", F.lit(""))), lambda c: c != "")
    found = F.concat(own, *[F.regexp_extract_all(text, F.lit("(?i)" + p), 0) for p in d.COURSE_CODES])
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(F.upper(c), r"\s+", "")))


def material_type(title: Column, pages: Column) -> Column:
    low = F.lower(title)
    out = F.when(F.lit(False), "")
    for kind, terms in d.MATERIALS:
        test = tx.any_of(low, terms)
        out = out.when(test | (pages > 200) if kind == "textbooks" else test, kind)
    return out.otherwise("supplementary")


def most_common(rows: DataFrame, key: str, value: str, none: str) -> DataFrame:
    """(key, value): the most frequent value of each key, the smallest of equals."""
    counts = rows.where(F.col(value) != none).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best["v"].alias(value))


def course_names(rows: DataFrame) -> DataFrame:
    """(code, course_name): the words that all titles share, sorted and capitalised; else the first title."""
    n = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", "ordinal").alias("first_title"))
    words = rows.select("code", F.explode(F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != ""))).alias("word")).where(~F.col("word").isin(d.STOP_WORDS))
    shared = words.groupBy("code", "word").agg(F.count(F.lit(1)).alias("k")).join(n, "code").where("k = n").groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("common"))
    return n.join(shared, "code", "left").select("code", F.coalesce(tx.title_case(F.col("common")), F.col("first_title")).alias("course_name"))


def courses(meta: DataFrame) -> DataFrame:
    """A row for each code of two documents or more: names, modes, and members by type of material."""
    rows = meta.withColumn("code", F.explode(course_codes(meta))).withColumn("material", material_type(F.col("title"), F.col("page_count")))
    kinds = [k for k, _ in d.MATERIALS] + ["supplementary"]
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("material") == k, F.struct(F.col("ordinal").alias("o"), F.col("filename").alias("f"))))), lambda x: x["f"])
    sets = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[listed(k).alias(k) for k in kinds]).where("n > 1")
    out = sets.join(most_common(rows, "code", "institution", ""), "code", "left").join(most_common(rows, "code", "academic_level", "unknown"), "code", "left").join(course_names(rows), "code")
    return out.withColumns({"institution": F.coalesce("institution", F.lit("")), "academic_level": F.coalesce("academic_level", F.lit("unknown")), "materials": F.concat(*kinds)})


def series_parts(meta: DataFrame) -> DataFrame:
    """(series, part, filename, ordinal, pattern): all patterns count, so a title can join several series."""
    title = F.lower("title")
    found = F.array(*[F.struct(F.lit(i).alias("pattern"), F.regexp_extract(title, p, 1).alias("raw"), F.regexp_extract(title, p, 2).try_cast("bigint").alias("part")) for i, p in enumerate(d.SERIES_PATTERNS)])
    rows = meta.select("ordinal", "filename", F.explode(found).alias("s")).where("s.part is not null")
    return rows.select(F.trim(F.regexp_replace("s.raw", r"\s+", " ")).alias("series"), F.col("s.part").alias("part"), "filename", "ordinal", F.col("s.pattern").alias("pattern"))


def series(meta: DataFrame) -> DataFrame:
    """A row for each series of two hits or more: its total (largest part), parts, latest file of each part, gaps as ranges, and whether it is complete."""
    return series_of(series_parts(meta))


def series_of(hits: DataFrame) -> DataFrame:
    """series() of the rows that series_parts() finds."""
    several = hits.groupBy("series").agg(F.count(F.lit(1)).alias("hits"), F.max("part").alias("total_parts"), F.min("ordinal").alias("first")).where("hits > 1")
    parts = hits.groupBy("series", "part").agg(F.max_by("filename", F.struct("ordinal", "pattern")).alias("filename"))
    before = F.coalesce(F.lag("part").over(Window.partitionBy("series").orderBy("part")), F.lit(0))
    gap = F.when(F.col("part") - before > 1, F.concat_ws("-", (before + 1).cast("string"), (F.col("part") - 1).cast("string")))
    parts = parts.withColumn("gap", gap)
    lists = parts.groupBy("series").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "filename"))), lambda x: x["filename"]).alias("files"), F.array_sort(F.collect_list("part")).alias("parts"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("part", "gap")))), lambda x: x["gap"]).alias("missing"),
    )
    return several.join(lists, "series").withColumn("complete", F.size("parts") == F.col("total_parts"))


def content_groups(meta: DataFrame) -> DataFrame:
    """(group_id, group_type, title, members): related groups, then courses, then series, numbered in that order."""
    related = related_groups(meta).select(F.lit(0).alias("turn"), F.struct("kind", "first", "name").alias("key"), F.lit("related").alias("group_type"), tx.title_case(F.replace("name", F.lit("_"), F.lit(" "))).alias("title"), "members", F.lit("").alias("code"))
    course = courses(meta).select(F.lit(1).alias("turn"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("first"), F.col("code").alias("name")).alias("key"), F.lit("course").alias("group_type"), F.concat_ws(": ", "code", "course_name").alias("title"), F.col("materials").alias("members"), "code")
    rows = series(meta).select(F.lit(2).alias("turn"), F.struct(F.lit(0).alias("kind"), F.col("first").cast("bigint").alias("first"), F.col("series").alias("name")).alias("key"), F.lit("series").alias("group_type"), F.concat(F.lit("Series: "), F.col("series")).alias("title"), F.col("files").alias("members"), F.lit("").alias("code"))
    every = numbered(related.union(course).union(rows), "i", "turn", "key")
    return every.select(F.when(F.col("group_type") == "course", F.concat(F.lit("course_"), F.col("code"))).otherwise(F.concat_ws("_", "group_type", F.col("i").cast("string"))).alias("group_id"), "group_type", "title", "members")


def group_statistics(groups: DataFrame) -> DataFrame:
    """(measure, key, value): groups by type and by size, their number, their members, their mean size."""
    g = groups.select("group_type", F.size("members").alias("n"))
    by = lambda measure, key: g.groupBy(key.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(measure).alias("measure"), "key", "value")
    one = g.agg(F.count(F.lit(1)).cast("double").alias("total_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_members"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_size"))
    names = ("total_groups", "total_members", "average_size")
    whole = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.lit("").alias("key"), F.col(k).alias("value")) for k in names])).alias("x")).select("x.*")
    return by("type", F.col("group_type")).union(by("size", F.concat(F.col("n").cast("string"), F.lit("_documents")))).union(whole)


def hierarchy_rollup(rows: DataFrame, *levels: str) -> DataFrame:
    """Counts for each single level and for each prefix of the levels, in one pass of grouping sets; null where a level is rolled up."""
    sets = [()] + [tuple(levels[: i + 1]) for i in range(len(levels))] + [(x,) for x in levels[1:]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("rolled"))


def folder_statistics(meta: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject_area, documents, documents_plus_memberships): the second counts each membership in a group once more."""
    docs = meta.groupBy("subject_area").agg(F.count(F.lit(1)).alias("documents"))
    again = groups.select(F.explode("members").alias("filename")).join(meta.select("filename", "subject_area"), "filename").groupBy("subject_area").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(again, "subject_area", "left").select("subject_area", "documents", (F.col("documents") + F.coalesce("n", F.lit(0))).alias("documents_plus_memberships"))
