"""Operational tables: checkpoints, retries, degraded services, alert retention, progress, health, dashboard; taxonomies and repositories as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.tables import numbered
from folioflow.operators import monitoring as mo

# ---- checkpoints ---------------------------------------------------------


def latest_checkpoints(progress: DataFrame, key: str, order: str = "saved_at") -> DataFrame:
    """The last checkpoint of each task, from which it resumes; partial maxima before the shuffle."""
    rest = [c for c in progress.columns if c != key]
    return progress.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last")).select(key, *[F.col("last")[c].alias(c) for c in rest])


def resumable(progress: DataFrame, key: str, total: Column) -> DataFrame:
    """Tasks that are not done, with what is left of them."""
    return latest_checkpoints(progress, key).withColumn("left_", F.greatest(total - F.col("done"), F.lit(0))).where("left_ > 0")


def stale_checkpoints(progress: DataFrame, key: str, keep: int = 10, order: str = "saved_at") -> DataFrame:
    """Checkpoints to delete: all but the `keep` newest of each task."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return progress.withColumn("age", F.row_number().over(newest)).where(F.col("age") > keep).drop("age")


# ---- retries and fallbacks -----------------------------------------------


def retry_schedule(calls: DataFrame, fails: Column, max_retries: int = 3, **backoff) -> DataFrame:
    """A row for each attempt of each call, max_retries + 1 at most: the wait before it, and whether it is the last and succeeds."""
    last = F.least(fails, F.lit(max_retries))
    rows = calls.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    wait = F.when(F.col("attempt") == 0, 0.0).otherwise(mo.backoff(F.col("attempt") - 1, **backoff))
    return rows.withColumn("wait", wait).withColumn("outcome", F.when(F.col("attempt") < last, "retried").when(fails <= max_retries, "succeeded").otherwise("gave_up"))


def degraded(calls: DataFrame, key: str, ok: Column, now: Column, hours: int, least: int) -> DataFrame:
    """(key, failures): services with `least` failures or more in the trailing hours."""
    return calls.where(mo.within(F.col("ts"), now, hours) & ~ok).groupBy(key).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= least)


def with_fallback(calls: DataFrame, key: str, bad: DataFrame, fallback: Column) -> DataFrame:
    """calls with `served_by`: the service asked for, or its fallback while it is degraded."""
    return calls.join(bad.select(F.col(key).alias("bad")), F.col(key) == F.col("bad"), "left").withColumn("served_by", F.when(F.col("bad").isNull(), F.col(key).cast("string")).otherwise(fallback)).drop("bad")


# ---- reports -------------------------------------------------------------


def retained(alerts: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    return alerts.where(mo.within(F.col("ts"), now, hours))


def progress_of(transfers: DataFrame, key: str, done: Column, size: Column, seconds: Column) -> DataFrame:
    """(key, total, finished, percent, bytes, eta): the time left is that of the mean finished transfer for each that is open."""
    n, good = F.count(F.lit(1)), F.count_if(done)
    mean = F.sum(F.when(done, seconds)) / F.greatest(good, F.lit(1))
    return transfers.groupBy(key).agg(n.alias("total"), good.alias("finished"), (good * 100 / n).alias("percent"), F.coalesce(F.sum(F.when(done, size)), F.lit(0.0)).alias("bytes"), F.coalesce(mean * (n - good), F.lit(0.0)).alias("eta"))


def health(samples: DataFrame, window: str, value: str, warn: float, critical: float, collect: float) -> DataFrame:
    """(start, n, mean, most, status, collect_now) by window: the mean against two limits, and whether the largest sample calls for a collection."""
    out = samples.groupBy(F.window(F.col("ts").cast("timestamp"), window)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    status = F.when(F.col("mean") > critical, "critical").when(F.col("mean") > warn, "warning").otherwise("healthy")
    return out.withColumn("status", status).withColumn("collect_now", F.col("most") > collect)


def dashboard(**measures: DataFrame) -> DataFrame:
    """(section, measure, value): one-row summaries of several sections as one table."""
    parts = []
    for section, one in measures.items():
        entries = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in one.columns])
        parts.append(one.select(F.explode(entries).alias("e")).select("e.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# ---- queues and pages of replies -----------------------------------------


def first_in_first_out(queue: DataFrame, *arrival: str) -> DataFrame:
    """queue with `place`, by arrival alone: a priority column has no say."""
    return numbered(queue, "place", *arrival)


def paged(replies: DataFrame, arrival: str, size: int = 100, most: int = 1000) -> DataFrame:
    """What a paged scan fetches, with `page`: batches of at most `size` until `most` rows; a short or empty page is the last."""
    first = replies.orderBy(arrival).limit(most)  # the scan's own bound
    return numbered(first, "at", arrival).withColumn("page", F.floor(F.col("at") / size)).drop("at")


def rendered_or_static(pages: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with the html of a rendering browser where there is one, else the static one, and `strategy`."""
    r = rendered.select(F.col(key).alias("r_key"), F.col("html").alias("r_html"))
    both = pages.join(r, F.col(key) == F.col("r_key"), "left")
    return both.withColumn("strategy", F.when(F.col("r_html").isNotNull(), "dynamic").otherwise("static")).withColumn("html", F.coalesce("r_html", "html")).drop("r_key", "r_html")


#: Kinds of repositories that are on unless a configuration says otherwise.
ENABLED = {"arxiv": True, "institutional": True, "researchgate": False, "google_scholar": False}


def enabled_repositories(config: DataFrame, defaults: Mapping[str, bool] = ENABLED) -> DataFrame:
    """Rows (kind, enabled) that are on: as configured, else by the kind's default; unknown kinds are off."""
    default = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in defaults.items()], F.lit(False))
    return config.where(F.coalesce(F.col("enabled"), default))


# ---- taxonomies ----------------------------------------------------------


def add_topics(taxonomy: DataFrame, custom: DataFrame) -> DataFrame:
    """Rows (subject, topic, keywords, levels): a custom topic is added, or replaces the one of its name."""
    return taxonomy.join(custom, ["subject", "topic"], "left_anti").unionByName(custom)


def save_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_rows(like: DataFrame, path: str) -> DataFrame:
    """JSON rows with the columns of `like`; rows that can't be read are dropped."""
    whole = T.StructType([*like.schema, T.StructField("_bad", T.StringType())])
    row = F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad"}).alias("row")
    return like.sparkSession.read.text(path).select(row).select("row.*").where("_bad is null").drop("_bad")


def match_taxonomy(docs: DataFrame, key: str, words: Column, taxonomy: DataFrame) -> DataFrame:
    """(key, subject, topic, score): the topic with the largest share of its keywords among a document's words, the first by name of equals.

    Words meet keywords in an equi-join, so a taxonomy may have any number of topics.
    """
    terms = taxonomy.select("subject", "topic", F.size("keywords").alias("size"), F.explode("keywords").alias("term"))
    hits = docs.select(key, F.explode(F.array_distinct(words)).alias("term")).join(terms, "term").groupBy(key, "subject", "topic", "size").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n") / F.col("size")).alias("score"), "subject", "topic")).alias("b")
    return hits.groupBy(key).agg(best).select(key, "b.subject", "b.topic", (-F.col("b.score")).alias("score"))


# ---- files ---------------------------------------------------------------


def with_ocr(files: DataFrame, ocr: DataFrame, key: str = "filename", least: int = 100) -> DataFrame:
    """files with the text of a recogniser (key, ocr_text) where their own, stripped, has fewer than `least` characters; the longer of the two wins."""
    both = files.join(ocr.select(F.col(key).alias("o_key"), "ocr_text"), F.col(key) == F.col("o_key"), "left").drop("o_key")
    own, other = F.coalesce("text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    short = F.char_length(F.trim(own)) < least
    return both.withColumn("text", F.when(short & (F.char_length(other) > F.char_length(own)), other).otherwise(own)).drop("ocr_text")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A copy of a table in a folder, read back and counted; a copy with another number of rows is an error."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (n := df.count()) != (m := out.count()):
        raise ValueError(f"{m} rows of {n} in the copy")
    return out


def stem(word: Column) -> Column:
    """A word without its plural ending, by Harman's three rules: ies to y, es to e, s to nothing, each with its exceptions."""
    ends = lambda *e: F.lit(False) if not e else F.coalesce(*[F.when(word.endswith(x), True) for x in e], F.lit(False))
    cut = lambda n: F.substr(word, F.lit(1), F.char_length(word) - n)
    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes", "ies"), cut(1))
        .when(ends("s") & ~ends("us", "ss", "es"), cut(1))
        .otherwise(word)
    )


def result_columns(meta: DataFrame, language: Column, confidence: Column, readability: Column, content_hash: Column, errors: Sequence[Column]) -> DataFrame:
    """The seventeen columns of an extraction's result."""
    problems = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return meta.select(
        "filename", "title", "authors", "institution", "subject_area", "academic_level", language.alias("language"), confidence.alias("language_confidence"), "keywords", "page_count", "text_ratio", "quality_score",
        readability.alias("readability_score"), content_hash.alias("content_hash"), "file_size", (F.size(problems) == 0).alias("is_processed"), problems.alias("processing_errors"),
    )
