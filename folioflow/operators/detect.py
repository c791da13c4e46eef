"""Detectors that learn: naive Bayes over n-grams of letters for languages and of bytes for charsets, each with a confidence."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.tables import written

#: A table of grams of so many rows at most is broadcast.
MOST_BROADCAST = 1_000_000
SURE = 0.7


def letter_grams(text: Column, n: int = 3) -> Column:
    """Overlapping runs of n characters of the lower-cased text, in which anything but letters is one space; none of a text without a letter."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    return F.when(text.rlike(r"\p{L}"), F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def byte_grams(content: Column) -> Column:
    """Overlapping pairs of bytes in hexadecimal digits."""
    return F.regexp_extract_all(F.hex(content), F.lit("(?=(.{4})).."), 1)


@dataclass
class Grams:
    """Labels in order, what an unknown gram adds to each, and a table (gram, logs) of what the known ones add."""

    labels: list[str]
    unknown: list[float]
    table: DataFrame


def learn(rows: DataFrame, label: str, grams: Column, most_labels: int = 1000) -> Grams:
    """Smoothed logarithms of the share of each gram among those of a label.

    Counts are partial aggregates; what the driver gets is a total for each label, and more than
    `most_labels` are an error. Rows without a label teach nothing.
    """
    counts = written(rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(grams).alias("gram")).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    totals = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").limit(most_labels + 1).collect()
    if len(totals) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    known, labels = counts.select("gram").distinct().count(), [r["label"] for r in totals]
    of = {r["label"]: float(r["n"] + known) for r in totals}
    log = lambda k: F.log((F.coalesce(F.max(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) + F.lit(1.0)) / of[k])
    table = counts.groupBy("gram").agg(F.array(*[log(k) for k in labels]).alias("logs")) if labels else counts.select("gram", F.array().cast("array<double>").alias("logs"))
    table = written(table, "gram-logs")
    return Grams(labels, [math.log(1.0 / of[k]) for k in labels], table)


def detect(rows: DataFrame, keep: list[str], grams: Column, model: Grams, ruled_out: dict[str, str] | None = None) -> DataFrame:
    """The columns `keep` of rows with `label`, the likeliest, and `confidence`, its probability; both null if there is no gram or nothing was learned.

    Grams meet the table where they are (it is broadcast up to a million grams) and are summed by row
    in the same task before the shuffle, so a row of any length costs one small row there. Equal labels
    go by name. Repeated rows are judged each. `ruled_out` names kept columns that are true where a
    label can't be.
    """
    if not model.labels:
        return rows.select(*keep, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"))
    table = F.broadcast(model.table) if model.table.count() <= MOST_BROADCAST else model.table
    each = rows.select(*keep, F.monotonically_increasing_id().alias("_row"), grams.alias("_grams"))  # numbered before the grams are rows of their own
    each = each.select(*keep, "_row", F.explode_outer("_grams").alias("_gram")).join(table, F.col("_gram") == F.col("gram"), "left")
    sums = [F.sum(F.coalesce(F.get("logs", F.lit(i)), F.lit(u))).alias(f"_s{i}") for i, u in enumerate(model.unknown)]
    by_row = each.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.count("_gram").alias("_n"), *sums)
    out = ruled_out or {}
    scores = F.array(*[F.when(F.col(out[k]), float("-inf")).otherwise(F.col(f"_s{i}")) if k in out else F.col(f"_s{i}") for i, k in enumerate(model.labels)])
    by_row = by_row.withColumn("_scores", scores).withColumn("_best", F.array_max("_scores"))
    label = F.element_at(F.array(*[F.lit(k) for k in model.labels]), F.array_position("_scores", F.col("_best")).cast("int"))
    sure = 1.0 / F.aggregate(F.transform("_scores", lambda s: F.exp(s - F.col("_best"))), F.lit(0.0), lambda a, x: a + x)
    return by_row.select(*keep, F.when(F.col("_n") > 0, label).alias("label"), F.when(F.col("_n") > 0, sure).alias("confidence"))


def languages(docs: DataFrame, model: Grams, keep: list[str], text: str = "text", least: int = 50) -> DataFrame:
    """`keep`, language and confidence; a text of fewer than `least` characters without space around is en with 0."""
    rows = docs.select(*keep, F.col(text).alias("_text"), (F.char_length(F.trim(F.col(text))) >= least).alias("_long"))
    found = detect(rows, [*keep, "_long"], letter_grams(F.col("_text")), model)
    told = F.coalesce(F.col("_long"), F.lit(False)) & F.col("label").isNotNull()
    return found.select(*keep, F.when(told, F.col("label")).otherwise("en").alias("language"), F.when(told, F.col("confidence")).otherwise(0.0).alias("confidence"))


def charsets(files: DataFrame, model: Grams, keep: list[str], content: str = "content", header: str | None = None, least: float = SURE) -> DataFrame:
    """`keep`, charset and confidence: the header's charset if there is one, else the detected one, or UTF-8 below a confidence of `least`. Bytes that are valid UTF-8 are it, unless they are found to be UTF-16, of which that may hold as well; bytes that are not, and bytes that are controls in ISO-8859-1, rule these out."""
    said = F.col(header) if header else F.lit(None).cast("string")
    controls = F.hex(F.col(content)).rlike("^(?:..)*?[89].")
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    rows = files.select(*keep, said.alias("_said"), F.col(content).alias("_content"), valid.alias("_valid"), (~valid).alias("_invalid"), controls.alias("_controls"))
    found = detect(rows, [*keep, "_said", "_valid", "_invalid", "_controls"], byte_grams(F.col("_content")), model, {"ISO-8859-1": "_controls", "UTF-8": "_invalid"})
    sure, wide = F.coalesce(F.col("confidence"), F.lit(0.0)), F.coalesce(F.startswith("label", F.lit("UTF-16")), F.lit(False))
    detected = F.when(F.col("_valid") & ~wide, "UTF-8").when(sure >= least, F.col("label")).otherwise("UTF-8")
    return found.select(*keep, F.coalesce("_said", detected).alias("charset"), F.when(F.col("_said").isNotNull() | (F.col("_valid") & ~wide), F.lit(1.0)).otherwise(sure).alias("confidence"))
