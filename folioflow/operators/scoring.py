"""Scores and classes of documents: relevance, academic level, subject, topic, language.

All are row-wise expressions over documents_meta columns and a text column
`content`; the term lists fold into the plan as literals, so nothing is joined
or shuffled. Empty and null texts are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import readability as rd
from folioflow.functions import text as tx


def c0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def joined(*parts: Column) -> Column:
    """Parts joined by a space, the empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def relevance(df: DataFrame, min_bytes: int = 1024, max_bytes: int = 100 * 1024 * 1024, min_pages: int = 5, min_ratio: float = 0.1) -> DataFrame:
    """Adds keyword_score, institution_score, author_score, structure_score, file_quality, relevance_score, is_educational, reasons."""
    text = tx.lowered(joined(F.col("title"), F.col("description"), F.array_join("keywords", " "), F.substring(c0("content"), 1, 1000)))
    n = sum(len(terms) for _, terms in d.RELEVANCE_TERMS.values())
    weighted = total([tx.hits(text, terms) * weight for weight, terms in d.RELEVANCE_TERMS.values()])
    keyword = F.least(weighted / (n * 0.1), F.lit(1.0))

    place = tx.lowered(joined(F.col("institution"), F.col("download_source")))
    institution = F.when(place == "", 0.0)
    for score, names in d.INSTITUTIONS:
        institution = institution.when(tx.any_of(place, names), score)
    institution = institution.when(tx.any_of(place, d.ACADEMIC_DOMAINS), 0.6).otherwise(0.2)

    people = tx.lowered(F.array_join("authors", " "))
    size = F.coalesce(F.size("authors"), F.lit(0))
    author = tx.hits(people, d.AUTHOR_TITLES) * 0.3 + F.when(size > 1, 0.2).otherwise(0.0) + F.when(c0("institution") != "", 0.2).otherwise(0.0)
    author = F.when(size > 0, F.least(author, F.lit(1.0))).otherwise(0.0)

    shape = joined(F.col("title"), F.col("course_code"), F.substring(c0("content"), 1, 500))
    df = df.withColumn("_shape", tx.ascii_text(shape))
    structure = total([tx.case_blind(F.col("_shape"), p, Column.rlike).cast("int") for p in d.COURSE_PATTERNS]) * 0.3 + tx.hits(tx.lowered(shape), d.STRUCTURE_TERMS) * 0.1
    structure = F.least(structure, F.lit(1.0))

    pages = F.coalesce("page_count", F.lit(0))
    quality = 1.0 - F.when(F.col("file_size") < min_bytes, 0.5).when(F.col("file_size") > max_bytes, 0.3).otherwise(0.0)
    quality = quality - F.when((pages > 0) & (pages < min_pages), 0.4).when(pages > 1000, 0.2).otherwise(0.0)
    quality = F.greatest(quality - F.when(F.col("text_ratio") < min_ratio, 0.6).otherwise(0.0), F.lit(0.0))

    df = df.withColumns({"keyword_score": keyword, "institution_score": institution, "author_score": author, "structure_score": structure, "file_quality": quality}).drop("_shape")
    df = df.withColumn("relevance_score", F.col("keyword_score") * 0.3 + F.col("institution_score") * 0.25 + F.col("author_score") * 0.15 + F.col("structure_score") * 0.3)
    rel, fq = F.col("relevance_score"), F.col("file_quality")
    df = df.withColumn("is_educational", (rel >= 0.4) & (fq >= 0.5))
    say = lambda test, words, s: F.when(test, F.format_string(f"{words} (score: %.2f)", s))
    reasons = F.array(
        say(F.col("keyword_score") > 0.3, "Contains educational keywords", F.col("keyword_score")), say(F.col("institution_score") > 0.5, "From credible institution", F.col("institution_score")),
        say(F.col("author_score") > 0.3, "Credible author indicators", F.col("author_score")), say(fq < 0.5, "Quality issues detected", fq),
        say(F.col("structure_score") > 0.4, "Academic structure detected", F.col("structure_score")), say(rel < 0.4, "Low educational relevance", rel),
    )
    return df.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def level_text(df: DataFrame) -> DataFrame:
    """Adds level_text: title, description, course code and the first 2000 characters."""
    return df.withColumn("level_text", joined(F.col("title"), F.col("description"), F.col("course_code"), F.substring(c0("content"), 1, 2000)))


def level_keyword_score(text: Column, plain: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """Of a text and its ascii_text()."""
    low = tx.lowered(text)
    found = total([tx.case_blind(plain, p, lambda t, x: F.regexp_count(t, F.lit(x))) for p in terms["patterns"]]) * 0.3
    return F.least(found + tx.hits(low, terms["subjects"]) * 0.2 + tx.hits(low, terms["complexity"]) * 0.1 + tx.hits(low, terms["indicators"]) * 0.15, F.lit(1.0))


def course_number_score(text: Column) -> Column:
    """Mean worth of the numbers of course codes in an ascii_text(), 0 without any."""
    found = tx.case_blind(text, r"\b[A-Z]{2,4}\s*(\d{3,4})\b", lambda t, x: F.regexp_extract_all(t, F.lit(x), 1))
    numbers = F.transform(found, lambda x: x.cast("int"))
    worth = F.transform(numbers, lambda n: F.when(n.between(100, 299), 0.6).when(n.between(300, 499), 0.8).when(n.between(500, 999), 1.0).when(n < 100, 0.3).otherwise(0.0))
    return F.when(F.size(worth) > 0, F.least(F.aggregate(worth, F.lit(0.0), lambda a, b: a + b) / F.size(worth), F.lit(1.0))).otherwise(0.0)


def classify_level(df: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Adds predicted_level, level_confidence, complexity_score and reasoning, from readability, terms and course numbers.

    The first of equal levels wins; postgraduate gets no evidence. A blank text is unknown with zeros.
    """
    df = level_text(df)
    text = F.col("level_text")
    words, sentences, syllables = tx.word_count(text), tx.sentence_count(text), tx.syllable_count(text)
    df = df.withColumns({"level_ease": rd.flesch_ease(words, sentences, syllables), "level_grade": rd.flesch_kincaid(words, sentences, syllables)})
    plain = F.col("_plain")
    df = df.withColumn("_plain", tx.ascii_text(text))
    df = df.withColumns({f"{k}_terms": level_keyword_score(text, plain, v) for k, v in d.LEVEL_TERMS.items()})
    code = c0("course_code")
    df = df.withColumn("course_level", course_number_score(F.concat(plain, F.when(code != "", F.concat(F.lit(" "), tx.ascii_text(code))).otherwise("")))).drop("_plain")
    ease, grade, course = F.col("level_ease"), F.col("level_grade"), F.col("course_level")
    scores = []
    for level in d.LEVELS[:4]:
        s = F.lit(0.0)
        if level in d.LEVEL_RANGES:
            (a, b), (p, q) = d.LEVEL_RANGES[level]
            s = (F.when(ease.between(a, b), 0.4).otherwise(0.0) + F.when(grade.between(p, q), 0.4).otherwise(0.0)) * 0.3 + F.col(f"{level}_terms") * 0.4
        if level in ("undergraduate", "graduate"):
            s = s + F.when(course > 0.5, course * 0.2).otherwise(0.0)
        if level == "high_school":
            s = s + F.when(course > 0.5, 0.0).otherwise((1 - course) * 0.2)
        scores.append((level, s))
    best, confidence = tx.first_most(scores, "unknown")
    blank = tx.is_blank(text)
    df = df.withColumn("level_confidence", F.when(blank, 0.0).otherwise(confidence))
    df = df.withColumn("predicted_level", F.when(blank | (F.col("level_confidence") < min_confidence), "unknown").otherwise(best))
    df = df.withColumn("complexity_score", F.when(blank, 0.0).otherwise(rd.complexity(ease, grade)))
    reasons = F.array(
        F.when(ease < 30, "Very difficult text (low readability score)").when(ease > 70, "Easy to read text (high readability score)"),
        F.when(grade > 16, "Graduate-level reading complexity").when(grade > 12, "College-level reading complexity").when(grade > 8, "High school reading complexity"),
        *[F.when(F.col(f"{k}_terms") > 0.3, f"Contains {k.replace('_', ' ')} keywords") for k in d.LEVEL_TERMS],
        F.when(course > 0.5, "Course numbering suggests advanced level"),
    )
    return df.withColumn("reasoning", F.when(blank, F.array().cast("array<string>")).otherwise(F.filter(reasons, lambda r: r.isNotNull())))


def include(df: DataFrame, min_relevance: float = 0.4, min_quality: float = 0.5, min_confidence: float = 0.3) -> DataFrame:
    """Adds should_include; needs relevance() and classify_level()."""
    sure = (F.col("predicted_level") == "unknown") | (F.col("level_confidence") >= min_confidence)
    return df.withColumn("should_include", F.col("is_educational") & (F.col("relevance_score") >= min_relevance) & (F.col("file_quality") >= min_quality) & sure)


def filter_statistics(df: DataFrame) -> DataFrame:
    """One row of counters over included and left-out documents; inclusion_rate counts every one left out, so it can be negative."""
    level = F.col("predicted_level")
    n = lambda test: F.count_if(test).cast("bigint")
    edu = F.col("is_educational")
    out = df.agg(
        F.count(F.lit(1)).alias("processed"), n(edu).alias("educational_found"), n(edu & (level == "high_school")).alias("high_school"), n(edu & (level == "undergraduate")).alias("undergraduate"),
        n(edu & (level == "graduate")).alias("graduate"), n(edu & ~level.isin("high_school", "undergraduate", "graduate")).alias("unknown_level"), n(~F.col("should_include")).alias("filtered_out"),
    )
    return out.withColumn("inclusion_rate", F.when(F.col("processed") > 0, (F.col("educational_found") - F.col("filtered_out")) / F.col("processed")).otherwise(0.0))


def extractor_level(title: Column, content: Column) -> Column:
    text = F.lower(F.concat(title, F.lit(" "), F.substring(content, 1, 2000)))
    one = lambda terms, n: F.when(tx.any_of(text, terms), n).otherwise(0)
    more = {
        "high_school": one(["introduction", "basic", "fundamentals"], 1) + one(["high school"], 5), "undergraduate": one(["introduction", "basic", "fundamentals"], 2),
        "graduate": one(["research", "methodology", "analysis"], 2), "postgraduate": one(["dissertation", "phd"], 5) + one(["research", "methodology", "analysis"], 1),
    }
    return tx.first_most([(k, tx.hits(text, d.EXTRACTOR_LEVEL_TERMS[k]) + more[k]) for k in d.LEVELS[:4]], "unknown")[0]


def subject_by_occurrence(text: Column, terms: Mapping[str, Sequence[str]] = d.SUBJECT_TERMS) -> tuple[Column, Column]:
    """(subject, score): occurrences of each term and 2 more for each that occurs."""
    low = F.lower(text)
    scored = [(s, total([tx.occurrences(low, t) + F.when(F.contains(low, F.lit(t)), 2).otherwise(0) for t in ts])) for s, ts in terms.items()]
    return tx.first_most(scored, "unknown")


def topic_score(text: Column, level: Column, terms: Sequence[str], levels: Sequence[str]) -> Column:
    share = tx.hits(text, terms) / len(terms)
    return F.least(F.when(level.isin(*levels), share * 1.2).otherwise(share), F.lit(1.0)) if levels else F.least(share, F.lit(1.0))


def classify_topic(df: DataFrame, taxonomy: Sequence[tuple[str, str, Sequence[str], Sequence[str]]] = d.TAXONOMY, hints: Mapping[str, Sequence[str]] = d.SUBJECT_HINTS) -> DataFrame:
    """Adds subject, topic, topic_score: within the subject that the fields name if its best topic scores above 0.3, else the best of all."""
    keywords = F.array_join("keywords", " ")
    text = F.lower(F.concat_ws(" ", c0("title"), keywords, c0("description")))
    area = F.lower(c0("subject_area"))
    named = F.lower(F.concat_ws(" ", c0("title"), c0("subject_area"), keywords))
    said = F.when(area == "", F.lit(None).cast("string"))
    for subject, terms in hints.items():
        said = said.when(tx.any_of(area, terms), subject)
    counted, _ = tx.first_most([(s, tx.hits(named, terms)) for s, terms in hints.items()], "other")
    df = df.withColumn("named_subject", F.coalesce(said, counted))
    score = lambda i: topic_score(text, F.col("academic_level"), taxonomy[i][2], taxonomy[i][3])
    entries = F.array(*[F.struct(score(i).cast("double").alias("score"), F.lit(-i).alias("turn"), F.lit(s).alias("subject"), F.lit(t).alias("topic")) for i, (s, t, *_) in enumerate(taxonomy)])
    df = df.withColumn("topics", entries)
    own = F.array_max(F.filter("topics", lambda e: e["subject"] == F.col("named_subject")))
    best = F.array_max("topics")
    first = own["score"] > 0.3
    found = F.coalesce(first, F.lit(False)) | (best["score"] > 0)
    pick = lambda f, none: F.when(first, own[f]).when(found, best[f]).otherwise(none)
    return df.withColumns({"subject": pick("subject", "other"), "topic": pick("topic", "general"), "topic_score": pick("score", 0.0)}).drop("topics")


def labels_of(content: Column, url: Column, terms: Mapping[str, Sequence[str]] = d.SOURCE_SUBJECTS) -> Column:
    """Sorted subjects with a term in the content or the URL; general if none."""
    low, link = F.lower(content), F.lower(url)
    found = F.array_sort(F.filter(F.array(*[F.when(tx.any_of(low, ts) | tx.any_of(link, ts), s) for s, ts in terms.items()]), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def scraping_strategy(content: Column) -> Column:
    low = F.lower(content)
    return F.when(tx.any_of(low, d.SCRIPTED_PAGES), "dynamic_javascript").when(tx.any_of(low, d.SERVICE_PAGES), "api_endpoint").otherwise("static_html")


def category_subjects(categories: Column) -> Column:
    """Sorted subjects of category codes by the first prefix that fits; general if none fits."""

    def one(code: Column) -> Column:
        out = F.when(F.lit(False), "")
        for prefix, subject in d.CATEGORY_PREFIXES:
            out = out.when(code.startswith(prefix), subject)
        return out

    found = F.array_sort(F.array_distinct(F.filter(F.transform(categories, one), lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def language_vote(text: Column, terms: Mapping[str, Sequence[str]] = d.LANGUAGE_TERMS) -> tuple[Column, Column]:
    """(language, confidence) by occurrences of each language's terms; en and 0 without any."""
    low = F.lower(text)
    best, score = tx.first_most([(lang, total([tx.occurrences(low, t.lower()) for t in ts])) for lang, ts in terms.items()], "en")
    return best, F.least(score / 10, F.lit(1.0))
