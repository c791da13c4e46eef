"""Queries of readability, relevance, level, subject, topic and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx
from folioflow.functions.readability import add_readability
from folioflow.functions.tables import table
from folioflow.operators import scoring as sc
from folioflow.plans import fixtures as fx
from folioflow.plans import sqlgen as g

r6 = lambda c: tx.rounded(F.col(c)).alias(c)
MEASURE_NAMES = ("flesch_ease", "fk_grade", "ari", "complexity")
#: Terms that occur in the generated texts, for the same scores at scale.
SYLLABLE_SUBJECTS = {"thing": ["thing", "erth", "tion"], "mente": ["mente", "eau", "ouau"], "keit": ["keit", "ung", "sch"], "cion": ["ción", "iez", "dad"]}
LANGUAGE_WORDS = {"en": [" the ", " and ", " of "], "fr": [" le ", " et ", " les "], "de": [" der ", " und ", " die "], "es": [" el ", " y ", " los "]}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def readability_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_readability(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "words", "sentences", "syllables", "chars", *map(r6, MEASURE_NAMES))


def complexity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = add_readability(docs(spark, sf_dir).select("lang", "text"))
    bucket = F.floor(F.round("complexity", 6) * 10).cast("bigint").alias("bucket")
    return p.groupBy("lang", bucket).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("words").alias("sum_words"))


def conversation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = add_readability(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", "text"))
    return p.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("words").alias("sum_words"), F.sum("syllables").alias("sum_syllables"), F.max("sentences").alias("max_sentences"))


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("keyword_score", "institution_score", "author_score", "structure_score", "file_quality", "relevance_score")
    return sc.relevance(fx.meta(spark, sf_dir)).select("filename", *map(r6, names), "is_educational", F.size("reasons").cast("bigint").alias("n_reasons"))


def level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.classify_level(fx.meta(spark, sf_dir))
    names = ("level_ease", "level_grade", "high_school_terms", "undergraduate_terms", "graduate_terms", "course_level", "level_confidence", "complexity_score")
    return out.select("filename", "predicted_level", *map(r6, names), F.array_join("reasoning", "; ").alias("reasoning"))


def inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.include(sc.classify_level(sc.relevance(fx.meta(spark, sf_dir)))).select("filename", "is_educational", "predicted_level", "should_include")


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.filter_statistics(sc.include(sc.classify_level(sc.relevance(fx.meta(spark, sf_dir)))))
    return out.withColumn("inclusion_rate", F.round("inclusion_rate", 6))


def extractor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.meta(spark, sf_dir).select("filename", sc.extractor_level(F.col("title"), F.col("content")).alias("level"))


def subject_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject, score = sc.subject_by_occurrence(F.concat_ws(" ", "title", "content"))
    return fx.meta(spark, sf_dir).select("filename", subject.alias("subject"), score.alias("score"))


def subject_occurrence_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject, score = sc.subject_by_occurrence(F.col("text"), SYLLABLE_SUBJECTS)
    return docs(spark, sf_dir).select("doc_id", subject.alias("subject"), score.alias("score"))


def topic_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.classify_topic(fx.meta(spark, sf_dir)).select("filename", "named_subject", "subject", "topic", r6("topic_score"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.meta(spark, sf_dir)
    labels = F.array_join(sc.labels_of(F.col("content"), F.col("download_source")), ",")
    return m.select("filename", labels.alias("subjects"), sc.scraping_strategy(F.concat_ws(" ", "title", "content")).alias("strategy"))


CATEGORIES = [("p1", ["cs.LG", "stat.ML"]), ("p2", ["hep-th", "quant-ph"]), ("p3", ["cond-mat.str-el", "astro-ph.GA"]), ("p4", ["econ.EM", "xyz"]), ("p5", ["unknown"]), ("p6", [])]
CATEGORIES_ = fx.Spread(CATEGORIES, "paper string, categories array<string>", "documents", "doc_id", paper="concat(t.paper, '-', x.doc_id)")


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CATEGORIES_.rows(spark, sf_dir)
    return rows.select("paper", F.array_join(sc.category_subjects(F.col("categories")), ",").alias("subjects"))


def language_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, sure = sc.language_vote(F.concat_ws(" ", "title", "content"))
    return fx.meta(spark, sf_dir).select("filename", lang.alias("language"), F.round(sure, 6).alias("confidence"))


def language_keyword_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, _ = sc.language_vote(F.col("text"), LANGUAGE_WORDS)
    return docs(spark, sf_dir).select("lang", lang.alias("voted")).groupBy("lang", "voted").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- SQL -----------------------------------------------------------------

_T = "coalesce(text, '') as t"


def _relevance_sql() -> str:
    text = f"lower({g.joined('title', 'description', "array_to_string(keywords, ' ')", "substr(content, 1, 1000)")})"
    n = sum(len(t) for _, t in d.RELEVANCE_TERMS.values())
    keyword = f"least(({' + '.join(f'{g.hits("txt", t)} * {w}::double' for w, t in d.RELEVANCE_TERMS.values())}) / ({n} * 0.1::double), 1.0)"
    place = f"lower({g.joined('institution', 'download_source')})"
    institution = "case when place = '' then 0.0 " + " ".join(f"when {g.any_of('place', t)} then {s}" for s, t in d.INSTITUTIONS) + f" when {g.any_of('place', d.ACADEMIC_DOMAINS)} then 0.6 else 0.2 end"
    author = f"case when len(authors) > 0 then least({g.hits("lower(array_to_string(authors, ' '))", d.AUTHOR_TITLES)} * 0.3::double + (case when len(authors) > 1 then 0.2 else 0.0 end)::double + (case when institution <> '' then 0.2 else 0.0 end)::double, 1.0) else 0.0 end"
    shape = g.joined("title", "course_code", "substr(content, 1, 500)")
    structure = "least((" + " + ".join(f"regexp_matches(shape, {fx.literal('(?i)' + p)})::int" for p in d.COURSE_PATTERNS) + f") * 0.3::double + {g.hits('lower(shape)', d.STRUCTURE_TERMS)} * 0.1::double, 1.0)"
    quality = "greatest(1.0::double - (case when file_size < 1024 then 0.5 when file_size > 104857600 then 0.3 else 0.0 end)::double - (case when page_count > 0 and page_count < 5 then 0.4 when page_count > 1000 then 0.2 else 0.0 end)::double - (case when text_ratio < 0.1 then 0.6 else 0.0 end)::double, 0.0)"
    return f"""
  rel0 as (select *, {text} as txt, {place} as place, {shape} as shape from meta),
  rel1 as (select *, ({keyword})::double as keyword_score, ({institution})::double as institution_score, ({author})::double as author_score, ({structure})::double as structure_score, ({quality})::double as file_quality from rel0),
  rel2 as (select *, keyword_score * 0.3::double + institution_score * 0.25::double + author_score * 0.15::double + structure_score * 0.3::double as relevance_score from rel1),
  rel as (select *, relevance_score >= 0.4::double and file_quality >= 0.5::double as is_educational from rel2)"""


def _level_sql(source: str) -> str:
    text = g.joined("title", "description", "course_code", "substr(content, 1, 2000)")
    terms = ", ".join(
        f"least({g.matches('t', v['patterns'])} * 0.3::double + {g.hits('lower(t)', v['subjects'])} * 0.2::double + {g.hits('lower(t)', v['complexity'])} * 0.1::double + {g.hits('lower(t)', v['indicators'])} * 0.15::double, 1.0)::double as {k}_terms"
        for k, v in d.LEVEL_TERMS.items()
    )
    course = r"""list_transform(regexp_extract_all(t || (case when course_code <> '' then ' ' || course_code else '' end), '(?i)\b[A-Z]{2,4}\s*(\d{3,4})\b', 1),
      lambda x: case when x::int between 100 and 299 then 0.6 when x::int between 300 and 499 then 0.8 when x::int between 500 and 999 then 1.0 when x::int < 100 then 0.3 else 0.0 end::double)"""
    scores = {}
    for k in d.LEVELS[:4]:
        s = "0.0::double"
        if k in d.LEVEL_RANGES:
            (a, b), (p, q) = d.LEVEL_RANGES[k]
            s = f"((case when flesch_ease between {a} and {b} then 0.4 else 0.0 end)::double + (case when fk_grade between {p} and {q} then 0.4 else 0.0 end)::double) * 0.3::double + {k}_terms * 0.4::double"
        if k in ("undergraduate", "graduate"):
            s += " + (case when course_level > 0.5 then course_level * 0.2::double else 0.0::double end)"
        if k == "high_school":
            s += " + (case when course_level > 0.5 then 0.0::double else (1 - course_level) * 0.2::double end)"
        scores[k] = s
    reasons = ", ".join([
        "case when flesch_ease < 30 then 'Very difficult text (low readability score)' when flesch_ease > 70 then 'Easy to read text (high readability score)' end",
        "case when fk_grade > 16 then 'Graduate-level reading complexity' when fk_grade > 12 then 'College-level reading complexity' when fk_grade > 8 then 'High school reading complexity' end",
        *[f"case when {k}_terms > 0.3::double then 'Contains {k.replace('_', ' ')} keywords' end" for k in d.LEVEL_TERMS],
        "case when course_level > 0.5 then 'Course numbering suggests advanced level' end",
    ])
    return f"""
  lv0 as (select *, {text} as t from {source}),
  lv1 as (select *, {g.COUNTS}, {terms}, {course} as worth from lv0),
  lv2 as (select *, {g.MEASURES}, case when len(worth) > 0 then least(list_sum(worth) / len(worth), 1.0) else 0.0 end::double as course_level from lv1),
  lv3 as (select *, {g.first_most(scores, 'unknown')} as best, trim(t) = '' as blank from lv2),
  lv as materialized (select * exclude (best), case when blank then 0.0 else best.score end as level_confidence, case when blank or best.score < 0.3::double or best.score <= 0 then 'unknown' else best.label end as predicted_level,
    case when blank then 0.0 else {g.COMPLEXITY} end as complexity_score, case when blank then '' else array_to_string(list_filter([{reasons}], lambda r: r is not null), '; ') end as reasoning from lv3)"""


_INC = "is_educational and relevance_score >= 0.4::double and file_quality >= 0.5::double and (predicted_level = 'unknown' or level_confidence >= 0.3::double)"


def _extractor_sql() -> str:
    t = "lower(title || ' ' || substr(content, 1, 2000))"
    one = lambda terms, n: f"(case when {g.any_of('t', terms)} then {n} else 0 end)"
    basics, work = ["introduction", "basic", "fundamentals"], ["research", "methodology", "analysis"]
    more = {"high_school": f"{one(basics, 1)} + {one(['high school'], 5)}", "undergraduate": one(basics, 2), "graduate": one(work, 2), "postgraduate": f"{one(['dissertation', 'phd'], 5)} + {one(work, 1)}"}
    best = g.first_most({k: f"{g.hits('t', d.EXTRACTOR_LEVEL_TERMS[k])} + {more[k]}" for k in d.LEVELS[:4]}, "unknown")
    return f"with {fx.meta_sql()}, x as (select filename, {t} as t from meta), y as (select filename, {best} as best from x) select filename, case when best.score > 0 then best.label else 'unknown' end as level from y"


def _subject_sql(terms: dict, source: str, key: str) -> str:
    scored = {s: " + ".join(f"({g.occurrences('t', x)} + case when contains(t, {fx.literal(x)}) then 2 else 0 end)" for x in ts) for s, ts in terms.items()}
    return f"{source}, y as (select {key}, {g.first_most(scored, 'unknown')} as best from x) select {key}, case when best.score > 0 then best.label else 'unknown' end as subject, best.score as score from y"


def _topic_sql() -> str:
    kw = "array_to_string(keywords, ' ')"
    said = "case when area = '' then null " + " ".join(f"when {g.any_of('area', ts)} then '{s}'" for s, ts in d.SUBJECT_HINTS.items()) + " end"
    counted = g.first_most({s: g.hits("named", ts) for s, ts in d.SUBJECT_HINTS.items()}, "other")
    entry = lambda i, s, t, ts, ls: f"{{'score': least(case when academic_level in ({', '.join(map(fx.literal, ls))}) then {g.hits('t', ts)}::double / {len(ts)} * 1.2::double else {g.hits('t', ts)}::double / {len(ts)} end, 1.0)::double, 'turn': {-i}, 'subject': '{s}', 'topic': '{t}'}}"
    entries = ", ".join(entry(i, *x) for i, x in enumerate(d.TAXONOMY))
    return f"""with {fx.meta_sql()},
  a as (select *, lower(concat_ws(' ', title, {kw}, description)) as t, lower(subject_area) as area, lower(concat_ws(' ', title, subject_area, {kw})) as named from meta),
  b as (select *, {said} as said, {counted} as counted, [{entries}] as topics from a),
  c as (select *, coalesce(said, case when counted.score > 0 then counted.label else 'other' end) as named_subject from b),
  e as (select *, list_max(list_filter(topics, lambda x: x.subject = named_subject)) as own, list_max(topics) as best from c),
  f as (select filename, named_subject, case when coalesce(own.score, 0.0) > 0.3::double then own when best.score > 0 then best end as pick from e)
  select filename, named_subject, coalesce(pick.subject, 'other') as subject, coalesce(pick.topic, 'general') as topic, round(coalesce(pick.score, 0.0), 6) as topic_score from f"""


def _labels_sql() -> str:
    found = ", ".join(f"case when {g.any_of('low', ts)} or {g.any_of('link', ts)} then '{s}' end" for s, ts in d.SOURCE_SUBJECTS.items())
    return f"""with {fx.meta_sql()}, x as (select filename, lower(content) as low, lower(download_source) as link, lower(concat_ws(' ', title, content)) as both_ from meta),
  y as (select *, list_sort(list_filter([{found}], lambda s: s is not null)) as found from x)
  select filename, case when len(found) > 0 then array_to_string(found, ',') else 'general' end as subjects,
  case when {g.any_of('both_', d.SCRIPTED_PAGES)} then 'dynamic_javascript' when {g.any_of('both_', d.SERVICE_PAGES)} then 'api_endpoint' else 'static_html' end as strategy from y"""


def _category_sql() -> str:
    one = "case " + " ".join(f"when starts_with(c, '{p}') then '{s}'" for p, s in d.CATEGORY_PREFIXES) + " end"
    return f"""with {CATEGORIES_.sql('p')}, x as (select paper, list_sort(list_distinct(list_filter(list_transform(categories, lambda c: {one}), lambda s: s is not null))) as found from p)
  select paper, case when len(found) > 0 then array_to_string(found, ',') else 'general' end as subjects from x"""


def _vote_sql(terms: dict) -> str:
    return g.first_most({lang: " + ".join(g.occurrences("t", t.lower()) for t in ts) for lang, ts in terms.items()}, "en")


QUERIES = {f.__name__: f for f in (
    readability_profile, complexity_buckets, conversation_profile, relevance_scores, level_scores, inclusion, filter_counts, extractor_levels, subject_fixture, subject_occurrence_argmax,
    topic_fixture, source_labels, category_map, language_fixture, language_keyword_vote,
)}
_R6 = ", ".join(f"round({c}, 6) as {c}" for c in MEASURE_NAMES)
SQL = {
    "readability_profile": f"with c as (select doc_id, {g.COUNTS} from (select doc_id, {_T} from documents)), m as (select *, {g.MEASURES} from c), x as (select *, {g.COMPLEXITY} as complexity from m) select doc_id, words, sentences, syllables, chars, {_R6} from x",
    "complexity_buckets": f"with c as (select lang, {g.COUNTS} from (select lang, {_T} from documents)), m as (select *, {g.MEASURES} from c), x as (select *, {g.COMPLEXITY} as complexity from m) select lang, floor(round(complexity, 6) * 10)::bigint as bucket, count(*) as n_docs, sum(words)::bigint as sum_words from x group by all",
    "conversation_profile": f"with c as (select role, {g.COUNTS} from (select role, {_T} from conversations)) select role, count(*) as n_turns, sum(words)::bigint as sum_words, sum(syllables)::bigint as sum_syllables, max(sentences) as max_sentences from c group by role",
    "relevance_scores": f"""with {fx.meta_sql()}, {_relevance_sql()} select filename, {', '.join(f'round({c}, 6) as {c}' for c in ('keyword_score', 'institution_score', 'author_score', 'structure_score', 'file_quality', 'relevance_score'))}, is_educational,
      ((keyword_score > 0.3::double)::int + (institution_score > 0.5)::int + (author_score > 0.3::double)::int + (file_quality < 0.5)::int + (structure_score > 0.4::double)::int + (relevance_score < 0.4::double)::int)::bigint as n_reasons from rel""",
    "level_scores": f"""with {fx.meta_sql()}, {_level_sql('meta')} select filename, predicted_level, round(flesch_ease, 6) as level_ease, round(fk_grade, 6) as level_grade, {', '.join(f'round({c}, 6) as {c}' for c in ('high_school_terms', 'undergraduate_terms', 'graduate_terms', 'course_level', 'level_confidence', 'complexity_score'))}, reasoning from lv""",
    "inclusion": f"with {fx.meta_sql()}, {_relevance_sql()}, {_level_sql('rel')} select filename, is_educational, predicted_level, {_INC} as should_include from lv",
    "filter_counts": f"""with {fx.meta_sql()}, {_relevance_sql()}, {_level_sql('rel')}, i as materialized (select is_educational, predicted_level, {_INC} as inc from lv),
      a as (select count(*) as processed, count(*) filter (where is_educational) as educational_found, count(*) filter (where is_educational and predicted_level = 'high_school') as high_school, count(*) filter (where is_educational and predicted_level = 'undergraduate') as undergraduate,
      count(*) filter (where is_educational and predicted_level = 'graduate') as graduate, count(*) filter (where is_educational and predicted_level not in ('high_school', 'undergraduate', 'graduate')) as unknown_level, count(*) filter (where not inc) as filtered_out from i)
      select *, round((educational_found - filtered_out) / processed, 6) as inclusion_rate from a""",
    "extractor_levels": _extractor_sql(),
    "subject_fixture": _subject_sql(d.SUBJECT_TERMS, f"with {fx.meta_sql()}, x as (select filename, lower(concat_ws(' ', title, content)) as t from meta)", "filename"),
    "subject_occurrence_argmax": _subject_sql(SYLLABLE_SUBJECTS, "with x as (select doc_id, lower(text) as t from documents)", "doc_id"),
    "topic_fixture": _topic_sql(),
    "source_labels": _labels_sql(),
    "category_map": _category_sql(),
    "language_fixture": f"with {fx.meta_sql()}, x as (select filename, lower(concat_ws(' ', title, content)) as t from meta), y as (select filename, {_vote_sql(d.LANGUAGE_TERMS)} as best from x) select filename, case when best.score > 0 then best.label else 'en' end as language, round(least(best.score / 10, 1.0), 6) as confidence from y",
    "language_keyword_vote": f"with x as (select lang, lower(text) as t from documents), y as (select lang, {_vote_sql(LANGUAGE_WORDS)} as best from x) select lang, case when best.score > 0 then best.label else 'en' end as voted, count(*) as n_docs from y group by all",
}
