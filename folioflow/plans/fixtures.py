"""Small relations for queries whose terms don't occur in generated text, as Spark rows and as SQL VALUES."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.tables import table

META = (
    "ordinal int, filename string, title string, authors array<string>, institution string, subject_area string, academic_level string, keywords array<string>, course_code string, "
    "page_count int, text_ratio double, quality_score double, description string, file_size bigint, download_source string, content string"
)


def _doc(i: int, title: str, authors: list[str], institution: str, subject: str, level: str, keywords: list[str], code: str, pages: int, ratio: float, quality: float, about: str, size: int, source: str, content: str) -> tuple:
    return (i, f"doc{i:02d}.pdf", title, authors, institution, subject, level, keywords, code, pages, ratio, quality, about, size, source, content)


DOCS = [
    _doc(0, "Operating Systems Lecture 1", ["Prof. Ada Byron", "Lin Wu"], "Northfield University", "computer_science", "undergraduate", ["programming", "algorithm", "systems"], "CS240", 34, 0.92, 0.81, "Processes and software design", 2_400_000, "https://cs.northfield.edu", "This lecture course covers the algorithm behind each data structure. Students read the textbook chapter first."),
    _doc(1, "Operating Systems Lecture 2", ["Prof. Ada Byron"], "Northfield University", "computer_science", "undergraduate", ["programming", "memory"], "CS240", 41, 0.9, 0.83, "Memory and programming", 2_100_000, "https://cs.northfield.edu", "The second lecture treats memory, network and database programming in python and java."),
    _doc(2, "Operating Systems Homework 1", ["Prof. Ada Byron"], "Northfield University", "computer_science", "undergraduate", ["assignment", "programming"], "CS 240", 4, 0.95, 0.66, "First assignment", 300_000, "", "Homework. Solve the exercises by Monday!"),
    _doc(3, "Organic Chemistry Handbook", ["Dr. M. Curie", "P. Joliot"], "", "chemistry", "graduate", ["organic", "reaction", "synthesis"], "", 420, 0.7, 0.9, "Advanced methodology of organic reactions", 13_000_000, "elsevier archive", "Reaction mechanism, compound and molecule. A dissertation on carbon and hydrocarbon synthesis; research of the functional group."),
    _doc(4, "Introduction to Calculus Part 1", ["Leo Euler"], "Basel College", "mathematics", "high_school", ["calculus", "limit", "derivative"], "MATH101", 58, 0.88, 0.72, "Basic fundamentals", 900_000, "", "An introduction to the limit, the derivative and the integral. High school review with homework and quiz."),
    _doc(5, "Introduction to Calculus Part 2", ["Leo Euler"], "Basel College", "mathematics", "high_school", ["calculus", "integral", "limit"], "MATH101", 61, 0.87, 0.74, "More fundamentals", 950_000, "", "The integral and the theorem with proof. Simple overview of each function."),
    _doc(6, "Introduction to Calculus Part 4", ["Leo Euler"], "Basel College", "", "high_school", ["calculus", "integral"], "MATH101", 60, 0.86, 0.7, "", 940_000, "", "Equation and matrix."),
    _doc(7, "Quantum Physics Seminar - 3", ["Niels B.", "Dr. Curie"], "MIT", "physics", "graduate", ["quantum", "particle", "uncertainty"], "PHYS 801", 22, 0.99, 0.88, "Seminar on the wave function", 1_500_000, "", "Advanced theoretical seminar. Quantum mechanics, the wave function, particle and field; empirical research, citation and bibliography."),
    _doc(8, "Quantum Physics Seminar - 4", ["Niels B."], "MIT", "physics", "graduate", ["quantum", "schrodinger"], "PHYS 801", 25, 0.98, 0.87, "", 1_600_000, "", "More of quantum and energy."),
    _doc(9, "Marketing Plan", [], "", "", "unknown", ["marketing", "brand", "consumer"], "", 3, 0.05, 0.2, "A leaflet", 800, "shop.example.com", "Buy now."),
    _doc(10, "Cell Biology (2)", ["R. Franklin"], "State University of Hill", "biology", "undergraduate", ["cell", "membrane", "dna"], "BIO-210", 120, 0.8, 0.77, "Cell and membrane", 5_000_000, "", "Cell, membrane and organelle. Protein, enzyme and DNA in evolution; methods and analysis."),
    _doc(11, "Cell Biology (3)", ["R. Franklin"], "State University of Hill", "biology", "undergraduate", ["cell", "mitosis"], "BIO-210", 118, 0.8, 0.76, "", 5_100_000, "", "Mitosis and meiosis."),
    _doc(12, "", [], "", "", "unknown", [], "", 0, 0.0, 0.0, "", 0, "", ""),
    _doc(13, "Universidad: artículo de investigación", ["Ana Ruiz"], "Instituto Andino", "", "unknown", ["Programming", "algorithm"], "", 1200, 0.6, 0.5, "Curso en 2024", 200_000_000, "", "La universidad y el instituto: investigación, educación y artículo académico. La universidad."),
    _doc(14, "Graph Theory and Logic Exam", ["Lin Wu"], "Northfield University", "mathematics", "graduate", ["discrete", "logic", "proof"], "MATH 512", 8, 0.97, 0.69, "Final exam with solution", 410_000, "", "Combinatorics, graph theory, logic and proof. Midterm and final exam."),
]


#: Titles of the catalogue: # is the cohort of a document, @ its part.
TITLES = [
    "Operating Systems C# Lecture @", "Operating Systems C# Homework @", "Graph Theory C# Exam @", "Organic Chemistry C# Handbook", "Introduction to Calculus C# Part @", "Linear Algebra C# Part @", "", "Quantum Physics C# Seminar - @",
    "Topology C# Seminar - @", "Marketing Plan #", "Cell Biology C# (@)", "Genetics C# (@)", "", "Universidad C#: artículo de investigación", "Graph Theory and Logic C# Exam",
]
COHORT = 60


def meta(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The template rows; with sf_dir, a catalogue of all `documents`.

    The generated texts hold no titles, authors or academic words, so a document
    takes these from the template that its id deals it: fifteen templates in
    four parts make a cohort, whose number goes into title, authors, institution
    and code, so that groups grow in number with the table and not in size.
    Language, source, length and the whole text are the document's own.
    """
    if sf_dir is None:
        return spark.createDataFrame(DOCS, META)
    return meta_of(table(spark, sf_dir, "documents"))


def meta_of(docs: DataFrame) -> DataFrame:
    """The catalogue of some rows of `documents`."""
    spark, rows = docs.sparkSession, [(*r, t) for r, t in zip(DOCS, TITLES, strict=True)]
    tpl = F.broadcast(spark.createDataFrame(rows, META.replace("ordinal int", "turn int") + ", pattern string").withColumnsRenamed({c: f"t_{c}" for c in ("filename", "title", "file_size", "page_count", "text_ratio", "quality_score")}))
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").join(tpl, F.col("doc_id") % len(DOCS) == F.col("turn"))
    i = F.col("doc_id")
    cohort = F.floor(i / COHORT).cast("bigint")
    step = F.floor((i % COHORT) / len(DOCS)).cast("bigint")
    part = step + 1 + F.when((cohort % 2 == 1) & (step >= 2), 1).otherwise(0)
    number = lambda c: c.cast("string")
    named = lambda c, n: F.when(F.col(c) == "", "").otherwise(F.concat(c, F.lit(" "), number(n)))
    return d.select(
        i.alias("ordinal"), F.concat(F.lit("doc"), F.lpad(number(i), 9, "0"), F.lit(".pdf")).alias("filename"),
        F.replace(F.replace("pattern", F.lit("#"), number(cohort)), F.lit("@"), number(part)).alias("title"),
        F.transform("authors", lambda a: F.concat(a, F.lit(" "), number(F.floor(i / 40)))).alias("authors"), named("institution", F.floor(cohort / 2)).alias("institution"), "subject_area", "academic_level",
        F.filter(F.concat("keywords", F.array("lang", "source")), lambda k: k.isNotNull()).alias("keywords"),
        F.when(F.col("course_code") == "", "").otherwise(F.concat(F.regexp_extract("course_code", "^[A-Z]+", 0), number(100 + cohort * 7 % 900))).alias("course_code"),
        (i * 37 % 450).cast("int").alias("page_count"), (i * 13 % 100 / 100.0).alias("text_ratio"), (i * 29 % 100 / 100.0).alias("quality_score"), "description",
        (F.coalesce("n_chars", F.lit(0)) * F.when(i % 23 == 0, 100_000).otherwise(97)).cast("bigint").alias("file_size"), "download_source", F.concat_ws(" ", "content", "text").alias("content"),
    )


def spread(spark: SparkSession, sf_dir: str, rows: Sequence[tuple], schema: str, name: str, key: str, columns: dict[str, str]) -> DataFrame:
    """Template rows dealt over a table by its key: a row of the template for each row of the table, with the given columns as SQL over both."""
    names = [x.split()[0] for x in schema.split(", ")]
    tpl = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "turn int, " + schema)
    both = spark.read.parquet(f"{sf_dir}/{name}.parquet").alias("x").join(F.broadcast(tpl).alias("t"), F.col(f"x.{key}") % len(rows) == F.col("t.turn"))
    return both.select(*[F.expr(columns[n]).alias(n) if n in columns else F.col(f"t.{n}") for n in names])


def spread_sql(name: str, rows: Sequence[tuple], schema: str, table: str, key: str, columns: dict[str, str]) -> str:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [f"t.{n}" for n in names]
    body = values_sql(f"{name}_tpl", [(i, *r) for i, r in enumerate(rows)], "turn int, " + schema)
    return f"{body}, {name} as (select {', '.join(f'{columns[n]} as {n}' if n in columns else f'{k} as {n}' for n, k in zip(names, kinds, strict=True))} from {table} x join {name}_tpl t on x.{key} % {len(rows)} = t.turn)"


class Spread:
    """Template rows over a table, as Spark rows and as SQL."""

    def __init__(self, rows: Sequence[tuple], schema: str, table: str, key: str, **columns: str):
        self.args = rows, schema, table, key
        self.columns = columns

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, schema, table, key = self.args
        return spread(spark, sf_dir, rows, schema, table, key, self.columns)

    def sql(self, name: str) -> str:
        rows, schema, table, key = self.args
        return spread_sql(name, rows, schema, table, key, self.columns)


def literal(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(literal, v)) + "]::varchar[]"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(name: str, rows: Sequence[tuple], schema: str) -> str:
    """`name(columns) as (values ...)`, for a with clause."""
    names = [x.split()[0] for x in schema.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name}({', '.join(names)}) as (values {body})"


def meta_sql() -> str:
    """`meta` as meta() makes it of all documents."""
    named = lambda c, n: f"case when {c} = '' then '' else {c} || ' ' || {n} end as {c}"
    return f"""{values_sql('tpl', [(*r, t) for r, t in zip(DOCS, TITLES, strict=True)], META.replace('ordinal int', 'turn int').replace('filename', 't_filename').replace('title', 't_title') + ', pattern string')},
  dealt as (select *, doc_id // {COHORT} as cohort, doc_id % {COHORT} // {len(DOCS)} as step from documents d join tpl on doc_id % {len(DOCS)} = turn),
  meta as (select doc_id as ordinal, 'doc' || lpad(doc_id::varchar, 9, '0') || '.pdf' as filename, replace(replace(pattern, '#', cohort::varchar), '@', (step + 1 + case when cohort % 2 = 1 and step >= 2 then 1 else 0 end)::varchar) as title,
    list_transform(authors, lambda a: a || ' ' || (doc_id // 40)) as authors, {named('institution', '(cohort // 2)')}, subject_area, academic_level, list_filter(list_concat(keywords, [lang, source]), lambda k: k is not null) as keywords,
    case when course_code = '' then '' else regexp_extract(course_code, '^[A-Z]+') || (100 + cohort * 7 % 900) end as course_code, (doc_id * 37 % 450)::int as page_count, (doc_id * 13 % 100 / 100.0)::double as text_ratio, (doc_id * 29 % 100 / 100.0)::double as quality_score,
    description, (coalesce(n_chars, 0) * case when doc_id % 23 = 0 then 100000 else 97 end)::bigint as file_size, download_source, concat_ws(' ', content, text) as content from dealt)"""


def table_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
