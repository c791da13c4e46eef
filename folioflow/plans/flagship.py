"""The flagship: profile, filter, keep one of equal texts, and roll up a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.readability import add_readability
from folioflow.functions.tables import table
from folioflow.operators.grouping import hierarchy_rollup
from folioflow.plans import sqlgen as g


def curated(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Readable documents of at least min_words words, the first of equal texts.

    The first of equal texts is a minimum over (id, measures) by hash, summed up
    in each task; texts are dropped before anything is shuffled.
    """
    profile = add_readability(docs).select("doc_id", "lang", "source", "words", "sentences", "complexity", F.sha2("text", 256).alias("h"))
    firsts = profile.groupBy("h").agg(F.min_by(F.struct("doc_id", "lang", "source", "words", "sentences", "complexity"), "doc_id").alias("d"))
    return firsts.select("d.*").where((F.col("words") >= min_words) & (F.col("complexity") > 0))


def curate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    kept = curated(docs)
    return kept.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("words").alias("sum_words"), F.sum("sentences").alias("sum_sentences"), F.min("doc_id").alias("first_doc"), F.round(F.avg(F.round("complexity", 6)), 5).alias("avg_complexity")
    )


def curated_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return hierarchy_rollup(curated(docs), "lang", "source").select("lang", "source", F.col("n").alias("n_docs"), F.col("rolled").cast("bigint").alias("rolled"))


_CURATED = f"""c as (select doc_id, lang, source, t as text, {g.COUNTS} from (select doc_id, lang, source, coalesce(text, '') as t from documents)), m as (select *, {g.MEASURES} from c), p as (select *, {g.COMPLEXITY} as complexity from m),
  k as (select * from p where doc_id in (select min(doc_id) from documents group by text) and words >= 20 and complexity > 0)"""
QUERIES = {f.__name__: f for f in (curate_corpus, curated_rollup)}
SQL = {
    "curate_corpus": f"with {_CURATED} select lang, source, count(*) as n_docs, sum(words)::bigint as sum_words, sum(sentences)::bigint as sum_sentences, min(doc_id) as first_doc, round(avg(round(complexity, 6)), 5) as avg_complexity from k group by all",
    "curated_rollup": f"with {_CURATED} select lang, source, count(*) as n_docs, grouping(lang, source)::bigint as rolled from k group by grouping sets ((), (lang), (lang, source), (source))",
}
