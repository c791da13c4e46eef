"""Readability measures from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx


def flesch_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    ease = 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words)
    return F.when(words > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), ease))).otherwise(0.0)


def flesch_kincaid(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(words > 0, F.greatest(F.lit(0.0), 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59)).otherwise(0.0)


def automated_index(words: Column, sentences: Column, chars: Column) -> Column:
    return F.when(words > 0, F.greatest(F.lit(0.0), 4.71 * (chars / words) + 0.5 * (words / sentences) - 21.43)).otherwise(0.0)


def complexity(ease: Column, grade: Column) -> Column:
    return (F.greatest(F.lit(0.0), (100 - ease) / 100) + F.least(F.lit(1.0), grade / 20)) / 2


def add_readability(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, sentences, syllables, chars and the measures; one pass, nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"words": tx.word_count(t), "sentences": tx.sentence_count(t), "syllables": tx.syllable_count(t), "chars": tx.solid_length(t)})
    w, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    df = df.withColumns({"flesch_ease": flesch_ease(w, s, y), "fk_grade": flesch_kincaid(w, s, y), "ari": automated_index(w, s, F.col("chars"))})
    return df.withColumn("complexity", complexity(F.col("flesch_ease"), F.col("fk_grade")))
