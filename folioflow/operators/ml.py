"""Learned parts: keywords by TF-IDF, topic and level classifiers, a language scorer."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d

SENTENCE, TOKEN = re.compile(r"[^.!?]+"), re.compile(r"\w\w+")


def keywords_of(text: str, stop: frozenset[str], most: int = 20) -> list[str]:
    """Words and word pairs of the highest mean TF-IDF weight, to nine places, over the text's own sentences; none under 50 characters."""
    if len(text) < 50:
        return []
    sentences = []
    for s in SENTENCE.findall(text.lower()):
        ws = [w for w in TOKEN.findall(s) if w not in stop]
        terms = Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)])
        if terms:
            sentences.append(terms)
    if len(sentences) < 2:
        counts = Counter(t for s in sentences for t in s.elements() if " " not in t)
        return [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]
    n = len(sentences)
    df = Counter(t for s in sentences for t in s)
    weight: Counter[str] = Counter()
    for s in sentences:
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in s.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            weight[t] += x / norm / n
    return [t for t, _ in sorted(weight.items(), key=lambda x: (-round(x[1], 9), x[0]))[:most]]


def keywords(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = 20) -> DataFrame:
    """(id, keywords) of each text; every document is a corpus of its own, so nothing is shuffled."""
    stop = frozenset(d.ENGLISH_STOP_WORDS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({id_column: p[id_column], "keywords": [keywords_of(t or "", stop, most) for t in p[text]]})

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text).mapInPandas(run, f"{id_column} {kind}, keywords array<string>")


def topic_rows(terms: dict[str, Sequence[str]] = d.SUBJECT_TERMS, copies: int = 5) -> list[tuple[str, str]]:
    """Training rows made of each subject's own terms."""
    return [(" ".join(ts), subject) for subject, ts in terms.items() for _ in range(copies)]


def text_classifier(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1000, min_df: float = 2.0, max_df: float = 0.8) -> PipelineModel:
    """TF-IDF of words and word pairs that at least min_df and at most a share max_df of the rows hold, and multinomial naive Bayes."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+"), StopWordsRemover(inputCol="words", outputCol="kept"), NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="select *, concat(kept, pairs) as terms from __THIS__"), CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features, minDF=min_df, maxDF=max_df if max_df < 1 else float(1 << 40)), IDF(inputCol="tf", outputCol="features"),
    ]
    fitted = Pipeline(stages=stages).fit(rows)
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    model = NaiveBayes(featuresCol="features", labelCol="y").fit(index.transform(fitted.transform(rows)))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel([fitted, model, back])


def topic_probabilities(model: PipelineModel, docs: DataFrame, least: float = 0.1, most: int = 5) -> DataFrame:
    """docs with `topics`: (probability, topic) above `least`, best first."""
    labels = F.array(*[F.lit(x) for x in model.stages[-1].getLabels()])
    pairs = F.arrays_zip(vector_to_array("probability").alias("p"), labels.alias("topic"))
    best = F.slice(F.sort_array(F.filter(pairs, lambda x: x["p"] > least), asc=False), 1, most)
    return model.transform(docs).withColumn("topics", best)


#: A row for each level to start from, until labelled rows come.
LEVEL_ROWS = [("basic introduction simple lesson homework for school", "high_school"), ("lecture course intermediate assignment for college students", "undergraduate"), ("advanced research seminar methodology thesis for doctoral work", "graduate")]


def level_classifier(rows: DataFrame, more: DataFrame | None = None) -> PipelineModel:
    """The same classifier over levels, bootstrapped on few rows (text, label), so that every term counts; `more` are labelled rows to train it anew with."""
    return text_classifier(rows if more is None else rows.unionByName(more), min_df=1.0, max_df=1.0)


def retrained(rows: DataFrame, more: DataFrame, **options) -> PipelineModel:
    return text_classifier(rows.unionByName(more), **options)


def detect_language(docs: DataFrame, profiles: dict[str, Sequence[str]], text: str = "text", least: int = 50) -> DataFrame:
    """docs with language and confidence by the share of words on each language's list; short texts are en with 0."""
    low = F.lower(F.trim(F.col(text)))
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}]+)"), 1)
    scored = F.array(*[F.struct((F.size(F.filter(words, lambda w: w.isin(*ts))) / F.greatest(F.size(words), F.lit(1))).alias("score"), F.lit(-i).alias("turn"), F.lit(lang).alias("lang")) for i, (lang, ts) in enumerate(profiles.items())])
    best = F.array_max(scored)
    sure = (F.char_length(low) >= least) & (best["score"] > 0)
    return docs.withColumns({"language": F.when(sure, best["lang"]).otherwise("en"), "confidence": F.when(sure, F.least(F.lit(1.0), best["score"] * 4)).otherwise(0.0)})
