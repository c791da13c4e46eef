"""Cultural context of a text in a known language: writing, direction, school system, levels and subjects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import culture as cu
from folioflow.functions import text as tx


def looked_up(key: Column, table: Mapping[str, str], default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(default)


def labels(text: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    found = [F.when(tx.any_of(text, ts), k) for k, ts in terms.items()]
    return F.filter(F.array(*found) if found else F.array().cast("array<string>"), lambda x: x.isNotNull())


def by_system(system: Column, made: Mapping[str, Column]) -> Column:
    return reduce(lambda a, kv: F.when(system == kv[0], kv[1]).otherwise(a), made.items(), F.array().cast("array<string>"))


def add_context(df: DataFrame, language: str = "language", title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Adds language_name, writing_system, text_direction, academic_system, grade_levels and cultural_subjects (sorted).

    A language without subject terms of its own is searched for the English ones.
    """
    lang, head = F.col(language), F.coalesce(F.col(title), F.lit(""))
    system = looked_up(lang, cu.SYSTEMS, F.lit("western"))
    levels = by_system(system, {s: labels(F.lower(head) if s == "western" else head, t) for s, t in cu.SCHOOL_LEVELS.items()})
    content = F.lower(F.concat_ws(" ", head, F.coalesce(F.col(abstract), F.lit(""))))
    known = sorted({k for t in cu.SUBJECTS.values() for k in t} - {"en"})
    subjects = labels(content, {s: t["en"] for s, t in cu.SUBJECTS.items()})
    for k in known:
        subjects = F.when(lang == k, labels(content, {s: t[k] for s, t in cu.SUBJECTS.items()})).otherwise(subjects)
    own = by_system(system, {s: labels(content, t) for s, t in cu.OWN_SUBJECTS.items()})
    every = F.array_sort(F.array_distinct(F.concat(subjects, own)))
    return df.withColumns({
        "language_name": looked_up(lang, cu.LANGUAGE_NAMES, lang), "writing_system": looked_up(lang, cu.WRITING_SYSTEMS, F.lit("latin")), "text_direction": F.when(lang.isin(cu.RIGHT_TO_LEFT), "rtl").otherwise("ltr"),
        "academic_system": system, "grade_levels": F.when(F.size(levels) > 0, levels).otherwise(F.array(F.lit("unknown"))), "cultural_subjects": F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("general"))),
    })
