"""Pieces of the SQL that query results are checked against."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from folioflow.plans.fixtures import literal

W = r"[\p{L}\p{N}_]+"


def hits(text: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {literal(t)})::int" for t in terms) + ")"


def any_of(text: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {literal(t)})" for t in terms) + ")"


def occurrences(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {literal(term)}, ''))) // {len(term)})"


def matches(text: str, patterns: Sequence[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {literal('(?i)' + p)}))" for p in patterns) + ")"


def joined(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda p: coalesce(p, '') <> ''), ' ')"


def first_most(scored: Mapping[str, str], none: str, fields: str = "") -> str:
    """A struct (score, label) of the first of the largest scores."""
    entries = ", ".join(f"{{'score': ({s})::double, 'turn': {-i}, 'label': {literal(k)}}}" for i, (k, s) in enumerate(scored.items()))
    return f"list_max([{entries}])"


COUNTS = f"""
  len(regexp_extract_all(lower(t), '{W}'))::bigint as words,
  greatest(1, len(regexp_extract_all(t, '[.!?]+')))::bigint as sentences,
  greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(lower(t), '{W}'), lambda w: greatest(1,
    len(regexp_extract_all(w, '[aeiouy]+')) - (case when ends_with(w, 'e') and len(regexp_extract_all(w, '[aeiouy]+')) > 1 then 1 else 0 end)))), 0))::bigint as syllables,
  length(regexp_replace(t, '\\s+', '', 'g'))::bigint as chars"""
MEASURES = """
  case when words > 0 then least(100.0, greatest(0.0, 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words))) else 0.0 end as flesch_ease,
  case when words > 0 then greatest(0.0, 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59) else 0.0 end as fk_grade,
  case when words > 0 then greatest(0.0, 4.71 * (chars / words) + 0.5 * (words / sentences) - 21.43) else 0.0 end as ari"""
COMPLEXITY = "(greatest(0.0, (100 - flesch_ease) / 100) + least(1.0, fk_grade / 20)) / 2"
