"""Settings of an application: nested, saved as JSON, loaded over defaults, and taken over into a session."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Limits:
    workers: int = 4
    downloads: int = 10
    timeout_s: int = 30
    retries: int = 3


@dataclass
class Filters:
    least_relevance: float = 0.4
    least_quality: float = 0.5
    levels: list[str] = field(default_factory=lambda: ["high_school", "undergraduate", "graduate"])


@dataclass
class Settings:
    name: str = "folioflow"
    output: str = "out"
    limits: Limits = field(default_factory=Limits)
    filters: Filters = field(default_factory=Filters)
    spark: dict[str, str] = field(default_factory=dict)


def merged(default: Any, data: dict[str, Any]) -> Any:
    """A copy of a settings object with the values of data; keys that it doesn't have are an error, missing ones keep their default."""
    known = {f.name for f in fields(default)}
    if extra := set(data) - known:
        raise ValueError(f"no such setting: {', '.join(sorted(extra))}")
    return type(default)(**{n: merged(v, data[n]) if n in data and is_dataclass(v) else data.get(n, v) for n, v in ((n, getattr(default, n)) for n in known)})


def load(path: str) -> Settings:
    """Settings of a JSON file; the defaults if there is none."""
    at = Path(path)
    return merged(Settings(), json.loads(at.read_text(encoding="utf-8"))) if at.exists() else Settings()


def save(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2, ensure_ascii=False), encoding="utf-8")


def apply(settings: Settings, spark: SparkSession) -> None:
    """Session settings that the application asks for."""
    for k, v in settings.spark.items():
        spark.conf.set(k, v)
