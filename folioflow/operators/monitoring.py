"""Operational state: metrics, alerts, availability, errors, retries, breakers, bandwidth.

Event tables have `ts` (timestamp without zone), a key column and `value`. No
operator reads the clock: times are arguments or columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.functions import text as tx


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def label_key(name: Column, labels: Column) -> Column:
    """name[k=v,...] with labels in order of their keys; the bare name without labels."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.when(F.coalesce(pairs, F.lit("")) == "", name).otherwise(F.concat(name, F.lit("["), pairs, F.lit("]")))


def metric_summary(events: DataFrame, key: str, since: Column | None = None) -> DataFrame:
    """Count, least, largest, mean, latest value and time range of each key, of rows later than `since`."""
    rows = events if since is None else events.where(F.col("ts") > since)
    latest = F.max_by("value", F.struct("ts", "event_id"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), latest.alias("latest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def index_percentiles(rows: DataFrame, key: str, value: str, shares: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """The value at place floor(n * share), counted from 0, of each key's values in order.

    Values are counted first, so that running counts over distinct values tell
    the places; no key's values are gathered in one array.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(key).orderBy(value)
    counts = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda p: F.floor(F.col("n") * p)
    return counts.groupBy(key).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def windowed_summary(events: DataFrame, key: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), key, "n", "total", "most")


def alert_severity(value: Column, threshold: Column) -> Column:
    """By how far the value is above the threshold: over 50 % critical, over 25 % error, else warning; null at or below it."""
    excess = (value - threshold) / threshold * 100
    return F.when(value > threshold, F.when(excess > 50, "critical").when(excess > 25, "error").otherwise("warning"))


def threshold_alerts(events: DataFrame, key: str, thresholds: Mapping[str, float]) -> DataFrame:
    """A row for each event above its key's threshold; stateless, so it serves streams as well."""
    limit = F.when(F.lit(False), 0.0)
    for k, v in thresholds.items():
        limit = limit.when(F.col(key) == k, float(v))
    rows = events.withColumn("threshold", limit).withColumn("severity", alert_severity(F.col("value"), F.col("threshold")))
    return rows.where("severity is not null")


def health_status(severities: Column) -> Column:
    """Of an array of severities."""
    return F.when(F.array_contains(severities, "critical"), "unhealthy").when(F.arrays_overlap(severities, F.array(F.lit("error"), F.lit("warning"))), "degraded").otherwise("healthy")


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """(severity, n) for every severity, those without alerts too."""
    domain = alerts.sparkSession.createDataFrame([(s,) for s in d.SEVERITIES], "severity string")
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def alert_statistics(alerts: DataFrame, component: str, hours: float) -> DataFrame:
    """One row: number of alerts, alerts per hour, and the component with the most, the smallest of equals."""
    by = alerts.groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col(component).alias("c")))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"), (F.coalesce(F.sum("n"), F.lit(0)) / hours).alias("per_hour"), top["c"].alias("most_active"))


def availability(checks: DataFrame, up: Column) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("total"), F.count_if(up).alias("available"), (F.count_if(up) / F.count(F.lit(1))).alias("rate"), F.max("ts").alias("last_check"))


def transitions(checks: DataFrame, key: str, up: Column, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Rows at which a key's state differs from its last one."""
    rows = checks.withColumn("up", up).withColumn("was_up", F.lag("up").over(Window.partitionBy(key).orderBy(*order)))
    return rows.where(F.col("was_up").isNotNull() & (F.col("was_up") != F.col("up")))


def last_n(rows: DataFrame, key: str, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("age", rank).where(F.col("age") <= n)


def trailing_bytes(rows: DataFrame, key: str, width_micros: int = 1_000_000) -> DataFrame:
    """Adds `recent`, the sum of a key's values over the time up to each row."""
    w = Window.partitionBy(key).orderBy(F.col("us")).rangeBetween(-width_micros, 0)
    return rows.withColumn("us", micros(F.col("ts"))).withColumn("recent", F.sum("value").over(w))


def bandwidth_delay(recent: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), recent - limit) / limit


def within(ts: Column, now: Column, hours: int) -> Column:
    return ts > now - F.expr(f"interval {hours} hours")


def rate_summary(rows: DataFrame, ok: Column, size: Column, seconds: Column) -> DataFrame:
    """One row: success rate in percent of attempts (one at least), megabytes a second, mean seconds, tasks a second."""
    n, good = F.count(F.lit(1)), F.count_if(ok)
    time = F.greatest(F.coalesce(F.sum(seconds), F.lit(0.0)), F.lit(1.0))
    return rows.agg(n.alias("attempts"), good.alias("succeeded"), (good * 100 / F.greatest(n, F.lit(1))).alias("success_rate"), (F.sum(size) / 1048576 / time).alias("mb_per_s"), (F.sum(seconds) / F.greatest(n, F.lit(1))).alias("mean_seconds"), (n / time).alias("tasks_per_s"))


# ---- errors --------------------------------------------------------------


def classify_error(name: Column, status: Column, message: Column) -> Column:
    """struct(category, severity): by name, else by HTTP status, else by words of the message, else unknown."""
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))
    out = F.when(F.lit(False), pair("", ""))
    for n, c, s in d.ERROR_NAMES:
        out = out.when(name == n, pair(c, s))
    out = out.when(status == 429, pair("rate_limit", "low")).when(status.isin(401, 403), pair("authentication", "high"))
    out = out.when(status.between(400, 499), pair("content", "medium")).when(status.between(500, 599), pair("network", "high"))
    low = F.lower(F.coalesce(message, F.lit("")))
    for terms, c, s in d.ERROR_WORDS:
        out = out.when(tx.any_of(low, terms), pair(c, s))
    return out.otherwise(pair("unknown", "medium"))


def retryable(category: Column, severity: Column, message: Column) -> Column:
    undecodable = (category == "content") & F.contains(F.lower(message), F.lit("decode"))
    return (severity != "critical") & (category != "authentication") & ~undecodable & category.isin("network", "timeout", "rate_limit")


def recovery_strategy(category: Column, severity: Column) -> Column:
    out = F.when(severity == "critical", "abort")
    for c, s in d.RECOVERY.items():
        out = out.when(category == c, s)
    return out.otherwise("retry")


def backoff(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(initial * F.pow(F.lit(factor), attempt), F.lit(most))


# ---- circuit breaker -----------------------------------------------------

BREAKER = "seq long, allowed boolean, state string, failures int"


class Breaker:
    """closed, open after `failures` failures in a row, half-open after `timeout` seconds, closed again after `successes` successes."""

    def __init__(self, failures: int = 5, timeout: float = 60.0, successes: int = 3):
        self.limits = (failures, timeout, successes)
        self.state, self.failed, self.succeeded, self.last = "closed", 0, 0, None

    def step(self, seconds: float, ok: bool) -> tuple[bool, str, int]:
        """(let through, state after, failures) for a call at a time; a refused call changes nothing."""
        failures, timeout, successes = self.limits
        if self.state == "open":
            if self.last is not None and seconds - self.last < timeout:
                return False, self.state, self.failed
            self.state, self.succeeded = "half_open", 0
        if ok:
            if self.state == "half_open":
                self.succeeded += 1
                if self.succeeded >= successes:
                    self.state, self.failed = "closed", 0
            else:
                self.failed = 0
        else:
            self.failed, self.last = self.failed + 1, seconds
            if self.state == "half_open" or self.failed >= failures:
                self.state = "open"
        return True, self.state, self.failed


def breaker_states(calls: DataFrame, key: str, **limits) -> DataFrame:
    """(key, seq, allowed, state, failures) for calls (key, seq, seconds, ok): a fold over each key's calls in order of seq.

    A key's calls are sorted into one task and read from there in batches, with
    the breaker carried from one to the next, so a hot key costs time but no memory.
    """
    kind = dict(calls.dtypes)[key]
    dealt = calls.select(key, "seq", "seconds", "ok").repartition(key).sortWithinPartitions(key, "seq")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name: object = None
        b: Breaker | None = None
        for rows in parts:
            out = []
            for own, seq, seconds, ok in rows.itertuples(index=False):
                if b is None or own != name:
                    name, b = own, Breaker(**limits)
                out.append((own, seq, *b.step(seconds, ok)))
            yield pd.DataFrame(out, columns=[key, "seq", "allowed", "state", "failures"])

    return dealt.mapInPandas(fold, f"{key} {kind}, {BREAKER}")
