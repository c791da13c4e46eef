"""Queries of operational state over the events table, and of error handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import dictionaries as d
from folioflow.operators import monitoring as mo
from folioflow.plans import fixtures as fx
from folioflow.plans import sqlgen as g

THRESHOLDS = {"click": 15.0, "error": 20.0, "view": 25.0}
ERRORS = [
    (1, "TimeoutError", None, "took too long"), (2, "Custom", 429, "slow down"), (3, "Custom", 403, ""), (4, "Custom", 404, "cannot decode body"), (5, "Custom", 503, ""), (6, "Custom", None, "Connection reset"),
    (7, "MemoryError", None, ""), (8, "Custom", None, "Access denied"), (9, "Custom", None, "out of memory"), (10, "Custom", 301, "nothing"), (11, "UnicodeDecodeError", None, "can't decode byte"), (12, "OSError", None, "disk"),
]
ERROR_SCHEMA = "id int, name string, status int, message string"
ERRORS_ = fx.Spread(ERRORS, ERROR_SCHEMA, "events", "event_id", id="x.event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def us(c: str) -> F.Column:
    return mo.micros(F.col(c)).alias(c)


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mo.metric_summary(events(spark, sf_dir), "event_type")
    return out.select("event_type", "n", "least", "most", F.round("mean", 6).alias("mean"), "latest", us("first_ts"), us("last_ts"))


def recent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last 48 hours before the table's latest time."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    rows = e.join(F.broadcast(now)).where(mo.within(F.col("ts"), F.col("now"), 48))
    return mo.metric_summary(rows, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), "latest")


def timer_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.index_percentiles(events(spark, sf_dir), "event_type", "value")


def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.windowed_summary(events(spark, sf_dir), "event_type").select(us("start"), "event_type", "n", F.round("total", 4).alias("total"), "most")


def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.windowed_summary(events(spark, sf_dir), "event_type", "2 hours", "1 hour").select(us("start"), "event_type", "n", "most")


def labelled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by name and labels, the last value being the gauge."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int") % 3)
    key = mo.label_key(F.col("event_type"), F.create_map(F.lit("user"), (F.col("user_id") % 2).cast("string"), F.lit("k"), F.col("k").cast("string")))
    return e.groupBy(key.alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


def alerts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.alerts_by_severity(mo.threshold_alerts(events(spark, sf_dir), "event_type", THRESHOLDS))


def alert_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mo.alert_statistics(mo.threshold_alerts(events(spark, sf_dir), "event_type", THRESHOLDS), "event_type", 720.0)
    return out.withColumn("per_hour", F.round("per_hour", 6))


def health_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mo.threshold_alerts(events(spark, sf_dir), "event_type", {"error": 40.0})
    return a.groupBy("user_id").agg(mo.health_status(F.collect_set("severity")).alias("status"), F.count(F.lit(1)).alias("n"))


def availability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mo.availability(events(spark, sf_dir), F.col("event_type") != "error")
    return out.select("total", "available", F.round("rate", 6).alias("rate"), us("last_check"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.transitions(events(spark, sf_dir), "user_id", F.col("event_type") != "error").select("event_id", "user_id", "up", "was_up")


def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.last_n(events(spark, sf_dir), "user_id", 5).select("user_id", "event_id", F.col("age").cast("bigint").alias("age"))


def sliding_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a user over the trailing hour against a budget."""
    rows = mo.trailing_bytes(events(spark, sf_dir), "user_id", 3_600_000_000)
    return rows.select("event_id", F.round("recent", 4).alias("recent"), F.round(mo.bandwidth_delay(F.round("recent", 4), 10.0), 6).alias("delay"))


def rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mo.rate_summary(events(spark, sf_dir), F.col("event_type") != "error", F.col("value") * 1048576, F.lit(2.0))
    return out.select("attempts", "succeeded", *[F.round(c, 6).alias(c) for c in ("success_rate", "mb_per_s", "mean_seconds", "tasks_per_s")])


def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ERRORS_.rows(spark, sf_dir).withColumn("e", mo.classify_error(F.col("name"), F.col("status"), F.col("message")))
    c, s = F.col("e.category"), F.col("e.severity")
    return rows.select("id", c.alias("category"), s.alias("severity"), mo.retryable(c, s, F.col("message")).alias("retry"), mo.recovery_strategy(c, s).alias("strategy"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("event_id") % 8).alias("attempt"))
    return e.select("id", mo.backoff(F.col("attempt")).alias("exponential"), mo.backoff(F.col("attempt"), 0.5, 3.0, 100.0).alias("steeper"))


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker for each user over the events in order; errors are failures."""
    calls = events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), (mo.micros(F.col("ts")) / 1e6).alias("seconds"), (F.col("event_type") != "error").alias("ok"))
    return mo.breaker_states(calls, "user_id", failures=2, timeout=86400.0, successes=2)


_ALERTS = "alerts as (select *, (value - limit_) / limit_ * 100 as excess from (select *, case " + " ".join(f"when event_type = '{k}' then {v}::double" for k, v in THRESHOLDS.items()) + " end as limit_ from events) where value > limit_), a as (select *, case when excess > 50 then 'critical' when excess > 25 then 'error' else 'warning' end as severity from alerts)"
_E = f"with {ERRORS_.sql('e')}"
_CLASS = "case " + " ".join(f"when name = '{n}' then '{c}:{s}'" for n, c, s in d.ERROR_NAMES) + " when status = 429 then 'rate_limit:low' when status in (401, 403) then 'authentication:high' when status between 400 and 499 then 'content:medium' when status between 500 and 599 then 'network:high' " + " ".join(f"when {g.any_of('lower(message)', t)} then '{c}:{s}'" for t, c, s in d.ERROR_WORDS) + " else 'unknown:medium' end"

QUERIES = {f.__name__: f for f in (
    metric_summary, recent_summary, timer_percentiles, hourly_metrics, sliding_metrics, labelled_metrics, alerts_by_severity, alert_statistics, health_by_user, availability_summary, state_transitions, last_values,
    sliding_budget, rate_report, error_classification, backoff_schedule, breaker_states,
)}
SQL = {
    "metric_summary": "select event_type, count(*) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, max_by(value, {'t': ts, 'e': event_id}) as latest, epoch_us(min(ts)) as first_ts, epoch_us(max(ts)) as last_ts from events group by event_type",
    "recent_summary": "select event_type, count(*) as n, round(avg(value), 6) as mean, max_by(value, {'t': ts, 'e': event_id}) as latest from events where ts > (select max(ts) from events) - interval 48 hours group by event_type",
    "timer_percentiles": "with s as (select event_type, list(value order by value) as v from events group by event_type) select event_type, " + ", ".join(f"v[floor(len(v) * {p}::double)::int + 1] as p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " from s",
    "hourly_metrics": "select epoch_us(date_trunc('hour', ts)) as start, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as most from events group by all",
    "sliding_metrics": "with w as (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) select epoch_us(s) as start, event_type, count(*) as n, max(value) as most from w group by all",
    "labelled_metrics": "with m as (select *, concat(event_type, '[k=', (json_extract(props, '$.k')::int) % 3, ',user=', user_id % 2, ']') as metric from events) select metric, count(*) as n, round(sum(value), 4) as total, max_by(value, {'t': ts, 'e': event_id}) as gauge from m group by metric",
    "alerts_by_severity": f"with {_ALERTS}, s as (select unnest(['info', 'warning', 'error', 'critical']) as severity) select s.severity, count(a.event_id) as n from s left join a on a.severity = s.severity group by s.severity",
    "alert_statistics": f"with {_ALERTS}, c as (select event_type, count(*) as n from a group by event_type) select sum(n)::bigint as alerts, round(sum(n) / 720.0::double, 6) as per_hour, (select event_type from c order by n desc, event_type limit 1) as most_active from c",
    "health_by_user": "with a as (select user_id, (value - 40.0::double) / 40.0::double * 100 > 50 as critical from events where event_type = 'error' and value > 40) select user_id, case when bool_or(critical) then 'unhealthy' else 'degraded' end as status, count(*) as n from a group by user_id",
    "availability_summary": "select count(*) as total, count(*) filter (where event_type <> 'error') as available, round(count(*) filter (where event_type <> 'error') / count(*), 6) as rate, epoch_us(max(ts)) as last_check from events",
    "state_transitions": "with s as (select *, event_type <> 'error' as up from events), l as (select *, lag(up) over (partition by user_id order by ts, event_id) as was_up from s) select event_id, user_id, up, was_up from l where was_up is not null and was_up <> up",
    "last_values": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as age from events qualify age <= 5",
    "sliding_budget": "with s as (select event_id, round(sum(value) over (partition by user_id order by ts range between interval 1 hour preceding and current row), 4) as recent from events) select event_id, recent, round(greatest(0.0::double, recent - 10.0::double) / 10.0::double, 6) as delay from s",
    "rate_report": "select count(*) as attempts, count(*) filter (where event_type <> 'error') as succeeded, round(count(*) filter (where event_type <> 'error') * 100 / count(*), 6) as success_rate, round(sum(value * 1048576) / 1048576 / (count(*) * 2.0::double), 6) as mb_per_s, 2.0::double as mean_seconds, 0.5::double as tasks_per_s from events",
    "error_classification": f"""{_E}, c as (select *, string_split({_CLASS}, ':') as cs from e), f as (select id, message, cs[1] as category, cs[2] as severity from c)
      select id, category, severity, severity <> 'critical' and category <> 'authentication' and not (category = 'content' and contains(lower(message), 'decode')) and category in ('network', 'timeout', 'rate_limit') as retry,
      case when severity = 'critical' then 'abort' {' '.join(f"when category = '{c}' then '{s}'" for c, s in d.RECOVERY.items())} else 'retry' end as strategy from f""",
    "breaker_states": """with recursive c as materialized (select user_id, event_id as seq, epoch_us(ts) / 1e6 as t, event_type <> 'error' as ok, row_number() over (partition by user_id order by event_id) as i from events),
      f as (select user_id, 0::bigint as i, null::bigint as seq, true as allowed, 'closed' as state, 0 as failures, 0 as good, null::double as last_ from (select distinct user_id from c) union all
        select user_id, i, seq, allowed, case when not allowed then state when ok then case when was = 'half_open' and good + 1 >= 2 then 'closed' else was end when was = 'half_open' or failures + 1 >= 2 then 'open' else was end,
          case when not allowed then failures when ok then case when was = 'closed' or good + 1 >= 2 then 0 else failures end else failures + 1 end, case when not allowed then good when ok and was = 'half_open' then good + 1 else good end, case when allowed and not ok then t else last_ end
        from (select f.user_id, c.i, c.seq, c.t, c.ok, f.state, f.failures, f.last_, not (f.state = 'open' and f.last_ is not null and c.t - f.last_ < 86400.0) as allowed, case when f.state = 'open' then 'half_open' else f.state end as was, case when f.state = 'open' then 0 else f.good end as good from f join c on c.user_id = f.user_id and c.i = f.i + 1))
      select user_id, seq, allowed, state, failures from f where i > 0""",
    "backoff_schedule": "select event_id as id, least(1.0 * pow(2.0, event_id % 8), 60.0)::double as exponential, least(0.5 * pow(3.0, event_id % 8), 100.0)::double as steeper from events",
}
