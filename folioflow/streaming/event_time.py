"""Streams whose results don't depend on the order of files: rows wait for the watermark, late ones are told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.functions.tables import scratch_path
from folioflow.operators import monitoring as mo
from folioflow.streaming.monitor import run_to_table

#: The state store that transformWithState needs.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time that no event reaches: a row of it lets the watermark pass all others.
END = "9999-01-01 00:00:00"

Step = Callable[[tuple | None, Row], tuple[tuple, list[tuple]]]


def closing_folder(rows: DataFrame) -> str:
    """An empty folder of files like those of a stream. A file with a row of the time END in it closes the stream."""
    path = scratch_path(rows.sparkSession, "closing")
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(path)
    return path


def closed(rows: DataFrame, closing: str | None) -> DataFrame:
    """rows and those of the closing folder, if there is one."""
    if closing is None:
        return rows
    return rows.unionByName(rows.sparkSession.readStream.schema(rows.schema).parquet(closing))


def watermarked(rows: DataFrame, time: str, late: str) -> DataFrame:
    """The watermark is that of a copy of the time, so that a stateful operator gets late rows too instead of losing them."""
    return rows.withColumn("_clock", F.col(time).cast("timestamp")).withWatermark("_clock", late).withColumn("_micros", F.unix_micros(F.col(time).cast("timestamp"))).drop("_clock")


def with_rocks(run: Callable[[], Any], spark: SparkSession) -> Any:
    """Run with the state store that transformWithState needs, and restore the session's own."""
    conf = spark.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        return run()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)


def run_to_end(rows: DataFrame, path: str, checkpoint: str, closing: str | None = None, time: str = "ts") -> DataFrame:
    """Run a stream over what is there and read all that it has told, with its batch. With a closing folder that is the end of the stream: whatever still waits is folded."""
    told = with_rocks(lambda: run_to_table(rows, path, checkpoint, "append", keep_batch=True), rows.sparkSession)
    if closing is None:
        return told
    kinds = {f.name: f.dataType for f in rows.sparkSession.read.parquet(closing).schema}
    end = rows.sparkSession.range(1).select(*[F.lit(END if c == time else None).cast(k).alias(c) for c, k in kinds.items()])
    end.write.mode("append").parquet(closing)
    return with_rocks(lambda: run_to_table(rows, path, checkpoint, "append", keep_batch=True), rows.sparkSession)


class Told(StatefulProcessor):
    """A processor that tells rows of a schema, in which what isn't named is null."""

    schema: T.StructType

    def row(self, **values: Any) -> Row:
        return Row(*self.schema.names)(*[values.get(c) for c in self.schema.names])

    def close(self) -> None:
        pass


# ---- folds in event order ------------------------------------------------


class Ordered(Told):
    """A key's rows wait by spans of time and are folded in their order once the watermark has passed their span."""

    def __init__(self, step: Step, sequence: str, kept: T.StructType, state: T.StructType, out: Sequence[str], schema: T.StructType, span: int):
        self.step, self.sequence, self.kept, self.state, self.out, self.schema, self.span = step, sequence, kept, state, out, schema, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("span", T.LongType())]), T.StructType([T.StructField("rows", T.ArrayType(self.kept))]))
        self.folded = handle.getValueState("folded", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        passed, new = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            end = None if r["_micros"] is None else (r["_micros"] // 1000 // self.span + 1) * self.span
            if end is None or end <= passed:  # its span is folded, or it has none
                yield self.row(key=key[0], _micros=r["_micros"], late=True, **{self.sequence: r[self.sequence]})
            else:
                new.setdefault(end, []).append(tuple(r[c] for c in self.kept.names))
        for end, own in new.items():
            before = self.waiting.getValue((end,)) if self.waiting.containsKey((end,)) else None
            if before is None:
                self.handle.registerTimer(end)
            self.waiting.updateValue((end,), ([*map(tuple, before[0] if before else ()), *own],))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        end = (expiredTimerInfo.getExpiryTimeInMs(),)
        named = Row(*self.kept.names)
        due = [named(*r) for r in self.waiting.getValue(end)[0]]
        self.waiting.removeKey(end)
        state = self.folded.get() if self.folded.exists() else None
        for r in sorted(due, key=lambda r: (r["_micros"], r[self.sequence])):
            state, told = self.step(state, r)
            for t in told:
                yield self.row(key=key[0], _micros=r["_micros"], late=False, **{self.sequence: r[self.sequence]}, **dict(zip(self.out, t, strict=True)))
        self.folded.update(tuple(state))


def in_order(rows: DataFrame, key: str, time: str, sequence: str, step: Step, state: str, out: str, late: str, span_ms: int = 3_600_000) -> DataFrame:
    """(key, _micros, `sequence`, the columns `out`, late): a fold of each key's rows by time and then `sequence`.

    `step` takes the state, None at first, and a row, and gives the state and rows of `out`. Rows wait
    in a state by spans of time until the watermark, `late` behind the latest time, has passed the end
    of their span; then the span is folded and forgotten. So the result is that of all rows in order,
    in whatever order files come, as long as no row comes later than that. One that does is not
    folded and not lost: it is told with late = true, and so is a row without a time. What is kept of
    a key is its last state and the rows of the open spans, and a task holds those of one span.
    """
    flat = watermarked(rows, time, late).drop(time)
    kinds, own = {f.name: f for f in flat.schema}, T.StructType.fromDDL(out)
    kept = T.StructType([f for f in flat.schema if f.name != key])
    schema = T.StructType([T.StructField("key", kinds[key].dataType), kinds["_micros"], kinds[sequence], *own, T.StructField("late", T.BooleanType())])
    told = flat.groupBy(key).transformWithState(Ordered(step, sequence, kept, T.StructType.fromDDL(state), own.names, schema, span_ms), schema, "Append", "EventTime")
    return told.withColumnRenamed("key", key)


def transitions(events: DataFrame, key: str, late: str) -> DataFrame:
    """(key, _micros, event_id, up, was_up, late) where a key's `up` differs from its last one, by ts and event_id; a key's state is one flag."""

    def step(state: tuple | None, r: Row) -> tuple[tuple, list[tuple]]:
        was = state[0] if state else None
        return (r["up"],), [(r["up"], was)] if was is not None and was != r["up"] else []

    return in_order(events.select(key, "ts", "event_id", "up"), key, "ts", "event_id", step, "was boolean", "up boolean, was_up boolean", late)


def breaker_states(calls: DataFrame, key: str, late: str, **limits: float) -> DataFrame:
    """(key, _micros, seq, allowed, state, failures, late): the circuit breaker of the batch form over a stream of calls (key, ts, seq, ok), by ts and seq."""

    def step(state: tuple | None, r: Row) -> tuple[tuple, list[tuple]]:
        b = mo.Breaker(**limits)
        if state:
            b.state, b.failed, b.succeeded, b.last = state
        told = b.step(r["_micros"] / 1e6, r["ok"])
        return (b.state, b.failed, b.succeeded, b.last), [told]

    return in_order(calls.select(key, "ts", "seq", "ok"), key, "ts", "seq", step, "state string, failed int, succeeded int, last double", "allowed boolean, state string, failures int", late)


# ---- windows -------------------------------------------------------------


class Windowed(Told):
    """Count, sum and greatest value of a window, told anew with each batch that adds to it. Once the watermark has passed its end it is forgotten, and what still comes is told apart."""

    def __init__(self, schema: T.StructType, width_ms: int):
        self.schema, self.width, self.kinds = schema, width_ms, T.StructType.fromDDL("n bigint, total double, most double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getValueState("sums", self.kinds)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        values = [r["value"] for r in rows]
        known = [v for v in values if v is not None]
        n, total, most = len(values), sum(known) if known else None, max(known, default=None)
        end = None if key[0] is None else key[0] + self.width
        late = end is not None and end <= timerValues.getCurrentWatermarkInMs()
        if not late:
            if self.sums.exists():
                m, t, g = self.sums.get()
                n, total, most = n + m, (total or 0.0) + (t or 0.0) if total is not None or t is not None else None, max((x for x in (most, g) if x is not None), default=None)
            elif end is not None:
                self.handle.registerTimer(end)
            self.sums.update((n, total, most))
        yield self.row(**dict(zip(self.schema.names, key)), n=n, total=total, most=most, late=late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.sums.clear()
        return iter(())


def windowed_metrics(events: DataFrame, key: str, late: str = "2 hours", width_ms: int = 3_600_000) -> DataFrame:
    """(start in ms, key, n, total, most, late) of tumbling windows of `ts` from a stream.

    A window's state goes once the watermark, `late` behind the latest time, has passed its end. Rows
    that come for it later are summed by themselves and told with late = true: whole_windows() adds
    them, so no row is lost in whatever order files come. Rows without a time are a window of theirs.
    """
    flat = watermarked(events.select(key, "ts", "value"), "ts", late)
    millis = F.floor(F.col("_micros") / 1000).cast("bigint")
    flat = flat.select((millis - F.pmod(millis, F.lit(width_ms))).alias("start"), key, F.col("value").cast("double").alias("value"))
    schema = T.StructType([*flat.schema.fields[:2], *T.StructType.fromDDL("n bigint, total double, most double, late boolean")])
    return flat.groupBy("start", key).transformWithState(Windowed(schema, width_ms), schema, "Update", "EventTime")


def whole_windows(told: DataFrame, key: str) -> DataFrame:
    """(start, key, n, total, most, n_late): the last that was told of each window, and what came for it too late."""
    last = told.where("not late").groupBy("start", key).agg(F.max_by(F.struct("n", "total", "most", F.lit(0).cast("bigint").alias("n_late")), "batch").alias("x")).select("start", key, "x.*")
    rest = told.where("late").select("start", key, "n", "total", "most", F.col("n").alias("n_late"))
    return last.unionByName(rest).groupBy("start", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n_late").alias("n_late"))
