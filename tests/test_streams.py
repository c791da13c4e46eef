"""Streams over tables of one file and of many, in any order, with restarts and late rows."""

import pytest
from oracle import expected, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import grouping as gr
from folioflow.operators import monitoring as mo
from folioflow.plans import fixtures as fx
from folioflow.plans import learned
from folioflow.streaming import event_time as et
from folioflow.streaming import increments as inc
from folioflow.streaming import monitor as st

STREAMS = ["stream_hourly_metrics", "stream_transitions", "stream_breakers"]


@pytest.fixture(scope="session")
def shuffled(spark, sf, tmp_path_factory):
    """The events in 40 files, in no order."""
    at = str(tmp_path_factory.mktemp("shuffled"))
    spark.read.parquet(f"{sf}/events.parquet").orderBy(F.xxhash64("event_id")).repartition(40).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", STREAMS)
def test_order_of_files_does_not_matter(spark, sf, shuffled, name):
    assert rows(learned.QUERIES[name](spark, shuffled).toPandas()) == expected(learned.SQL[name], sf)


def calls(events):
    return events.select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


LIMITS = {"failures": 2, "timeout": 86400.0, "successes": 2}


def test_a_stopped_stream_goes_on(spark, sf, shuffled, tmp_path):
    """Half of the files, a stop, the others, another stop, the end: as if it had run once."""
    all_, there = spark.read.parquet(f"{shuffled}/events.parquet"), f"{tmp_path}/events.parquet"
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    rows_ = lambda: calls(st.event_stream(spark, there))
    all_.where(half == 0).write.parquet(there)
    closing = et.closing_folder(rows_())
    run = lambda last: et.run_to_end(et.breaker_states(et.closed(rows_(), closing), "user_id", learned.ANY_ORDER, **LIMITS), f"{tmp_path}/out", f"{tmp_path}/state", last)
    assert run(None).count() == 0  # nothing settles yet
    all_.where(half == 1).write.mode("append").parquet(there)
    run(None)
    got = run(closing).where("not late").select("user_id", "seq", "allowed", "state", "failures")
    assert rows(got.toPandas()) == expected(learned.SQL["stream_breakers"], sf)


def test_late_rows_are_told(spark, sf, shuffled, tmp_path):
    """With a short patience rows come too late; each call is either folded or told as late."""
    rows_ = calls(st.event_stream(spark, f"{shuffled}/events.parquet"))
    closing = et.closing_folder(rows_)
    told = et.run_to_end(et.breaker_states(et.closed(rows_, closing), "user_id", "2 hours", **LIMITS), f"{tmp_path}/out", f"{tmp_path}/state", closing)
    n = {r["late"]: r["n"] for r in told.groupBy("late").agg(F.count_distinct("seq").alias("n")).collect()}
    assert n[True] > 100
    assert n[True] + n[False] == 1000
    settled = calls(spark.read.parquet(f"{sf}/events.parquet")).join(told.where("not late").select("seq"), "seq", "left_semi")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "seq")).cast("long")
    batch = mo.breaker_states(settled.select("user_id", place.alias("seq"), (mo.micros(F.col("ts")) / 1e6).alias("seconds"), "ok"), "user_id", **LIMITS)
    stream = told.where("not late").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("_micros", "seq")).cast("long").alias("seq"), "allowed", "state", "failures")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_late_windows_are_added(spark, sf, shuffled, tmp_path):
    told = et.run_to_end(et.windowed_metrics(st.event_stream(spark, f"{shuffled}/events.parquet"), "event_type"), f"{tmp_path}/out", f"{tmp_path}/state")
    whole = et.whole_windows(told, "event_type")
    assert whole.agg(F.sum("n")).first()[0] == 1000
    assert whole.agg(F.sum("n_late")).first()[0] > 100


def test_rows_without_a_time_or_a_key(spark, tmp_path):
    at = f"{tmp_path}/events.parquet"
    spark.sql("select * from values (1L, timestamp_ntz'2024-01-01 10:00:00', 'a', 1.0D, true), (2L, null, 'a', 2.0D, false), (3L, timestamp_ntz'2024-01-01 10:30:00', null, null, false), (4L, timestamp_ntz'2024-01-01 10:20:00', 'a', 5.0D, false) as t(event_id, ts, k, value, up)").write.parquet(at)
    e = st.event_stream(spark, at)
    whole = et.whole_windows(et.run_to_end(et.windowed_metrics(e, "k"), f"{tmp_path}/a", f"{tmp_path}/b"), "k")
    assert {(r["start"], r["k"], r["n"], r["total"], r["n_late"]) for r in whole.collect()} == {(1704103200000, "a", 2, 6.0, 0), (None, "a", 1, 2.0, 0), (1704103200000, None, 1, None, 0)}
    closing = et.closing_folder(e.select("k", "ts", "event_id", "up"))
    told = et.run_to_end(et.transitions(et.closed(e.select("k", "ts", "event_id", "up"), closing), "k", learned.ANY_ORDER), f"{tmp_path}/c", f"{tmp_path}/d", closing)
    assert {(r["k"], r["event_id"], r["up"], r["was_up"], r["late"]) for r in told.collect()} == {("a", 2, None, None, True), ("a", 4, False, True, False)}


def test_odd_names_of_folders(spark, sf, tmp_path):
    """Characters of patterns and a slash at the end are part of the name."""
    at = f"{tmp_path}/a{{b}}[c]*/x"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(at)
    for path in (at, at + "/"):
        assert st.run_to_table(st.counters(st.event_stream(spark, path), "event_type"), f"{tmp_path}/o{len(path)}", f"{tmp_path}/s{len(path)}", "update", ("event_type",)).agg(F.sum("n")).first()[0] == 1000


def test_increments_equal_the_whole(spark, sf, tmp_path):
    """Batches in any order, one of them twice, and compacted ones: groups, series and folders as of all documents; a batch writes its own rows alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work = inc.add_batch(f"{tmp_path}/t", fx.meta_of)
    for batch, rest in enumerate((2, 0, 1)):
        work(docs.where(F.col("doc_id") % 3 == rest), batch)
    work(docs.where(F.col("doc_id") % 3 == 0), 1)  # a replay
    inc.compacted(spark, f"{tmp_path}/t", f"{tmp_path}/u", 1)
    meta = fx.meta(spark, sf)
    want = sorted(map(repr, gr.series(meta).collect()))
    names = gr.author_members(meta).unionByName(gr.institution_members(meta))
    for at in ("t", "u"):
        path = f"{tmp_path}/{at}"
        assert sorted(map(repr, inc.series(spark, path).collect())) == want
        assert sorted(map(tuple, inc.members(spark, path).collect())) == sorted(map(tuple, names.collect()))
        assert {(r["subject_area"], r["academic_level"]): r["n"] for r in inc.folders(spark, path).collect()} == {(r[0], r[1]): r[2] for r in meta.groupBy("subject_area", "academic_level").count().collect()}
    assert inc.of(spark, f"{tmp_path}/t", "authors").where("batch = 1").count() == fx.meta_of(docs.where("doc_id % 3 = 0")).where(F.size("authors") > 0).count()
