"""Shared pieces: scratch tables on the cluster's shared folder, word tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of every contract: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

ARROW_BATCH_BYTES = 2 << 20
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. If it has fewer files than there are cores, its rows are dealt over all: a file of one row group is otherwise the work of one task. Larger tables are not moved."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


#: Lets Spark drop the shuffle files of a finished write; the written table needs them no more.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) for a name of a file or folder in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh name in the shared folder, below a folder of this application that goes when it ends."""
    base = f"{scratch_dir(spark)}/folioflow-{spark.sparkContext.applicationId}"
    store, at = hadoop_path(spark, base)
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind df go once it is written, which bounds the peak of disk in use. Row
    groups are small: a reader holds a column of one at a time, outside the heap as well.
    """
    spark = df.sparkSession
    path, schema, before = scratch_path(spark, label), df.schema, spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(schema).option("parquet.hadoop.vectored.io.enabled", "false").parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            store, at = hadoop_path(t.sparkSession, path)
            store.delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that long documents don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches, joined until they hold `most` bytes; none is empty."""
    waiting, held = [], 0
    for b in batches:
        waiting, held = [*waiting, b], held + b.nbytes
        if held >= most:
            yield from (x for x in pa.Table.from_batches(waiting).combine_chunks().to_batches() if x.num_rows)
            waiting, held = [], 0
    if waiting:
        yield from (x for x in pa.Table.from_batches(waiting).combine_chunks().to_batches() if x.num_rows)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for `size[0]` numbers, then those of start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


# ---- hashing -------------------------------------------------------------

_M1, _M2, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + _G
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def byte_values(lower: bool, salt: int = 1) -> np.ndarray:
    """A random value for each byte; white space is worth nothing, and A-Z as much as a-z if lower."""
    values = mix(np.arange(256, dtype=np.uint64) + u64(salt * 1000003))
    if lower:
        values[65:91] = values[97:123]
    values[[32, 9, 10, 11, 12, 13]] = 0
    return values


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), u64(base | 1))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a batch of texts: 64-bit values, first word of each text, byte spans."""

    value: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    #: Byte offsets of the texts in data.
    at: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, lower: bool = False, chunk: int = 1 << 21) -> Words:
    """Split every text into words and hash each, a bounded run of bytes at a time."""
    data, at = strings(column)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    inside = ~space[data]
    n = len(data)
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[:n] = inside
    opens[1:n] &= ~inside[:-1]
    closes[1:] = inside
    closes[1:n] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]  # a word never crosses into the next text
    opens[cuts] |= inside[cuts]
    closes[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    value = np.zeros(len(start), np.uint64)
    if len(start):
        table_, power = byte_values(lower), powers(int((end - start).max()) + 1, 0x5851F42D4C957F2D)
        w = 0
        with np.errstate(over="ignore"):
            while w < len(start):
                to = max(w + 1, int(np.searchsorted(start, start[w] + chunk)))
                lo, hi = start[w], end[to - 1]
                s = start[w:to] - lo
                lengths = np.diff(np.append(s, hi - lo))
                rel = np.minimum(np.arange(hi - lo) - np.repeat(s, lengths), len(power) - 1)
                value[w:to] = np.add.reduceat(table_[data[lo:hi]] * power[rel], s)
                w = to
            value = mix(value + (end - start).astype(np.uint64) * _G)
    return Words(value, np.searchsorted(start, at), start, end, data, at)


def runs_of(value: np.ndarray, size: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A value for each run of `size` neighbours (the array is `size - 1` shorter)."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = np.zeros(n, np.uint64), u64(base)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * b + value[k : k + n]
    return mix(out)


def shingle_values(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the shingles of each text and where each text's begin.

    A text of fewer words has its whole sequence as its only shingle, a text without words none.
    """
    count = np.diff(w.first)
    per = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(first[-1]), np.uint64)
    all_runs = runs_of(w.value, size)
    long = np.flatnonzero(count >= size)
    if len(long):
        reps = per[long]
        offset = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(first[:-1][long], reps) + offset] = all_runs[np.repeat(w.first[:-1][long], reps) + offset]
    for i in np.flatnonzero((count > 0) & (count < size)):
        v = w.value[w.first[i] : w.first[i + 1]]
        out[first[i]] = mix(runs_of(v, len(v)) + u64(len(v)))[0]
    return out, first
