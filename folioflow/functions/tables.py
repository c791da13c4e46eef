"""Tables between steps, in the folder that driver and executors share, and numbering of rows in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. If its scan has fewer parts than there are cores, its rows are dealt over all: a file of one row group is otherwise the work of one task. Larger tables are not moved."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if parts_of(rows) >= cores else rows.repartition(cores)


def parts_of(rows: DataFrame) -> int:
    """Tasks of the scan behind rows; only their number comes to the driver's Python."""
    return rows._jdf.queryExecution().toRdd().getNumPartitions()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which goes when the application ends; without the setting, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    name = f"{base.rstrip('/')}/folioflow-tables-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read again: cuts lineage, and a lost executor costs no earlier step."""
    path, schema = scratch_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str, parts: int | None = None) -> DataFrame:
    """df with `name`, the 0-based position of each row in the order of columns.

    Rows are dealt to ranges of the order and numbered within each; the ranges' sizes, a row for
    each, give their offsets. So no task holds all rows, as with a window without a partition.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_range", F.shiftright("_at", 33)), "numbered")  # the upper bits are the task, the lower ones count up in it
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offset = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))  # at most `parts` rows
    return dealt.join(offset, "_range").withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_at", "_offset")
