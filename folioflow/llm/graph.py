"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (v, component), the smallest id reachable, for every id that has a link.

    Labels pass along links and then jump to their label's label, so rounds grow
    with the logarithm of a chain's length. Every join is between written
    tables, so that Spark splits a hub's rows at run time; minima are partial
    aggregates. Nothing but a count of changes comes to the driver.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select(F.col("b"), F.col("a"))).where("src <> dst").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "v"), "labels")
    while True:
        near = both.join(labels, F.col("dst") == F.col("v")).groupBy("src").agg(F.min("component").alias("near"))
        passed = labels.join(near, F.col("v") == F.col("src")).select("v", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("changed"))
        passed = materialize(passed, "labels")
        discard(labels)
        if passed.where("changed").isEmpty():
            discard(both)
            out = passed.drop("changed")
            out.scratch = passed.scratch
            return out
        roots = passed.select(F.col("v").alias("root"), F.col("component").alias("further"))
        labels = materialize(passed.join(roots, F.col("component") == F.col("root"), "left").select("v", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        discard(passed)
