"""Dense numbers in sort order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.sources.scratch import Scratch


def placed(rows: DataFrame, order: str | list[str]) -> DataFrame:
    """rows with _k, the place (from 0) in ascending order of a unique column (or of several that are unique together), and _total, the number of rows.

    Rows are sorted over all partitions and written, so that their places hold; each adds the rows of the partitions before its own, whose
    counts (a number a partition) are all that comes together.
    """
    sorted_rows = rows.orderBy(order).withColumn("_part", F.spark_partition_id())
    sorted_rows = sorted_rows.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    written = Scratch(rows.sparkSession, "placed").table(sorted_rows)
    every = W.orderBy("_part")
    parts = written.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"))
    return written.join(F.broadcast(parts), "_part").withColumn("_k", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
